"""Saved index pages."""

from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusplan.functions.text import basename
from corpusplan.sources.archives import tasks_for
from corpusplan.sources.inventory import list_files, qualified
from corpusplan.sources.streams import open_read

# a task reads about this many bytes, and holds so many pages at once
_TASK_BYTES = 256 << 20
_TOGETHER = 64


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """pages(url, html) of a Parquet crawl; only those two columns are read."""
    return spark.read.parquet(path).select("url", "html")


def _texts(batches, task_reads):
    for batch in batches:
        paths = batch["path"].tolist()
        for at in range(0, len(paths), task_reads):
            some = paths[at:at + task_reads]
            texts = []
            for path in some:
                with open_read(path) as stream:
                    texts.append(stream.read().decode("utf-8", "replace"))
            yield pd.DataFrame({"path": some, "html": texts})


def read_saved_pages(spark: SparkSession, mirror_dir: str, name: str = "index.html",
                     scheme: str = "http://") -> DataFrame:
    """pages(url, html) of a mirror laid out as host/path/index.html.

    The address of an index page is its folder's, with a trailing slash. Other names may be
    asked for with a pattern, such as `*.html`; such a page's address is its own. Every page that
    is there gives a row, whatever its folders' names; an empty one has an empty text.
    """
    root = qualified(spark, mirror_dir) + "/"
    files = list_files(spark, mirror_dir, f"**/{name}").where(~F.col("is_dir")).select("path", "length")
    texts = files.repartition(tasks_for(files, _TASK_BYTES)).mapInPandas(partial(_texts, task_reads=_TOGETHER), "path string, html string")
    path = F.col("path")
    plain = F.when(basename(path) == "index.html", F.regexp_replace(path, r"[^/]*\z", "")).otherwise(path)
    return texts.select(F.concat(F.lit(scheme), F.substring(plain, len(root) + 1, 1 << 30)).alias("url"), "html")
