"""MD5 checksums, lower-case hex."""

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusplan.sources.archives import tasks_for
from corpusplan.sources.inventory import list_files, require_path
from corpusplan.sources.streams import open_read

_PIECE = 4 << 20
# a task reads about this many bytes
_TASK_BYTES = 1 << 30


def text_checksums(df: DataFrame, text: str, checksum: str = "md5") -> DataFrame:
    """Checksum of a text column's UTF-8 bytes."""
    return df.withColumn(checksum, F.md5(F.col(text).cast("binary")))


def _md5_of_files(batches):
    for batch in batches:
        sums = []
        for path in batch["path"]:
            digest = hashlib.md5()
            with open_read(path) as stream:
                while data := stream.read(_PIECE):
                    digest.update(data)
            sums.append(digest.hexdigest())
        yield batch.assign(md5=sums)


def file_checksums(spark: SparkSession, path: str, tasks: int | None = None) -> DataFrame:
    """path -> (path, length, md5) of a file or of every file below a folder.

    Files are read in pieces inside the tasks, so none has to fit in memory. A
    missing path raises.
    """
    require_path(spark, path)
    files = list_files(spark, path, recursive=True).select("path", "length")
    return files.repartition(tasks or tasks_for(files, _TASK_BYTES)).mapInPandas(_md5_of_files, "path string, length bigint, md5 string")
