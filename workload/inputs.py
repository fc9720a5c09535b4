"""Crawl-like inputs worked out from the test tables.

The tables hold no archive listings, so index pages, category pages and requests are
derived from `documents`: one anchor and one request per document. A dataset version
covers the documents of one source within a block of a thousand, so the number of
datasets grows with the table while each index page keeps its size. The row
expressions are plain SQL that Spark and DuckDB read alike.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusplan.functions.shape import settle

VERSION = "CAST(substr(source, 4) AS BIGINT) + 20 * CAST(floor(doc_id / 1000.0) AS BIGINT)"
KIND = "CAST(floor(doc_id / 20.0) AS BIGINT) % 10"
ASK = "CAST(floor(doc_id / 7.0) AS BIGINT) % 8"
BOX = "CAST(floor(doc_id / 50.0) AS BIGINT)"

# over the columns doc_id, lang, v, k
ANCHOR = {
    "page_url": """CASE v % 3
        WHEN 0 THEN 'http://statmt.org/europarl/v' || v || '/'
        WHEN 1 THEN 'http://data.statmt.org/news-commentary/v' || v || '/training/'
        ELSE 'http://statmt.org/wmt' || v || '/' END""",
    "pos": "CAST(doc_id AS INT)",
    "href": """CASE k
        WHEN 0 THEN lang || '-en-train.tgz'
        WHEN 1 THEN 'news-commentary-v' || v || '.' || lang || '-en.tsv.gz'
        WHEN 2 THEN 'training-parallel/'
        WHEN 3 THEN lang || '-en.tgz'
        WHEN 4 THEN 'news-commentary-v' || v || '.' || lang || '-en.tsv'
        WHEN 5 THEN 'test/'
        WHEN 6 THEN 'news-commentary-v' || v || '.' || upper(lang) || '-en.tsv.gz'
        WHEN 7 THEN ''
        WHEN 8 THEN 'training-monolingual/'
        ELSE 'dev.html' END""",
}

_DATASET = """CASE v % 3 WHEN 0 THEN 'europarl-v' || v WHEN 1 THEN 'news-commentary-v' || v
    ELSE 'wmt' || v END"""

# over the columns doc_id, lang, v, m
REQUEST = {
    "req_id": "CAST(doc_id AS INT)",
    "dataset_id": f"""CASE m WHEN 3 THEN 'un-corpus-v1.0' WHEN 5 THEN 'europarl-v' || (v + 1000000)
        WHEN 6 THEN 'zzz-' || lang ELSE {_DATASET} END""",
    "language_pair": "CASE m WHEN 0 THEN lang || '-en' WHEN 1 THEN '' WHEN 7 THEN lang END",
    "category": "CASE m WHEN 2 THEN 'training-parallel' WHEN 4 THEN 'training' END",
    "target_dir": """CASE m WHEN 0 THEN 'picked/' || lang WHEN 2 THEN '' WHEN 3 THEN 'un-corpus'
        WHEN 4 THEN 't' || v END""",
    "has_target_dir": "m IN (0, 2, 3, 4)",
}

# files that are there before a batch, over the columns of ANCHOR's rows
EXISTING = {
    "output_path": f"'./data/' || {_DATASET} || '/' || href",
    "wanted": "lang = 'de' AND k IN (0, 1, 4)",
}

CATALOGUE_ID = """CASE k % 5 WHEN 0 THEN 'europarl-v7' WHEN 1 THEN 'news-commentary-v15'
    WHEN 2 THEN 'un-corpus-v1.0' WHEN 3 THEN 'wmt14' ELSE 'zzz' END"""

CATEGORY_FILES = [".tgz", ".tar.gz", ".gz", ".zip", ".txt"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns all inputs are worked out from; texts are not read."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return settle(documents, {"v": VERSION, "k": KIND, "m": ASK}).drop("source")


def index_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(seeds(spark, sf_dir), ANCHOR).select(*ANCHOR)


def category_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five files on the page behind every WMT link; some `test/` pages cannot be read."""
    pages = (
        settle(seeds(spark, sf_dir).where("v % 3 = 2"), ANCHOR)
        .where("href <> ''").where("NOT (href = 'test/' AND v % 5 = 0)")
        .select("v", "page_url", "href").distinct()
    )
    endings = F.array(*[F.lit(e) for e in CATEGORY_FILES])
    return pages.select(
        "v", F.concat("page_url", "href").alias("page_url"), F.posexplode(endings).alias("pos", "ending"),
    ).selectExpr("page_url", "pos", "'corpus-' || v || ending AS href")


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_anchors(spark, sf_dir).unionByName(category_anchors(spark, sf_dir))


def index_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same anchors as page texts; an index page has some fifty links by construction."""
    link = F.concat(F.lit('<li><a class="file" href="'), "href", F.lit('">'), "href", F.lit("</a>"))
    listed = anchors(spark, sf_dir).select("page_url", F.struct("pos", link.alias("link")).alias("item"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("item")), lambda i: i["link"]), "\n")
    head = F.lit("<html><!-- <a href='old-en-train.tgz'> --><ul>")
    return listed.groupBy("page_url").agg(F.concat(head, body, F.lit("</ul></html>")).alias("html")).select(
        F.col("page_url").alias("url"), "html")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(seeds(spark, sf_dir), REQUEST).select(*REQUEST)


def datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests without any filter for every dataset there is."""
    return requests(spark, sf_dir).selectExpr(
        "req_id", "dataset_id", "CAST(NULL AS STRING) AS language_pair",
        "CAST(NULL AS STRING) AS category", "target_dir", "has_target_dir")


def existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = settle(seeds(spark, sf_dir), ANCHOR)
    return rows.where(EXISTING["wanted"]).selectExpr(f"{EXISTING['output_path']} AS output_path").distinct()
