"""The ledger: where each address was landed, and when.

Kept as a log of Parquet batches. A batch is written once under its own id, so a
repeated write replaces itself; reading takes the newest row per address, of equals that of
the later batch. A snapshot folds the log into the first batch of a new log and never
overwrites what it reads.
"""

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from corpusplan.sources.inventory import path_exists
from corpusplan.sources.requests import one_value

LEDGER = "url string, path string, ts bigint"
_JSON = "struct<downloads:map<string,struct<path:string,timestamp:bigint>>>"


def parse_ledgers(texts: DataFrame, text: str = "value") -> DataFrame:
    """Entries of ledgers written as JSON; a broken one, or one with something behind it, counts as empty."""
    parsed = F.when(one_value(F.col(text)), F.from_json(F.col(text), _JSON))
    kept = [c for c in texts.columns if c != text]
    return texts.select(*kept, F.explode(parsed["downloads"]).alias("url", "entry")).select(
        *kept, "url", F.col("entry.path").alias("path"), F.col("entry.timestamp").alias("ts"))


def read_json_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Ledger from a JSON file; one that is missing or broken is empty."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], LEDGER)
    return parse_ledgers(spark.read.option("wholetext", "true").text(path))


def latest(entries: DataFrame, *tiebreaks: str) -> DataFrame:
    """Newest entry per address; one row per address and task is shuffled."""
    newest = Window.partitionBy("url").orderBy(*[F.desc(c) for c in ("ts", *tiebreaks, "path")])
    return entries.withColumn("nth", F.row_number().over(newest)).where("nth = 1").drop("nth")


def ledger_entries(outcomes: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """Ledger rows of freshly landed files, and of files that were there but that the log
    does not know: a run may have been lost between copying and recording."""
    entry = ["url", F.col("output_path").alias("path"), F.col("ts").cast("bigint").alias("ts")]
    landed = outcomes.where("status = 'landed'").select(*entry)
    if log is None:
        return landed
    held = outcomes.where("status = 'skipped'").join(log.select("url"), "url", "left_anti")
    return landed.unionByName(held.select(*entry))


def append_batch(entries: DataFrame, log_dir: str, batch_id: str) -> None:
    entries.select("url", "path", "ts").write.mode("overwrite").parquet(f"{log_dir}/batch={batch_id}")


def read_log(spark: SparkSession, log_dir: str) -> DataFrame:
    """Newest entry per address over all batches; no log yet is an empty ledger."""
    if not path_exists(spark, log_dir):
        return spark.createDataFrame([], LEDGER)
    rows = spark.read.schema(f"{LEDGER}, batch string").parquet(log_dir).select(
        "url", "path", "ts", F.col("_metadata.file_modification_time").alias("_written"), "batch")
    return latest(rows, "_written", "batch").select("url", "path", "ts")


def write_snapshot(ledger: DataFrame, snapshot_dir: str) -> None:
    """Write a folded ledger as the first batch of a new log; fails when the folder exists."""
    if path_exists(ledger.sparkSession, snapshot_dir):
        raise FileExistsError(snapshot_dir)
    ledger.select("url", "path", "ts").write.parquet(f"{snapshot_dir}/batch=snapshot")
