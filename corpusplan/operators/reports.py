"""Reports over plans, outcomes, the ledger and the catalogue."""

from pyspark.sql import DataFrame, functions as F

from corpusplan import known
from corpusplan.functions.text import basename


def batch_summary(attributed: DataFrame) -> DataFrame:
    """Files held per dataset and a grand total (dataset_id NULL, is_total 1).

    attributed: the outcome of every planned row. A dataset's file counts once over all its
    requests, and a dataset none of whose files is held has 0. Counted per dataset first,
    so the rollup sees one row per dataset.
    """
    held = F.max(F.when(F.col("status").isin("skipped", "landed"), 1).otherwise(0))
    per_file = attributed.groupBy("dataset_id", "url").agg(held.alias("held"))
    per_dataset = per_file.groupBy("dataset_id").agg(F.sum("held").alias("n"))
    return (
        per_dataset.rollup("dataset_id")
        .agg(
            F.grouping("dataset_id").cast("int").alias("is_total"),
            F.count(F.lit(1)).alias("datasets"),
            F.sum("n").alias("files"),
        )
    )


def status_counts(outcomes: DataFrame) -> DataFrame:
    """Planned, skipped, landed and failed files per dataset, counted apart."""
    return outcomes.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("planned"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count_if(F.col("status") == "landed").alias("landed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )


def paths_by_dataset(outcomes: DataFrame) -> DataFrame:
    """The files each dataset has, every address once, over all its requests.

    One row per path rather than one list per dataset: a list would gather a large
    dataset in one value.
    """
    held = outcomes.where(F.col("status").isin("skipped", "landed"))
    return held.groupBy("dataset_id", "url").agg(F.min("output_path").alias("output_path"))


def ledger_size(ledger: DataFrame) -> DataFrame:
    return ledger.agg(F.count(F.lit(1)).alias("entries"))


def ledger_recent(ledger: DataFrame, entries: int = known.RECENT_ENTRIES) -> DataFrame:
    """The newest entries with the name to show."""
    return (
        ledger.orderBy(F.desc("ts"), F.asc("url")).limit(entries)
        .select(basename(F.col("path")).alias("name"), "url", "path", "ts")
    )


def catalogue_listing(catalogue: DataFrame) -> DataFrame:
    """The catalogue with its lists spelled out."""
    return catalogue.select(
        "id", "description",
        F.concat_ws(", ", "language_pairs").alias("language_pairs"),
        F.concat_ws(", ", "categories").alias("categories"),
    )


def language_pairs(requests: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Add the known language pairs of each request's dataset, an empty list where
    none are known."""
    known_pairs = catalogue.select(F.col("id").alias("dataset_id"), "language_pairs")
    return requests.join(known_pairs, "dataset_id", "left").withColumn(
        "language_pairs", F.coalesce("language_pairs", F.array().cast("array<string>")))
