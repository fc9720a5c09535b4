"""Different files that would land on one path."""

from pyspark.sql import DataFrame, Window, functions as F

from corpusplan.functions.skew import mark_first


def _order():
    return [F.asc("req_id"), F.asc("pos"), F.asc("url")]


def first_per_path(plan: DataFrame) -> DataFrame:
    """One row per output path: the first by request, position and address.

    Spark drops all but one row per path and task before the shuffle.
    """
    window = Window.partitionBy("output_path").orderBy(*_order())
    return plan.withColumn("nth", F.row_number().over(window)).where("nth = 1").drop("nth")


def collisions(plan: DataFrame) -> DataFrame:
    """The rows `first_per_path` does not keep. Those with another address than
    the kept row are files that need a place of their own."""
    marked = mark_first(plan, ["output_path"], _order(), "kept", spread=["req_id", "pos", "url"])
    return marked.where(~F.col("kept")).drop("kept")


def path_conflicts(plan: DataFrame) -> DataFrame:
    """Paths wanted by more than one address: rows, addresses, and the kept one.

    Rows of one path and address are folded before addresses are counted, so a path
    named by very many requests stays small in the second step.
    """
    lead = F.struct("req_id", "pos", "url")
    per_address = plan.groupBy("output_path", "url").agg(
        F.count(F.lit(1)).alias("rows"), F.min(lead).alias("lead"))
    return (
        per_address.groupBy("output_path")
        .agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("urls"), F.min("lead").alias("lead"))
        .where("urls > 1")
        .select("output_path", "rows", "urls", F.col("lead.url").alias("kept_url"))
    )
