"""What happens to each planned file: skipped, landed or failed."""

from pyspark.sql import DataFrame, functions as F


def settled(found: DataFrame, force: bool = False) -> DataFrame:
    """Add status and error from `present` (something is at the output path, NULL counts as no),
    `src_path` (NULL where the mirror lacks the object) and, if there is one, `problem`.

    The one rule of both ways to know the facts: tables of what exists, and tasks that look.
    Existence alone decides; with `force` it is not looked at.
    """
    problem = F.col("problem") if "problem" in found.columns else F.lit(None).cast("string")
    there = F.lit(False) if force else F.coalesce("present", F.lit(False))
    status = F.when(problem.isNotNull(), "failed").when(there, "skipped").when(
        F.col("src_path").isNotNull(), "landed").otherwise("failed")
    missing = F.concat(F.lit("no object for "), "url")
    return (
        found.withColumn("status", status)
        .withColumn("error", F.when(F.col("status") == "failed", F.coalesce(problem, missing)))
        .drop("present", "problem")
    )


def fetch_status(plan: DataFrame, existing: DataFrame, objects: DataFrame, force: bool = False) -> DataFrame:
    """Add status, error and the object's src_path and length.

    plan: one row per output_path. existing: output_path of files already there.
    objects(url, src_path, length): what the mirror holds, one row per url.
    """
    found = plan.join(objects.select("url", "src_path", "length"), "url", "left")
    if force:
        found = found.withColumn("present", F.lit(False))
    else:
        there = existing.select("output_path").distinct().withColumn("present", F.lit(True))
        found = found.join(there, "output_path", "left")
    return settled(found, force)


def to_fetch(plan: DataFrame, existing: DataFrame, force: bool = False) -> DataFrame:
    """Planned files that are not there yet."""
    return plan if force else plan.join(existing, "output_path", "left_anti")


def already_there(plan: DataFrame, existing: DataFrame, force: bool = False) -> DataFrame:
    """Planned files that count as done without a fetch."""
    if force:
        return plan.where(F.lit(False))
    return plan.join(existing, "output_path", "left_semi")


def attribute(plan: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Outcome of every planned row, those that lost their path included.

    plan: all rows, before one was kept per path. A row shares the outcome of the
    kept row when both name the same address, else it is a `collision`. Read the
    outcomes from a written table: then Spark can split a path that very many
    rows want.
    """
    done = outcomes.select(
        "output_path", F.col("url").alias("done_url"), F.col("status").alias("done_status"),
        F.col("error").alias("done_error"),
    )
    same = F.col("url") == F.col("done_url")
    return (
        plan.join(done, "output_path", "left")
        .withColumn("status", F.when(same, F.col("done_status")).otherwise("collision"))
        .withColumn("error", F.when(same, F.col("done_error")).otherwise(
            F.concat(F.lit("path taken by "), "done_url")))
        .drop("done_url", "done_status", "done_error")
    )
