"""Keeping plans small."""

from pyspark.sql import DataFrame, functions as F


def settle(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add columns, given as SQL, that later steps see as plain columns.

    Spark copies the expressions of a projection into every later filter and join
    condition on them, which for long CASE expressions outgrows the code generator.
    What a generator yields stays a column, so they go through one that yields
    exactly one row per row.
    """
    fields = ", ".join(f"'{name}', {sql}" for name, sql in columns.items())
    row = F.expr(f"explode(array(named_struct({fields})))").alias("_settled")
    return df.select("*", row).select(*df.columns, "_settled.*")
