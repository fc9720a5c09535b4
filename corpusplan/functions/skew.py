"""Grouped work that stays spread out when one key holds a large share of the rows.

All of it is exact. A hot group is first divided by a hash of its rows, each part
is settled on its own task, and only one row per part meets in the second step.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

PARTS = 256
LOOKUP_PARTS = 16


def _part(spread: Sequence[str], parts: int) -> Column:
    return F.pmod(F.xxhash64(*spread), F.lit(parts)).cast("int")


def mark_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column], flag: str,
               spread: Sequence[str], parts: int = PARTS) -> DataFrame:
    """Add a boolean: is this row the first of its group in `order`?

    `spread` names columns that differ between the rows of a group.
    """
    local = Window.partitionBy(*keys, "_part").orderBy(*order)
    # leaders of the parts of a group share one window, all others keep to their part
    final = Window.partitionBy(*keys, "_seat").orderBy(*order)
    return (
        df.withColumn("_part", _part(spread, parts))
        .withColumn("_lead", F.row_number().over(local) == 1)
        .withColumn("_seat", F.when(F.col("_lead"), F.lit(-1)).otherwise(F.col("_part")))
        .withColumn("_rank", F.row_number().over(final))
        .withColumn(flag, F.col("_lead") & (F.col("_rank") == 1))
        .drop("_part", "_lead", "_seat", "_rank")
    )


def mark_alone(df: DataFrame, keys: Sequence[str], flag: str,
               spread: Sequence[str], parts: int = PARTS) -> DataFrame:
    """Add a boolean: is this row the only one of its group?"""
    local = Window.partitionBy(*keys, "_part")
    final = Window.partitionBy(*keys, "_seat")
    return (
        df.withColumn("_part", _part(spread, parts))
        .withColumn("_here", F.count(F.lit(1)).over(local))
        .withColumn("_nth", F.row_number().over(local.orderBy(*spread)))
        .withColumn("_seat", F.when(F.col("_nth") == 1, F.lit(-1)).otherwise(F.col("_part")))
        .withColumn("_all", F.sum("_here").over(final))
        .withColumn(flag, (F.col("_nth") == 1) & (F.col("_all") == 1))
        .drop("_part", "_here", "_nth", "_seat", "_all")
    )


def spread_lookup(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str,
                  spread: Sequence[str], parts: int = LOOKUP_PARTS) -> DataFrame:
    """Join to a small-rowed table that is unique per key.

    Each right row is repeated once per part and each left row goes to one part, so
    a hot key of the left side is shared by `parts` tasks. Run-time skew handling
    does not cover this case when the right side was just aggregated.
    """
    every_part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    return (
        left.withColumn("_part", _part(spread, parts))
        .join(right.withColumn("_part", every_part), [*keys, "_part"], how)
        .drop("_part")
    )
