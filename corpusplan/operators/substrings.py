"""Which texts contain which of many wanted strings, without comparing all with all."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

GRAM = 3


def _grams(text: str, length: Column) -> Column:
    """The distinct substrings of one length; none if the text is shorter."""
    places = F.sequence(F.lit(1), F.length(text) - length + 1)
    cut = F.array_distinct(F.transform(places, lambda i: F.substring(F.col(text), i, length)))
    return F.when(F.length(text) >= length, cut).otherwise(F.array().cast("array<string>"))


def containing(texts: DataFrame, wanted: DataFrame, keys: Sequence[str], text: str, part: str, store=lambda df, name: df) -> DataFrame:
    """texts(*keys, text, ...) joined with wanted(*keys, part, ...): equal keys, and `text` contains `part`.

    Every text is listed under its substrings of up to GRAM characters, as far as a wanted string with the same
    keys has them; every wanted string is looked up under its rarest one. What is found there
    is verified. A string with a substring that no text has is settled by that. So the rows compared grow with
    the hits and not with texts times strings. Empty and null strings and texts match nothing; repeated rows of
    either side each count.

    The listing is read twice: give a `store` that writes it, or it is worked out twice.
    """
    keys = list(keys)
    asked = wanted.where(F.col(part) != "").select(*keys, part).distinct()
    asked = asked.withColumn("_gram", F.explode(_grams(part, F.least(F.length(part), F.lit(GRAM)))))
    needed = asked.select(*keys, "_gram").distinct()
    grams = F.flatten(F.array(*[_grams(text, F.lit(n)) for n in range(1, GRAM + 1)]))
    listed = store(texts.withColumn("_gram", F.explode(grams)).join(needed, [*keys, "_gram"]), "listed")
    often = listed.groupBy(*keys, "_gram").agg(F.count(F.lit(1)).alias("_n"))
    rarest = (asked.join(often, [*keys, "_gram"], "left").groupBy(*keys, part)
              .agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("_n"), "_gram")).alias("_rare"))
              .where("_rare._n > 0").select(*keys, part, F.col("_rare._gram").alias("_gram")))
    hits = listed.join(rarest, [*keys, "_gram"]).where(F.contains(F.col(text), F.col(part))).drop("_gram")
    return hits.join(wanted, [*keys, part])
