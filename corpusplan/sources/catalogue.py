"""The catalogue of known datasets."""

from pyspark.sql import DataFrame, SparkSession

from corpusplan import known

_SCHEMA = "id string, description string, language_pairs array<string>, categories array<string>"


def list_datasets(spark: SparkSession) -> DataFrame:
    """One row per known dataset. A listing only: ids are not checked against it."""
    return spark.createDataFrame(known.CATALOGUE, _SCHEMA)
