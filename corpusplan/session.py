"""Session settings and the shared scratch folder."""

import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Observation, SparkSession

import corpusplan

# Skewed joins are split at run time even where that costs one more exchange:
# one dataset, page or path may hold a third of all rows.
_RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.python.filterPushdown.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Set the runtime SQL options the plans are written for.

    Sizes (shuffle partitions, broadcast threshold, split size) stay the
    cluster's own.
    """
    for key, value in _RUNTIME_CONF.items():
        spark.conf.set(key, value)
    # task functions travel with the job, executors need no copy of the package
    cloudpickle.register_pickle_by_value(corpusplan)
    return spark


def use_source(spark: SparkSession, source: type) -> None:
    """Make a data source of this package known to the session, once."""
    known = getattr(spark, "_corpusplan_sources", set())
    if source.name() not in known:
        configure(spark)
        spark.dataSource.register(source)
        spark._corpusplan_sources = known | {source.name()}


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared folder the cluster names.

    A machine-local folder is only used when the session itself is local and
    names none.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="corpusplan-")
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Store:
    """Writes the tables between the steps of a run to one folder and reads them back.

    Each is worked out once, and what follows starts from files every executor can
    read. Named aggregates are measured while a table is written.
    """

    def __init__(self, folder: str):
        self.folder = folder
        self.measured: dict[str, dict] = {}

    def __call__(self, df: DataFrame, name: str, **measures: Column) -> DataFrame:
        path = f"{self.folder}/{name}"
        if measures:
            observation = Observation(name)
            df = df.observe(observation, *[m.alias(k) for k, m in measures.items()])
        df.write.parquet(path)
        if measures:
            self.measured[name] = observation.get
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def close(self, spark: SparkSession) -> None:
        """Remove what was written; tables read from here are gone with it."""
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
