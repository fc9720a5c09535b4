"""Helpers shared by the operators: Arrow maps that keep columns, stores, components."""

import sys
import types
from collections.abc import Callable
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

import corpusplan
from corpusplan.functions.skew import spread_lookup
from corpusplan.session import Store, shared_dir

# Texts are long: fewer rows per Arrow batch keep a worker's memory small.
BATCH_ROWS = "1000"


_watched: list[list[Store]] = []


def store_of(spark: SparkSession, name: str) -> Store:
    """A fresh folder under the shared folder, for the tables between steps."""
    corpusplan.configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    store = Store(shared_dir(spark, name))
    for made in _watched:
        made.append(store)
    return store


@contextmanager
def steps_removed(spark: SparkSession):
    """Remove at the end the folders of operators used inside: what they returned must be written by then."""
    made: list[Store] = []
    _watched.append(made)
    try:
        yield
    finally:
        _watched.pop()
        for store in made:
            store.close(spark)


def with_columns(df: DataFrame, added: str, work: Callable[[], Callable]) -> DataFrame:
    """Add columns worked out batch by batch in Python; the other columns pass through.

    `added` is a schema. `work()` is called once per task and returns a function from
    a record batch to one list per added column, or to (lists, mask of rows to keep).
    A column of the same name is replaced.
    """
    new = T.StructType.fromDDL(added) if added else T.StructType([])
    kept = [f for f in df.schema.fields if f.name not in new.fieldNames()]
    schema = T.StructType([*kept, *new.fields])
    kept_names, all_names = [f.name for f in kept], schema.fieldNames()

    def run(batches):
        step = work()
        for batch in batches:
            values = step(batch)
            mask = None
            if isinstance(values, tuple):
                values, mask = values
            types = [_ARROW[f.dataType.simpleString()] for f in new.fields]
            columns = [batch.column(n) for n in kept_names] + [
                v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip(values, types)]
            out = pa.RecordBatch.from_arrays(columns, names=all_names)
            yield out if mask is None else out.filter(pa.array(mask, pa.bool_()))

    return df.mapInArrow(run, schema)


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(),
          "boolean": pa.bool_(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}


def kept_by_worker(key: tuple, make: Callable):
    """What `make()` returned in this worker process first, so that its later tasks start with it.

    Task functions bring their own copies of this package's modules, so it is held beside them. A
    worker keeps only the last key's object.
    """
    memory = sys.modules.setdefault("_corpusplan_worker", types.ModuleType("_corpusplan_worker"))
    if getattr(memory, "key", None) != key:
        memory.value, memory.key = make(), key
    return memory.value


def free_names(df: DataFrame, *names: str) -> list[str]:
    """These names, each with as many lines behind it as it takes to be no column of the table."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """A text column as strings, null as the empty text."""
    return [t or "" for t in batch.column(column).to_pylist()]


def components(store: Store, links: DataFrame, name: str, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected links (a, b): rows (node, root), root the smallest node.

    Alternates large-star and small-star steps, each written to the shared folder, until
    the links no longer change. A node with very many links is spread over tasks, and
    links are only ever compared with a minimum, never gathered.
    """
    before = None
    links = store(links.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    for n in range(1, max_rounds):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = (spread_lookup(both.where("b > a"), low, ["a"], "inner", ["b"])
                 .select(F.col("b").alias("a"), F.col("low").alias("b")))
        # links from a node to its new minimum keep it in its component
        large = large.unionByName(low.where("low < a").select("a", F.col("low").alias("b"))).distinct()
        large = store(large, f"{name}-{n}-large")
        down = large.groupBy("a").agg(F.min("b").alias("low"))
        small = (spread_lookup(large.where("b < a"), down, ["a"], "inner", ["b"])
                 .where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")))
        small = small.unionByName(down.select("a", F.col("low").alias("b"))).where("a <> b").distinct()
        links = store(small, f"{name}-{n}", rows=F.count(F.lit(1)),
                      digest=F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40))))
        now = store.measured[f"{name}-{n}"]
        if now == before or not now["rows"]:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def held_out(id_col: str = "doc_id"):
    """True for the fifth of the documents whose labels are never learned from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, text: str, id_col: str, limit: int) -> DataFrame:
    """(id, text, label) of a hash sample, `limit` rows expected at most, of the labelled rows to learn from.

    An id labelled twice counts once, with its larger label; of several texts of an id the one with the smallest hash counts.
    """
    usable = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    share = min(1.0, limit / max(1, usable.count()))
    picked = (usable.where(F.pmod(F.xxhash64(F.lit(label), id_col), F.lit(1 << 30)) < int(share * (1 << 30)))
              .groupBy(id_col).agg(F.max(label).alias("label")))
    # of bounded size by the threshold, so it may be broadcast
    return (docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
            .join(F.broadcast(picked.withColumnRenamed(id_col, "id")), "id")
            .groupBy("id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.max("label").alias("label")))
