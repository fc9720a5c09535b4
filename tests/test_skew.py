"""One key holding most of the rows: results stay whole, work stays spread."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusplan import standard_families
from corpusplan.functions.skew import mark_alone, mark_first, spread_lookup
from corpusplan.operators import requests as req


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    return [(rng.choice(["hot"] * 3 + [f"k{i}" for i in range(6)]), rng.randrange(50), i) for i in range(3000)] + [
        ("alone", 1, -1)]


def test_mark_first(spark, rows):
    df = spark.createDataFrame(rows, "k string, v int, id int")
    marked = mark_first(df, ["k"], [F.asc("v"), F.asc("id")], "first", spread=["id"], parts=16)
    first = {k: min((v, i) for kk, v, i in rows if kk == k) for k in {r[0] for r in rows}}
    got = {(r.k, (r.v, r.id)) for r in marked.where("first").collect()}
    assert got == set(first.items())
    assert marked.count() == len(rows)


def test_mark_alone(spark, rows):
    df = spark.createDataFrame(rows, "k string, v int, id int")
    marked = mark_alone(df, ["k"], "only", spread=["id"], parts=16)
    assert [r.k for r in marked.where("only").collect()] == ["alone"]
    assert marked.count() == len(rows)
    same = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1)], "k string, id int")
    assert [r.k for r in mark_alone(same, ["k"], "only", spread=["id"]).where("only").collect()] == ["b"]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_lookup(spark, rows, how):
    left = spark.createDataFrame(rows, "k string, v int, id int")
    right = spark.createDataFrame([("hot", "x"), ("k1", "y"), ("none", "z")], "k string, w string")
    spread = spread_lookup(left, right, ["k"], how, spread=["id"], parts=8)
    plain = left.join(right, ["k"], how)
    assert Counter(map(tuple, spread.collect())) == Counter(map(tuple, plain.collect()))


def test_hot_key_is_shared_by_tasks(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        left = spark.range(40000).select(F.lit("hot").alias("k"), "id")
        right = spark.createDataFrame([("hot", 1)], "k string, w int")
        joined = spread_lookup(left, right, ["k"], "inner", spread=["id"], parts=64)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) > 4 and max(sizes) < 20000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_a_hot_dataset_is_split_at_run_time(spark):
    """A third of all requests ask for one dataset: its join partition is divided."""
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20kb",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10kb",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    asked = spark.range(0, 90000, 1, 8).selectExpr(
        "CAST(id AS INT) AS req_id",
        "CASE WHEN id % 3 = 0 THEN 'europarl-v1' ELSE 'europarl-v' || (id % 5000 + 2) END AS dataset_id",
        "CAST(NULL AS STRING) AS language_pair", "CAST(NULL AS STRING) AS category",
        "CAST(NULL AS STRING) AS target_dir", "FALSE AS has_target_dir")
    anchors = spark.range(0, 10002, 1, 8).selectExpr(
        "'http://statmt.org/europarl/v' || (id % 5001 + 1) || '/' AS page_url", "CAST(id AS INT) AS pos",
        "'l' || id || '-en-train.tgz' AS href")
    for key, value in small.items():
        spark.conf.set(key, value)
    try:
        plan = req.plan_batch(asked, anchors, standard_families())
        total = plan.agg(F.count("url").alias("n"), F.bit_xor(F.xxhash64("req_id", "output_path", "url")))
        assert total.collect()[0].n == 180000
        assert "SortMergeJoin(skew=true)" in total._jdf.queryExecution().executedPlan().toString()
    finally:
        for key in small:
            spark.conf.unset(key)
