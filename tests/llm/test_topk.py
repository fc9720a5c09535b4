import math
import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusplan.llm import topk


def brute(rows, k, every):
    def code(v):
        if v is None or any(c is None or not math.isfinite(c) for c in v):
            return None
        return [math.floor(256 * Fraction(float(np.float32(c)))) for c in v]

    codes = [(i, c) for i, v in rows if i is not None and (c := code(v)) is not None]
    queries = {}
    for i, c in codes:
        if i % every == 0:
            queries.setdefault(i, []).append(c)
    out = []
    for i, own in queries.items():
        best = sorted((-sum(a * b for a, b in zip(min(own), c)), j) for j, c in codes if j != i)[:k]
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def check(spark, rows, k=5, every=5, block=4):
    got = topk.top_k(table(spark, rows), F.col("vec_id") % every == 0, k=k, block=block).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute(rows, k, every)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BYTES", 4 * 8 * 7)  # several chunks of queries
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1.5, -.25, 0.0, .001, .25, 1.0, rng.gauss(0, 1)]) for _ in range(8)]) for i in range(120)]
    rows += [(200 + i, rows[3][1]) for i in range(30)]  # ties
    rows += [(300, None), (301, [None] * 8), (302, [float("nan")] * 8), (305, [float("inf")] * 8), (310, []), (315, [1.0, 2.0])]
    rows += [(None, rows[0][1])] + rows[7:9]
    check(spark, rows)


def test_few_candidates_and_empty_tables(spark):
    check(spark, [(0, [1.0, 2.0]), (1, [0.5, -1.0]), (5, [3.0, 0.0])])
    check(spark, [(0, [1.0])])
    check(spark, [(1, [1.0])])
    check(spark, [])


def test_large_numbers_are_exact(spark):
    check(spark, [(0, [1.0, 2.0]), (1, [70000.0, 1.0]), (2, [.5, .5]), (5, [2.0 ** 40, -3.0]), (6, [-1e7, 2.5])], every=10)
    check(spark, [(0, [1.0, 0.0]), (1, [0.0, 1e30]), (5, [0.0, 0.25]), (6, [1.5, -1e25]), (7, [0.5, 0.0])], every=10)
    rows = [(0, [1.0, 1e20]), (1, [0.0, 1e20])]
    with pytest.raises(Exception, match="leaves a long"):
        check(spark, rows)


def test_pruned_by_scores_of_blocks_before():
    rng = np.random.default_rng(0)
    blocks = []
    for b in range(50):
        codes = (rng.integers(0, 20, (8, 6)) + (200 if b == 7 else 0)).astype(np.int32)
        blocks.append((np.arange(8) + 8 * b, codes))
    scores, ids = np.full((1, 3), topk._WORST), np.full((1, 3), topk._NOBODY)
    query = np.array([-1]), np.ones((1, 6), np.int32)
    assert topk.Shard(blocks, 6).search(*query, scores, ids) <= 2 and set(ids[0]) <= set(range(56, 64))
    before = ids.copy()
    assert topk.Shard(blocks[8:], 6).search(*query, scores, ids) == 0 and (ids == before).all()


def test_a_task_returns_k_rows_a_query(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(600)]
    packed = topk._packed(table(spark, rows).selectExpr("vec_id AS id", "embedding AS v").coalesce(1), 8, 4)
    packed.write.parquet(f"{tmp_path}/b")
    topk._packed(table(spark, rows[:50]).selectExpr("vec_id AS id", "embedding AS v").coalesce(1), 8, 20).write.parquet(f"{tmp_path}/q")
    files = [[f"file:{f}" for f in sorted((tmp_path / n).glob("*.parquet"))] for n in "qb"]
    monkeypatch.setattr(topk, "_TOGETHER", 100)
    pairs = pa.RecordBatch.from_arrays([pa.array([0])], ["pair"])
    out = [r for batch in topk._searched([pairs], *files, 8, 5) for r in batch.to_pylist()]
    want = brute(rows, 5, 1)
    assert sorted((r["query_id"], r["vec_id"], r["score"]) for r in out) == sorted((q, v, s) for q, _, v, s in want if q < 50)
