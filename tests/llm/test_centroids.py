import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from corpusplan.llm import centroids


def brute(rows, k, rounds, dims, single=True):
    def code(v):
        if v is None or len(v) != dims or any(c is None or not math.isfinite(c) for c in v):
            return None
        return [math.floor(256 * Fraction(float(np.float32(c)) if single else c)) for c in v]

    vectors = [(i, c) for i, v in rows if (c := code(v)) is not None]
    starts = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), c) for i, c in vectors if i is not None)[:k]
    centers = [c for _, c in starts]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(c, m)), n) for n, m in enumerate(centers)) for _, c in vectors]

    for _ in range(rounds if centers else 0):
        best = assign()
        for n in range(len(centers)):
            own = [c for (_, c), (_, b) in zip(vectors, best) if b == n]
            if own:
                centers[n] = [sum(x) // len(own) for x in zip(*own)]
    best = assign() if centers else []
    inertia = [sum(d for d, b in best if b == n) for n in range(len(centers))]
    return sorted(((i, n, d, inertia[n], sum(inertia), ",".join(map(str, centers[n])))
                   for (i, _), (d, n) in zip(vectors, best)), key=str)


def check(spark, rows, k=6, rounds=4, dims=5, kind="float"):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, cluster string")
    got = centroids.cluster(df.repartition(3), clusters=k, rounds=rounds, dims=dims)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, k, rounds, dims, kind == "float")


def vectors(count, dims=5, seed=1):
    rng = random.Random(seed)
    return [(i, [rng.choice([-1.0, 0.25, 0.0, rng.gauss(0, 1)]) for _ in range(dims)]) for i in range(count)]


def test_against_plain_rounds(spark, monkeypatch):
    monkeypatch.setattr(centroids, "BLOCK", 16)
    rows = vectors(150)
    rows += [(300 + i, rows[3][1]) for i in range(30)]  # copies and ties
    rows += [(None, rows[0][1]), (7, rows[9][1]), (7, rows[9][1])]
    rows += [(400, None), (401, [None] * 5), (402, [math.nan] * 5), (403, [math.inf] * 5), (404, []), (405, [1.0, 2.0])]
    check(spark, rows)


def test_few_vectors_and_empty_tables(spark):
    check(spark, vectors(3))
    check(spark, [(1, [1.0] * 5)] * 8)  # all centroids but the first stay empty
    check(spark, [(None, [1.0] * 5)])
    check(spark, [(1, None)])
    check(spark, [])


def test_numbers_beyond_longs_are_exact(spark):
    rows = vectors(20) + [(100, [1e25] * 5), (101, [1e25] * 5), (102, [-3e30, 0.5, 0.0, 0.0, 0.0])]
    check(spark, rows, k=23)
    assert centroids.codes_of([1.7e308, 0.5, -0.1], 3) == [int(1.7e308) * 256, 128, -26]
    with pytest.raises(Exception, match="leaves a long"):
        check(spark, [(i, [1e25 * i] * 5) for i in range(9)], k=2)


def test_tables_gather_the_distances():
    rows = [[0, 5, -3], [0, 7, -3], [2, 5, 9]]
    block = centroids.Block(dict(zip(("ids", "has_id", "sizes", "values", "width", "places"), centroids._block([1, 2, 3], rows))), 3)
    best, distance = block.nearest([[0, 6, -3], [2, 5, 8], [0, 6, -3]])
    assert best.tolist() == [0, 0, 1] and distance.tolist() == [1, 1, 1]
    counts, sums = block.totals(best, 3)
    assert counts.tolist() == [2, 1, 0] and sums == [[0, 12, -6], [2, 5, 9], [0, 0, 0]]
