import random
from collections import defaultdict

import xxhash

from pyspark.sql import functions as F

from corpusplan.llm import simhash
from corpusplan.session import Store, shared_dir


def brute(rows):
    def fp(text):
        w = (text or "").encode().lower().split()
        if not w:
            return 0
        s = [b" ".join(w)] if len(w) < 3 else [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)]
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))

    prints = [fp(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    low = defaultdict(lambda: None)
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            low[r] = d if low[r] is None else min(d, low[r])
    return sorted(((d, format(p, "016x"), low[find(i)]) for i, (d, p) in enumerate(zip((r[0] for r in rows), prints))), key=str)


def test_against_brute_force(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "Gamma", "ÄÖ", "delta", "eps"]
    base = [" ".join(rng.choices(words, k=400)) for _ in range(4)]
    rows, n = [(None, "lonely text"), (900, None), (901, ""), (902, " \t\n"), (903, "one"), (904, "one two"), (905, "ONE  two")], 0
    for b in base:
        for _ in range(40):
            w = b.split(" ")
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((800 - n, " ".join(w)))
            n += 1
    rows += rows[10:20] + [(None, base[0])]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, fp string, component_id int")
    got = simhash.near_duplicates(docs.repartition(5)).collect()
    assert sorted(((r.doc_id, format(r.fp % (1 << 64), "016x"), r.component_id) for r in got), key=str) == brute(rows)
    left = {r.doc_id for r in simhash.keep_one(docs).collect()}
    assert left == {c for d, _, c in brute(rows) if d is not None} | {None}


def test_links_of_every_split_of_the_distance(spark):
    rng = random.Random(5)
    values = {rng.getrandbits(64) - (1 << 63) for _ in range(30)}
    for v in list(values):
        flipped = v
        for b in rng.sample(range(64), rng.randrange(1, 5)):
            flipped ^= 1 << b if b < 63 else -1 << 63
        values.add(flipped)
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    want = {(min(a, b), max(a, b)) for a in values for b in values if a != b and ((a ^ b) % (1 << 64)).bit_count() <= 3}
    assert want
    for segments in (2, 4):
        got = {(min(r.a, r.b), max(r.a, r.b)) for r in simhash.links(df, 3, segments).collect()}
        assert got == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0 and simhash.keep_one(docs).count() == 0


def test_values_that_many_share_are_divided(spark):
    rng = random.Random(8)
    values = set()
    for half in (0, 1):  # one half is the same in all, the other is random, and some are neighbours
        for _ in range(400):
            v = rng.getrandbits(32) << 32 * half
            values.add(v)
            if rng.random() < .2:
                for b in rng.sample(range(64), rng.randrange(1, 4)):
                    v ^= 1 << b
                values.add(v)
    signed = [v - (1 << 64) if v >= 1 << 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    want = {(min(a, b), max(a, b)) for a in signed for b in signed if a < b and ((a ^ b) % (1 << 64)).bit_count() <= 3}
    for segments in (2, 4):
        store = Store(shared_dir(spark, "hot"))
        found = simhash.links(df, 3, segments, store, hot=20)
        assert store.measured["hot"]["n"] >= 2
        assert {(min(r.a, r.b), max(r.a, r.b)) for r in found.collect()} == want != set()
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") >= 1
    # what a join of whole values would compare, and what is compared
    pairs = df.crossJoin(df.withColumnRenamed("fp", "b")).where("fp < b AND shiftrightunsigned(fp, 32) = shiftrightunsigned(b, 32)").count()
    probes = simhash.segments_of(df, 2, 3).where("seg = 1")
    at = probes.select("fp", "key", F.explode("pieces").alias("at")).select("fp", "key", "at.*")
    divided = at.groupBy("key", "piece", "value").agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0]
    assert divided < pairs / 10
