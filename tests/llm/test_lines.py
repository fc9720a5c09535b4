import random
from collections import Counter

import numpy as np

from corpusplan.llm import lines


def brute(rows, min_docs=5, min_chars=40):
    def keys(text):
        return [lines.line_key(x) for x in (text or "").split("\n")]

    count, last = Counter(), {}
    for d, t in rows:
        for k in {k for k in keys(t) if len(k) >= min_chars}:
            count[k] += 1
            last[k] = max(last.get(k, -1 << 63), -1 << 63 if d is None else d)
    out = []
    for d, t in rows:
        own = (t or "").split("\n")
        drop = [count[k] >= min_docs and last[k] != (-1 << 63 if d is None else d) for k in keys(t)]
        out.append((d, "\n".join(x for x, g in zip(own, drop) if not g), len(own), sum(drop)))
    return sorted(out, key=str)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lines, "SHARD_KEYS", 7)  # many shards
    rng = random.Random(1)
    pool = [f"{i} common line of text that is long enough É{i}" for i in range(40)] + ["short", "", " \t", "x" * 39, "y" * 40]
    rows = [(rng.randrange(60), "\n".join(rng.choice([s, s.upper(), f" {s}\t\r"]) if s[:1] != "Z" else s
                                          for s in rng.choices(pool, k=rng.randrange(9)))) for _ in range(150)]
    rows += [(None, pool[0]), (None, pool[1] + "\n" + pool[1]), (7, None), (8, ""), (9, "\n\n"), (10, pool[3] * 500)] + rows[:20]
    docs = spark.createDataFrame([(d, t, 1, "n") for d, t in rows], "doc_id long, text string, n_lines int, shard string")
    got = lines.dedup_lines(docs.repartition(6))
    assert got.columns == ["doc_id", "text", "n_lines", "shard", "n_dropped"]
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()), key=str) == brute(rows)


def test_no_frequent_line_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a\nb"), (2, None)], "doc_id long, text string")
    assert {(r.doc_id, r.text, r.n_dropped) for r in lines.dedup_lines(docs).collect()} == {(1, "a\nb", 0), (2, "", 0)}
    assert lines.dedup_lines(docs.limit(0)).count() == 0


def test_perfect_hash_is_minimal_and_rejects_strangers():
    keys = lines.key_hashes([f"key {i}" for i in range(5000)])
    shard = lines.Shard(lines.shard_bytes(keys, np.arange(5000) + 5, np.arange(5000)))
    assert sorted(shard.hash.index(keys)) == list(range(5000))
    counts, last = shard.probe(keys)
    assert (counts == np.arange(5000) + 5).all() and (last == np.arange(5000)).all()
    assert not shard.probe(lines.key_hashes([f"other {i}" for i in range(5000)]))[0].any()
