import hashlib
import random
import zlib

import numpy as np

from corpusplan.llm import periods, queries


def brute(w, least_periods=4, least_words=6):
    """Runs by trying every period at every place; of one stretch only the smallest period counts."""
    n, out = len(w), []
    for q in range(1, n // least_periods + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if (size := i - s + q) >= max(least_words, least_periods * q):
                part = w[s:s + size]
                if all(any(a != b for a, b in zip(part, part[p:])) for p in range(1, q)):
                    out.append((s, size, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def word_lists(count, longest=70):
    rng = random.Random(5)
    for _ in range(count):
        n = rng.randrange(longest)
        w = [rng.randrange(1, rng.choice([1, 2, 3, 8, 30]) + 1) for _ in range(n)]
        for _ in range(rng.randrange(4) if n else 0):
            p, s = rng.randrange(1, 9), rng.randrange(n)
            for i in range(s + p, min(n, s + rng.randrange(1, p * 7 + 2))):
                w[i] = w[i - p]
        yield w


def test_all_runs_and_long_ones_against_brute_force():
    for w in word_lists(1500):
        assert periods.all_runs(w) == brute(w, 2, 2)
        assert periods.runs_of([b"%d" % x for x in w]) == brute(w)


def test_stretches_hold_every_run_whatever_the_passes(monkeypatch):
    monkeypatch.setattr(periods, "NARROWING", 1)
    for w in word_lists(300):
        assert periods.runs_of([b"%d" % x for x in w]) == brute(w)
        cover = periods.windows(np.array(w, np.int64)) if w else []
        assert all(any(a <= max(0, s - 1) and b >= min(len(w), s + n + 1) for a, b in cover) for s, n, _ in brute(w))


def test_common_extensions():
    for w in word_lists(60):
        if len(w) > 1:
            tree = periods.SuffixTree(w)
            a, b = (x.ravel() for x in np.meshgrid(np.arange(len(w) + 1), np.arange(len(w) + 1)))
            a, b = a[a != b], b[a != b]
            want = [next((k for k in range(len(w)) if w[i + k:i + k + 1] != w[j + k:j + k + 1] or i + k >= len(w)), len(w))
                    for i, j in zip(a, b)]
            assert tree.lce(a, b).tolist() == want
            assert tree.leaves == sorted(range(len(w) + 1), key=lambda i: w[i:])


def test_strongest_and_kept():
    assert periods.strongest([]) is None
    assert periods.strongest([(0, 9, 2), (20, 18, 4), (50, 9, 2)]) == (0, 9, 2)
    assert periods.strongest([(0, 8, 2), (3, 13, 3)]) == (3, 13, 3)
    words = [b"x", *[b"a", b"b"] * 4, b"y"]
    assert periods.kept(words, periods.runs_of(words)) == [b"x", b"a", b"b", b"y"]
    # two runs that overlap
    words = list(b"aaaaaabaaaaaabaaaaaabaaaaaab")
    words = [bytes([c]) for c in words]
    runs = periods.runs_of(words)
    assert runs == brute(words) and len(runs) == 5
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    assert periods.kept(words, runs) == [w for i, w in enumerate(words) if i not in gone]


def expected(doc_id, text):
    words = queries.made_periodic(doc_id, (text or "").encode().split())
    runs = brute(words)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    rest = b" ".join(w for i, w in enumerate(words) if i not in gone)
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    return (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(rest).hexdigest())


def test_rewritten_words():
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0]
    assert ids
    words = [b"%d" % i for i in range(100)]
    for i in ids:
        out, g = queries.made_periodic(i, words), zlib.crc32(str(i).encode()) // 10
        a = g % 100
        p = 1 + (100 - a) // (3 + g % 8)
        assert out == [words[j] if j < a else words[a + (j - a) % p] for j in range(100)]
    assert queries.made_periodic(ids[0], []) == []
    assert queries.made_periodic(None, words) == words


def test_the_query(spark, tmp_path):
    ten = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 10 == 0][:40]
    rows = [(i, " ".join(map(str, w)), 1) for i, w in zip([*ten, *range(3000, 3060)], word_lists(100))]
    rows += [(5000, None, 1), (5001, "", 1), (5002, " \t\n", 1), (5003, "a" * 9, 1), (5003, "a a a a a a", 1), (5003, "a a a a a a", 1),
             (None, "b b b b b b", 1), (5004, "é\x85é é é é é é", 1), (5005, "ha " * 3000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_runs int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op13_periodic_runs(spark, str(tmp_path)).collect()
    names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(((r.doc_id, *(r[n] for n in names)) for r in got), key=str) == sorted(((d, *expected(d, t)) for d, t, _ in rows), key=str)
    full = periods.collapse_runs(docs.where("doc_id = 5003"))
    assert sorted(r.collapsed for r in full.collect()) == ["a", "a", "a" * 9]
    assert periods.collapse_runs(docs.limit(0)).count() == 0
