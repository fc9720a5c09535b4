import hashlib
import random

import numpy as np
from hypothesis import given, settings, strategies as st

from corpusplan.llm import suffix


def brute(rows, length):
    """rows: (id, text) with distinct ids."""
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: -1 << 63 if r[0] is None else r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if b[s:s + length] in seen:
                gone[s:s + length] = b"\1" * length
            seen.add(b[s:s + length])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[d] = (kept, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def texts(rng):
    passages = [bytes(rng.choices(b"abcdefgh \xc3\xa9".replace(b"\xc3\xa9", b"ij"), k=rng.randrange(10, 90))).decode() for _ in range(12)]
    rows = [(None, passages[0] * 3), (0, None), (1, ""), (2, "a" * 400), (3, "ab" * 150), (4, "\0" * 50), (5, "é" * 120)]
    for i in range(120):
        parts = [rng.choice(passages) if rng.random() < .7 else "".join(rng.choices("xyzäw \n", k=rng.randrange(40)))
                 for _ in range(rng.randrange(8))]
        rows.append((10 + (i * 37) % 120, "".join(parts)))
    rows += [(500 + i, passages[1] + "".join(rng.choices("pqr", k=9)) + passages[2] * 2) for i in range(60)]
    return rows


def test_against_brute_force(spark):
    for seed, (length, gram, block) in enumerate([(20, 8, 50), (24, 16, 100_000), (33, 8, 7)]):
        rows = texts(random.Random(seed))
        docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n_spans int, _text string")
        got = suffix.remove_repeats(docs.repartition(5), length=length, gram=gram, block_windows=block).collect()
        want = brute(rows, length)
        assert len(got) == len(rows)
        for r in got:
            assert (bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], (length, r.doc_id)


def test_rows_repeating_an_id_keep_their_text(spark):
    text = "".join(random.Random(1).choices("abcdef", k=300))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in suffix.remove_repeats(docs).collect()) == [(1, 0), (1, 0), (2, 300)]
    assert suffix.remove_repeats(docs.limit(0)).count() == 0


def test_texts_of_one_id_are_told_apart(spark):
    rng = random.Random(9)

    def words(n):
        return "".join(rng.choices("abcdefgh", k=n))

    for doc_id in (None, 7):
        shared, own, same_start = words(120), words(200), words(130)
        a, b = shared + own, words(50) + shared  # the run at byte 50 of b is none of a's
        c, d = same_start + words(9) + "1", same_start + words(9) + "2"
        rows = [(doc_id, t) for t in (a, b, c, d)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = sorted((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept).decode()) for r in suffix.remove_repeats(docs).collect())
        kept = {k for _, _, _, k in got}
        assert (a in kept and b[:50] in kept) or (b in kept and own in kept)
        assert (c in kept and d[130:] in kept) or (d in kept and c[130:] in kept)
        assert sum(n for _, n, _, _ in got) == 250 and sum(n for _, _, n, _ in got) == 2


@given(st.binary(max_size=60).map(lambda b: bytes(x % 3 for x in b)))
@settings(max_examples=100, deadline=None)
def test_previous_factors(data):
    order = sorted(range(len(data)), key=lambda i: data[i:])

    def common(a, b):
        n = 0
        while a + n < len(data) and b + n < len(data) and data[a + n] == data[b + n]:
            n += 1
        return n

    shared = [0] + [common(a, b) for a, b in zip(order, order[1:])]
    got = suffix.previous_factors(order, shared)
    for at, i in enumerate(order):
        assert got[at] == max((common(i, j) for j in range(i)), default=0)


def test_anchors_cover_every_window_once_and_agree():
    rng = random.Random(2)
    shared = bytes(rng.choices(range(256), k=400))
    parts = [bytes(rng.choices(range(256), k=n)) + shared for n in (0, 5, 130, 70_000)] + [b"short"]
    found = {}
    for doc, start, count, keys in suffix.anchors(parts):
        for d, s, n, k in zip(doc.tolist(), start.tolist(), count.tolist(), keys.tolist()):
            for w in range(s, s + n):
                assert (d, w) not in found
                found[d, w] = k
    assert len(found) == sum(max(0, len(p) - 99) for p in parts)
    for w in range(301):
        assert len({found[d, len(p) - 400 + w] for d, p in enumerate(parts[:4])}) == 1


def test_filter_has_no_false_negatives():
    keys = np.random.default_rng(0).integers(0, 1 << 63, 2000, dtype=np.uint64)
    words = np.zeros(500, np.uint64)
    word, bits = suffix.Filter.place(keys, 500)
    np.bitwise_or.at(words, word.astype(np.int64), bits)
    assert suffix.Filter(words).holds(keys).all()
    others = np.random.default_rng(1).integers(0, 1 << 63, 2000, dtype=np.uint64)
    assert suffix.Filter(words).holds(others).mean() < 0.2


def test_classes_of_grams_change_nothing(spark, monkeypatch):
    rows = texts(random.Random(7))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keys = docs.selectExpr("xxhash64(doc_id) AS k")
    assert len(suffix.passes(keys, len(rows))) == 1
    monkeypatch.setattr(suffix, "FILTER_WORDS", 64)
    held = np.array([r.k for r in keys.collect()], np.int64).view(np.uint64)
    found = [p.holds(held) for p in suffix.passes(keys, 700)]
    assert len(found) == 3 and (np.sum(found, axis=0) == 1).all() and all(f.any() for f in found)
    want = brute(rows, 20)
    got = {r.doc_id: tuple(r[c] for c in ("kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"))
           for r in suffix.remove_repeats(docs, length=20, gram=8, block_windows=50).collect()}
    assert {d: (bytes(k), *rest) for d, (k, *rest) in got.items()} == want
