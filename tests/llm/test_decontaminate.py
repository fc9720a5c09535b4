import random

from hypothesis import given, settings, strategies as st

from corpusplan.llm import decontaminate as dc


def sellers(pattern, text):
    """Smallest edit distance of the pattern to any part of the text, by the full table."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern):
            new.append(min(row[i] + (p != c), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, row[-1])
    return best


@given(st.text("abc", min_size=1, max_size=80), st.text("abc", max_size=120))
@settings(max_examples=200, deadline=None)
def test_bit_parallel_distance(pattern, text):
    best = sellers(pattern, text)
    found = dc.best_match(pattern, text, len(pattern))
    assert found[0] == best
    assert sellers(pattern, text[:found[1]]) == best and (not found[1] or sellers(pattern, text[:found[1] - 1]) > best)
    assert dc.best_match(pattern, text, best - 1) is None


def test_against_brute_force(spark):
    rng = random.Random(9)
    words = ["alpha", "beta", "Gamma", "delta", "Épsilon", "zeta", "eta"]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(3, 30)))) for i in range(12)]
    items += [(90, None), (91, " \n "), (92, items[0][1])]
    docs = [(None, "alpha"), (1, None), (2, ""), (3, "x" * 5000)]
    for d in range(40):
        item = list(rng.choice(items[:12])[1])
        for _ in range(rng.randrange(9)):
            item[rng.randrange(len(item))] = rng.choice("xyz ")
        docs.append((10 + d, " ".join(rng.choices(words, k=20)) + "\n\n" + "".join(item).upper() + "  " + " ".join(rng.choices(words, k=9))))
    docs += docs[5:8]
    table = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for d, t in docs:
        for i, item in items[:12]:
            clean = dc.normal(item)
            distance = sellers(clean, dc.normal(t or ""))
            if distance <= int(dc.ERROR_RATE * len(clean)):
                want.append((d, i, distance))
    for block in (1 << 20, 50):
        got = dc.leaks(table.repartition(3), bench, block_chars=block).collect()
        assert sorted(((r.doc_id, r.item_id, r.distance) for r in got), key=str) == sorted(want, key=str)
        for r in got:
            part = dc.normal(next(t for d, t in docs if d == r.doc_id)[r.start:r.end])
            item = dc.normal(dict(items)[r.item_id])
            assert sellers(item, part) == r.distance and abs(len(part) - len(item)) <= r.distance
        left = dc.drop_leaks(table, bench, block_chars=block)
        assert left.columns == table.columns
        assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(d) for d, _ in docs if d not in {w[0] for w in want})


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.leaks(docs, none).count() == 0 and dc.drop_leaks(docs, none).count() == 1
    assert dc.leaks(docs.limit(0), none).count() == 0
