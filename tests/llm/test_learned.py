"""Operators that learn: held-out accuracy, and odd rows."""

import math
import random
import re
import zlib

from corpusplan.llm import quality, toxicity
from corpusplan.llm.common import held_out

SF = "/root/testdata/sf0.01"


def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def odd(spark):
    rows = [(None, "some text.", "x", 1), (1, None, "x", 2), (1, "", "y", 3), (2, "word " * 20000, "z", 4), (3, "\0 \n\n ?!", "z", 5)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, predicted int")


def accuracy(scored, labels, name, kind):
    rows = scored.join(labels, "doc_id").where(held_out()).select(name, kind).collect()
    return sum(r[0] == r[1] for r in rows) / len(rows)


def test_held_out_rule(spark):
    ids = spark.createDataFrame([(i,) for i in range(50)], "doc_id long")
    for r in ids.select("doc_id", held_out().alias("h")).collect():
        assert r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_toxicity(spark):
    docs, labels = tables(spark)
    model = toxicity.train(docs, labels)
    scored = toxicity.score(docs, model)
    assert accuracy(scored, labels, "predicted", "toxic") > 0.93
    for r in scored.where("n_offending > 0").limit(20).collect():
        for span in r.offending.split():
            start, end = map(int, span.split("-"))
            assert model.sentence(r.text[start:end]) >= 0.5
    out = toxicity.score(odd(spark), model).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert toxicity.score(odd(spark).limit(0), model).count() == 0
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == scored.where("predicted = 0").count()


def test_noisy_or_finds_the_words_that_make_a_document_toxic():
    rng = random.Random(0)
    rows = []
    for n in range(400):
        y = n % 4 == 0
        bags = [[rng.randrange(1, 20)] for _ in range(5)]
        if y:
            bags[2] = [0, rng.randrange(1, 20)]
        rows.append((int(y), bags))
    weights, bias, leak = toxicity.fit_bags(rows, 20)
    model = toxicity.Model({f"w{i}": w for i, w in enumerate(weights)}, bias, leak)
    assert model.sentence("w0 here") > 0.9 and max(model.sentence(f"w{i}") for i in range(1, 20)) < 0.1
    score, spans = model.document("fine w3. Then w0 came! and w5")
    assert score > 0.9 and [s[:2] for s in spans] == [(8, 22)]


def test_quality(spark):
    docs, labels = tables(spark)
    rules = quality.train(docs, labels)
    assert 0 < len(rules.rules) < 400
    scored = quality.score(docs, rules)
    assert scored.columns == [*docs.columns, "score", "predicted"]
    assert accuracy(scored, labels, "predicted", "quality") > 0.93
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    out = quality.score(odd(spark), rules).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert quality.score(odd(spark).limit(0), rules).count() == 0


def test_labels_of_one_kind_or_none(spark):
    docs = odd(spark)
    for labels in ("0", "1", "NULL"):
        one = spark.sql(f"SELECT id AS doc_id, CAST({labels} AS INT) AS toxic, CAST({labels} AS INT) AS quality FROM range(4) "
                        "UNION ALL SELECT NULL, 1, 1")
        share = 1.0 if labels == "1" else 0.0
        scores = {r.score for r in toxicity.score(docs, toxicity.train(docs, one)).collect()}
        assert len(scores) == 1 and abs(scores.pop() - share) <= 0.02
        assert len({r.score for r in quality.score(docs, quality.train(docs, one)).collect()}) == 1


def test_toxicity_scores_by_the_plain_formula(spark):
    docs, labels = tables(spark)
    model = toxicity.train(docs, labels)
    for r in toxicity.score(docs, model).limit(60).collect():
        clean = 1 - model.leak
        for a, b in toxicity.sentences(r.text or ""):
            own = [model.weights[f] for f in toxicity.features(r.text[a:b]) if f in model.weights]
            if own:
                clean *= 1 - 1 / (1 + math.exp(-model.bias - sum(own)))
        assert abs(r.score - (1 - clean)) < 1e-9


def test_no_small_change_of_the_fit_is_likelier():
    rng = random.Random(1)
    rows = [(rng.randrange(2), [rng.sample(range(6), 2) for _ in range(rng.randrange(4))]) for _ in range(80)]
    weights, bias, leak = toxicity.fit_bags(rows, 6)

    def likelihood(w, b, log_leak):
        total = -toxicity.L2 / 2 * sum(x * x for x in w)
        for y, bags in rows:
            clean = 1 - math.exp(log_leak)
            for bag in bags:
                clean *= 1 - 1 / (1 + math.exp(-b - sum(w[f] for f in bag)))
            total += math.log(max(1e-9, 1 - clean)) if y else math.log(clean)
        return total

    best = likelihood(weights, bias, math.log(leak))
    for _ in range(200):
        near = [x + rng.gauss(0, .05) for x in weights]
        other = likelihood(near, bias + rng.gauss(0, .05), min(math.log(leak) + rng.gauss(0, .05), math.log(.2)))
        assert other < best + .02


def test_quality_scores_by_the_plain_rules(spark):
    docs, labels = tables(spark)
    rules = quality.train(docs, labels)
    stats, names = quality._with_statistics(docs.limit(80), "text")
    scored = {r.doc_id: r.score for r in quality.score(docs, rules).select("doc_id", "score").collect()}
    for r in stats.select("doc_id", "text", *names).collect():
        z = rules.base + sum(w for path, w in rules.rules if all(
            (r[names[f]] > t) == above for f, above, t in path))
        assert abs(scored[r.doc_id] - 1 / (1 + math.exp(-z))) < 1e-9
        # the statistics themselves, counted another way
        text = r.text or ""
        words = [w for w in re.split("[ \t\n\r]+", text) if w]
        assert r._stat_chars == len(text) and r._stat_words == len(words)
        if words:
            assert abs(r._stat_distinct_words - len(set(words)) / len(words)) < 1e-12
            assert abs(r._stat_commas - text.count(",") / len(words)) < 1e-12
            assert abs(r._stat_digits - sum(c in "0123456789" for c in text) / len(text)) < 1e-12
