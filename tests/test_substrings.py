import random

import pytest
from pyspark.sql import functions as F

from corpusplan.operators import families as fam, requests as req
from corpusplan.operators.substrings import containing
from corpusplan.session import Store, shared_dir
from helpers import anchors, requests, values


def test_against_all_pairs(spark):
    rng = random.Random(3)

    def word(longest):
        return "".join(rng.choice("abé%_.") for _ in range(rng.randrange(longest)))

    texts = [(rng.choice("xy"), n, word(12)) for n in range(300)] + [("x", 900, None), ("x", 901, ""), ("z", 902, "ab")]
    texts += texts[:5]
    parts = [(rng.choice("xyw"), n, word(6)) for n in range(200)] + [("x", 900, None), ("x", 901, "")]
    parts += parts[:5]
    left = spark.createDataFrame(texts, "k string, t int, text string")
    right = spark.createDataFrame(parts, "k string, w int, part string")
    got = containing(left, right, ["k"], "text", "part").select("t", "w").collect()
    want = [(t, w) for k, t, a in texts for j, w, b in parts if a and b and k == j and b in a]
    assert want and sorted(map(tuple, got)) == sorted(want)
    assert containing(left.limit(0), right, ["k"], "text", "part").count() == 0
    assert containing(left, right.limit(0), ["k"], "text", "part").count() == 0


PAGES = {
    "http://statmt.org/europarl/v7/": ["de-en-train.tgz", "fr-en-train.tgz", "x", "en-train.tgz"],
    "http://data.statmt.org/news-commentary/v15/training/": ["news-commentary-v15.de-en.tsv", "news-commentary-v15.fr-en.tsv.gz"],
    "http://statmt.org/wmt14/": ["training-a/", "training-b/", "test/", "other"],
    "http://statmt.org/wmt14/training-b/": ["b.gz"], "http://statmt.org/wmt14/test/": ["t.gz"], "http://statmt.org/wmt14/other/": ["o.gz"],
}
ASKED = [("europarl-v7", {"language_pair": p}) for p in ("", "en", "de-en", "e", "zz", "de-en-train.tgz.")] + [
    ("news-commentary-v15", {"language_pair": p}) for p in ("", "de-en", "en")] + [
    ("wmt14", {"category": c}) for c in ("", "training", "test", "oth", "zzz")] + [("un-corpus", {})]


@pytest.mark.parametrize("few", [0, 2, 1000])
def test_looked_up_or_compared_links_are_the_same(spark, monkeypatch, few):
    asked = requests(spark, *ASKED)
    plain = req.match_files(*req.answer(asked, anchors(spark, PAGES), fam.standard_families()))
    monkeypatch.setattr(fam.link_index, "__defaults__", (fam.lazy, few))
    store = Store(shared_dir(spark, "few"))
    looked_up = req.match_files(*req.answer(asked, anchors(spark, PAGES), fam.standard_families(), store))
    columns = ["req_id", "url", "filename", "language_pair", "category", "description", "pos"]
    assert values(looked_up, *columns) == values(plain, *columns) != []


def test_a_hot_page_costs_what_it_hits(spark):
    """Ten thousand links and ten thousand filters of one page, a hit each."""
    n = 10_000
    links = spark.range(n).select(F.lit("http://statmt.org/europarl/v7/").alias("page_url"), F.col("id").cast("int").alias("pos"),
                                  F.concat(F.lit("c"), F.lpad(F.hex(F.xxhash64("id")), 16, "0"), F.lit("-en-train.tgz")).alias("href"))
    asked = spark.range(n).select(
        F.col("id").cast("int").alias("req_id"), F.lit("europarl-v7").alias("dataset_id"),
        F.concat(F.lpad(F.hex(F.xxhash64("id")), 16, "0"), F.lit("-en")).alias("language_pair"), F.lit(None).cast("string").alias("category"),
        F.lit(None).cast("string").alias("target_dir"), F.lit(False).alias("has_target_dir"))
    store = Store(shared_dir(spark, "hot"))
    counted = {}

    def counting(df, name):
        out = store(df, name, rows=F.count(F.lit(1)))
        counted[name] = store.measured[name]["rows"]
        return out

    matched = req.match_files(*req.answer(asked, links, fam.standard_families(), counting))
    rows = matched.select("req_id", "pos").collect()
    assert len(rows) == n and all(r.req_id == r.pos for r in rows)
    assert counted["listed"] < 40 * n  # a listing of each link under its substrings, no pairs of all with all
    plan = matched._jdf.queryExecution().optimizedPlan().toString()
    assert "want_pair" not in "".join(line for line in plan.splitlines() if "Join Inner" in line and " OR " in line)
