import pytest

from corpusplan import standard_families
from corpusplan.operators import collisions, requests as req
from corpusplan.plans.acquire import plan_from_pages
from helpers import anchors, requests, values

STANDARD = standard_families()
EUROPARL = "http://statmt.org/europarl/v7/"
WMT = "http://statmt.org/wmt14/"
PAGES = {
    EUROPARL: ["de-en-train.tgz", "fr-en-train.tgz"],
    WMT: ["test/", "training-parallel/"],
    WMT + "test/": ["one.tgz"],
    WMT + "training-parallel/": ["one.tgz", "two.gz"],
}


def batch(spark, *rows):
    return req.plan_batch(requests(spark, *rows), anchors(spark, PAGES), STANDARD)


def test_target_dir_missing_empty_given(spark):
    rows = [("europarl-v7", {"language_pair": "de"}), ("europarl-v7", {"language_pair": "de", "target_dir": ""}),
            ("europarl-v7", {"language_pair": "de", "target_dir": "t"}),
            ("europarl-v7", {"language_pair": "de", "target_dir": "/abs"}),
            ("europarl-v7", {"language_pair": "de", "target_dir": None}),
            ("un-corpus-v1.0", {"target_dir": ""})]
    assert [r.output_path for r in batch(spark, *rows).orderBy("req_id").collect()] == [
        "./data/europarl-v7/de-en-train.tgz", "./data/parallel/de-en/de-en-train.tgz", "./data/t/de-en-train.tgz",
        "/abs/de-en-train.tgz", "./data/parallel/de-en/de-en-train.tgz",
        "./data/training-parallel-un-v1.0/training-parallel-un-v1.0.tgz"]


def test_single_placement(spark):
    rows = [("europarl-v7", {"language_pair": "de"}), ("europarl-v7", {}), ("wmt14", {"target_dir": "t"}),
            ("un-corpus", {"target_dir": "u"})]
    plan = req.plan_single(requests(spark, *rows), anchors(spark, PAGES), STANDARD)
    assert values(plan, "req_id", "output_path") == [
        (0, "./data/de-en-train.tgz"),
        (1, "./data/parallel/de-en/de-en-train.tgz"), (1, "./data/parallel/fr-en/fr-en-train.tgz"),
        (2, "t/test/one.tgz"), (2, "t/training-parallel/one.tgz"), (2, "t/training-parallel/two.gz"),
        (3, "u/training-parallel-un-v1.0.tgz")]


def test_collisions(spark):
    plan = batch(spark, ("wmt14", {}), ("wmt14", {}))
    kept, rest = collisions.first_per_path(plan), collisions.collisions(plan)
    assert values(kept, "output_path", "req_id", "url") == [
        ("./data/wmt14/one.tgz", 0, WMT + "test/one.tgz"),
        ("./data/wmt14/two.gz", 0, WMT + "training-parallel/two.gz")]
    assert rest.count() == plan.count() - 2
    assert values(collisions.path_conflicts(plan), "output_path", "rows", "urls", "kept_url") == [
        ("./data/wmt14/one.tgz", 4, 2, WMT + "test/one.tgz")]


def test_every_request_is_planned_or_missing(spark):
    asked = requests(spark, ("europarl-v7", {}), ("europarl-v99", {}), ("zzz", {}), ("wmt14", {"category": "none"}))
    with_selector, files = req.answer(asked, anchors(spark, PAGES), STANDARD)
    planned = {r.req_id for r in req.match_files(with_selector, files).collect()}
    missing = {r.req_id for r in req.unanswered(with_selector, files).collect()}
    assert (planned, missing) == ({0}, {1, 2, 3})


def test_raises(spark):
    with pytest.raises(ValueError, match="in 1 requests, the first: zzz"):
        req.require_known(requests(spark, ("europarl", {}), ("zzz", {})), STANDARD)


def test_from_page_texts(spark):
    html = {page: "".join(f"<a href='{h}'>x</a>" for h in hrefs) for page, hrefs in PAGES.items()}
    html["http://elsewhere/"] = "<a href='de-en-train.tgz'>"
    pages = spark.createDataFrame(list(html.items()), "url string, html string")
    asked = requests(spark, ("wmt14", {}), ("europarl-v7", {"language_pair": "fr"}), ("wmt14", {"category": "test"}))
    columns = ("req_id", "url", "output_path", "category", "description")
    assert values(plan_from_pages(asked, pages), *columns) == values(
        req.plan_batch(asked, anchors(spark, PAGES), STANDARD), *columns)
