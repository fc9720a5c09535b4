import pytest
from pyspark.sql import functions as F

from corpusplan.operators import families as fam, requests as req
from helpers import anchors, requests, values

STANDARD = fam.standard_families()
EUROPARL = "http://statmt.org/europarl/v7/"
NEWS = "http://data.statmt.org/news-commentary/v15/training/"
WMT = "http://statmt.org/wmt14/"


def files(spark, pages, *rows, families=STANDARD):
    asked, found = req.answer(requests(spark, *rows), anchors(spark, pages), families)
    return req.match_files(asked, found)


@pytest.mark.parametrize("dataset_id,family,version", [
    ("europarl-v7", "europarl", "v7"), ("europarl", "europarl", "v7"), ("europarl7", "europarl", "v7"),
    ("europarl-V10", "europarl", "v10"), ("europarl-v7.1", "europarl", "v1"), ("europarl-v7-x", "europarl", "v7"),
    ("news-commentary-v15", "news-commentary", "v15"), ("news-commentary", "news-commentary", "v15"),
    ("wmt14", "wmt", "14"), ("wmt", "wmt", "14"), ("wmt-2014", "wmt", "2014"), ("wmtx", "wmt", "14"),
    ("un-corpus-v1.0", "un-corpus", "v1.0"), ("un-corpus", "un-corpus", "v1.0"),
    ("Europarl-v7", None, None), ("foo", None, None),
])
def test_resolve(spark, dataset_id, family, version):
    row = req.resolve(requests(spark, (dataset_id, {})), STANDARD).first()
    assert (row.family, row.version) == (family, version)


def test_index_addresses(spark):
    asked = requests(spark, ("europarl-v7", {}), ("news-commentary-v15", {}), ("wmt14", {}), ("un-corpus", {}))
    got = [r.index_url for r in req.resolve(asked, STANDARD).orderBy("req_id").collect()]
    assert got == [EUROPARL, NEWS, WMT, None]


def test_europarl(spark):
    pages = {EUROPARL: ["de-en-train.tgz", "en-fi-train.tgz", "de-en.tgz", "x-train.zip", "", "de-fr-train-a.tgz"]}
    found = files(spark, pages, ("europarl-v7", {}))
    assert values(found, "url", "filename", "language_pair") == [
        (EUROPARL + "de-en-train.tgz", "de-en-train.tgz", "de-en"),
        (EUROPARL + "de-fr-train-a.tgz", "de-fr-train-a.tgz", "de-fr"),
        (EUROPARL + "en-fi-train.tgz", "en-fi-train.tgz", "en-fi")]
    assert values(files(spark, pages, ("europarl-v7", {"language_pair": "en"})), "filename") == [
        ("de-en-train.tgz",), ("en-fi-train.tgz",)]
    assert values(files(spark, pages, ("europarl-v7", {"language_pair": "en-de"})), "filename") == []


def test_news_commentary(spark):
    pages = {NEWS: ["news-commentary-v15.de-en.tsv.gz", "news-commentary-v15.fr-en.tsv",
                    "news-commentary-v15.DE-en.tsv", "news-commentary-v15.deu-en.tsv", "x-v15.de-en.tsv",
                    "news-commentary-v14.de-en.tsv", "news-commentary-v15.de-en.tsv\n"]}
    assert values(files(spark, pages, ("news-commentary-v15", {})), "filename", "language_pair") == [
        ("news-commentary-v15.de-en.tsv.gz", "de-en"), ("news-commentary-v15.fr-en.tsv", "fr-en")]
    assert values(files(spark, pages, ("news-commentary-v15", {"language_pair": "fr"})), "filename") == []


def test_news_version_is_a_prefix(spark):
    index = NEWS.replace("v15", "v1")
    pages = {index: ["news-commentary-v15.de-en.tsv"]}
    assert files(spark, pages, ("news-commentary-v1", {})).count() == 1


def test_wmt_categories(spark):
    pages = {
        WMT: ["training-parallel/", "test", "test/", "latest/", "dev.html", "other/", ""],
        WMT + "training-parallel/": ["a.tgz", "b.tar.gz", "c.gz", "d.zip", "e.txt", "f.TGZ", ""],
        WMT + "test": ["never.tgz"],
        WMT + "test/": ["t.gz"],
        WMT + "latest/": ["l.gz"],
    }
    found = files(spark, pages, ("wmt14", {}))
    # two links make the category `test`, the last one counts; dev.html cannot be read
    assert values(found, "category", "url") == [
        ("latest", WMT + "latest/l.gz"), ("test", WMT + "test/t.gz"),
        ("training-parallel", WMT + "training-parallel/a.tgz"),
        ("training-parallel", WMT + "training-parallel/b.tar.gz"),
        ("training-parallel", WMT + "training-parallel/c.gz"),
        ("training-parallel", WMT + "training-parallel/d.zip")]


def test_wmt_asked_category(spark):
    pages = {
        WMT: ["training-a/", "training-b/", "misc/"],
        WMT + "training-a/": ["a.gz"], WMT + "training-b/": ["b.gz"], WMT + "misc/": ["m.gz"],
    }
    found = files(spark, pages, ("wmt14", {"category": "training"}), ("wmt14", {"category": "misc"}),
                  ("wmt14", {"category": "training-a"}))
    assert values(found, "req_id", "category", "filename") == [
        (0, "training", "b.gz"), (1, "misc", "m.gz"), (2, "training-a", "a.gz")]


def test_user_text_is_matched_literally(spark):
    pages = {WMT: ["tra%/", "training/"], WMT + "training/": ["a.gz"], WMT + "tra%/": ["p.gz"]}
    found = files(spark, pages, ("wmt14", {"category": "%"}), ("wmt14", {"category": ".*"}))
    assert values(found, "req_id", "filename") == [(0, "p.gz")]


def test_un_corpus_needs_no_page(spark):
    found = files(spark, {}, ("un-corpus-v1.0", {"language_pair": "de-en"}))
    assert values(found, "url", "filename", "version") == [(
        "http://statmt.org/wmt13/training-parallel-un-v1.0.tgz", "training-parallel-un-v1.0.tgz", "v1.0")]


def test_requests_that_ask_the_same_share_a_selector(spark):
    asked = req.with_selector(requests(
        spark, ("wmt14", {"language_pair": "de-en"}), ("wmt14", {"language_pair": ""}), ("wmt", {"odd": "1"})), STANDARD)
    assert req.selectors_of(asked).count() == 1


def test_own_family(spark):
    own = fam.standard_families().register(fam.PageFamily(
        "mine", "1", "http://m/{version}/", options=("kind",),
        keep="endswith(href, concat('.', get_json_object(want_extra, '$.kind')))"))
    found = files(spark, {"http://m/v2/": ["a.x", "b.y"]}, ("mine-2", {"kind": "y"}), ("mine2", {"kind": "x"}),
                  families=own)
    assert values(found, "req_id", "url") == [(0, "http://m/v2/b.y"), (1, "http://m/v2/a.x")]


def test_own_family_as_table(spark):
    own = fam.Families([fam.TableFamily("t", "0", "http://t/{version}", select=lambda links: links.select(
        *fam.SELECTOR, F.upper("href").alias("url"), F.col("href").alias("filename"), "pos"))])
    assert values(files(spark, {"http://t/0": ["a"]}, ("t", {}), families=own), "url", "category") == [("A", None)]


def test_first_registered_prefix_wins(spark):
    page = lambda prefix: fam.PageFamily(prefix, "1", "http://h/{version}", keep="true")
    asked = requests(spark, ("wmt-own", {}))
    late = fam.standard_families().register(page("wmt-own"))
    early = fam.Families([page("wmt-own"), *fam.standard_families()])
    assert req.resolve(asked, late).first().family == "wmt"
    assert req.resolve(asked, early).first().family == "wmt-own"
