import pytest

from corpusplan.operators import families as fam, requests as req
from corpusplan.operators.sql import function_bodies, register_functions
from helpers import requests, values

STANDARD = fam.standard_families()
IDS = ["europarl-v7", "europarl", "news-commentary-v15", "wmt14", "wmt-2014", "un-corpus-v1.0", "un-corpus", "Europarl-v7", "foo", ""]
EUROPARL = ["de-en-train.tgz", "en-fi-train.tgz", "de-en.tgz", "x-train.zip", "it's%-train.tgz"]


@pytest.fixture(scope="module")
def functions(spark):
    return register_functions(spark, STANDARD)


def test_names(functions):
    assert functions == [*function_bodies(STANDARD), "corpus_fixed_files"]


def test_resolver_is_the_same(spark, functions):
    asked = requests(spark, *[(i, {"language_pair": "de-en", "category": "test"}) for i in IDS])
    asked.createOrReplaceTempView("asked")
    by_sql = spark.sql("SELECT req_id, r.family, r.version, r.index_url, a.want_pair, a.want_category, a.want_extra FROM (SELECT req_id, "
                       "corpus_resolve(dataset_id) AS r, corpus_asks(dataset_id, language_pair, category, extra) AS a FROM asked)")
    columns = ["req_id", "family", "version", "index_url", "want_pair", "want_category", "want_extra"]
    assert values(by_sql, *columns) == values(req.with_selector(asked, STANDARD), *columns)
    plan = by_sql._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


@pytest.mark.parametrize("pair", ["", "en", "de-en", "it's%"])
def test_rules_in_sql(spark, functions, pair):
    spark.createDataFrame([(h,) for h in EUROPARL], "href string").createOrReplaceTempView("links")
    arguments = "'europarl', 'v7', href, :pair, '', ''"
    got = spark.sql(f"SELECT href, corpus_language_pair({arguments}) AS pair, corpus_description({arguments}) AS said FROM links "
                    f"WHERE corpus_picks({arguments})", args={"pair": pair}).collect()
    assert sorted(r.href for r in got) == sorted(h for h in EUROPARL if h.endswith(".tgz") and "-train" in h and pair in h)
    for r in got:
        assert r.pair == r.href.split("-train")[0] and r.said == f"Europarl v7 {r.pair} corpus"


def test_fixed_files_and_paths(spark, functions):
    rows = spark.sql("SELECT family, filename, pos FROM corpus_fixed_files()").collect()
    assert [tuple(r) for r in rows] == [("un-corpus", "training-parallel-un-v1.0.tgz", 0)]
    made = spark.sql("SELECT corpus_output_path('a', 'b'), corpus_output_path('a/', 'b'), corpus_output_path('', 'b'), "
                     "corpus_output_path('a', '/b'), corpus_output_path('a', '')").first()
    assert tuple(made) == ("a/b", "a/b", "b", "/b", "a/")


def test_own_families_replace_the_functions(spark):
    own = fam.Families([fam.PageFamily("mine", "1", "http://m/{version}/", options=("kind",),
                                       keep="endswith(href, get_json_object(want_extra, '$.kind'))")])
    assert "corpus_fixed_files" not in register_functions(spark, own)
    row = spark.sql("SELECT corpus_resolve('mine-2').index_url AS page, corpus_asks('mine-2', '', '', map('kind', 'x')).want_extra AS extra").first()
    assert tuple(row) == ("http://m/v2/", '{"kind":"x"}')
    assert spark.sql("SELECT corpus_picks('mine', 'v2', 'a.x', '', '', '{\"kind\":\"x\"}')").first()[0]
    register_functions(spark, STANDARD)
