"""Registered queries against DuckDB on the test tables, and the shape of their plans."""

import os

import duckdb
import pytest

from corpusplan import standard_families
from corpusplan.operators import collisions, requests as req
from helpers import requests
from workload import inputs, oracle, queries

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TABLES = ["documents", "pages", "events", "labels"]
QUERIES, ORACLE = queries.queries(), oracle.ORACLE
# these run several jobs of their own before they return a table
EAGER = {"gzip_lines", "tar_lines", "tar_checksums", "landing_runs", "landed_lines", "landed_ledger", "unpacked_lines",
         "ledger_snapshot", "landing_mixed", "file_inventory", "saved_pages", "landed_counts"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables not there")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return connection


def test_every_query_has_its_check():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equal_to_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    result = duck.execute(ORACLE[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    ours = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    assert ours == sorted(result.fetchall(), key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_plan_has_no_cross_join_or_whole_window(spark, name):
    plan = QUERIES[name](spark, MEDIUM)._jdf.queryExecution().executedPlan().toString()
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "SinglePartition, ENSURE_REQUIREMENTS"):
        if unwanted.startswith("Single") and name in ("ledger_size", "ledger_recent"):
            continue  # one total, five rows
        assert unwanted not in plan


@pytest.mark.parametrize("name", ["wmt_categories", "plan_kept", "ledger_latest"])
def test_one_row_per_key_is_kept_before_the_shuffle(spark, name):
    plan = QUERIES[name](spark, MEDIUM)._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan and plan.count("WindowGroupLimit") >= 2


def test_texts_are_not_read_for_plans(spark):
    plan = QUERIES["plan"](spark, MEDIUM)._jdf.queryExecution().executedPlan().toString()
    schemas = {line.split("ReadSchema: ")[1] for line in plan.splitlines() if "ReadSchema: " in line}
    assert schemas and all("text" not in s for s in schemas)


def test_anchors_and_requests_are_not_read_again(spark):
    """Links are stored as they are worked out: the plan reads requests, the stored links, and the anchors of the
    second hop (index and category pages in one table)."""
    for name in ("plan", "single_layout"):
        plan = QUERIES[name](spark, MEDIUM)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("-en-train.tgz") <= 2 and 0 < plan.count("Relation [") <= 8


def test_known_row_counts(spark):
    """Requests of every kind over the index pages derived from a thousand documents."""
    asked = requests(
        spark,
        ("zz-top", {}),
        ("wmt5", {"category": "test", "target_dir": "evaluation"}),
        ("news-commentary-v16", {"target_dir": ""}),
        ("un-corpus", {}),
        ("wmt8", {}),
        ("europarl-v3", {"language_pair": "es-en"}),
        ("europarl-v12", {}),
        ("news-commentary-v4", {"language_pair": "fr-en", "target_dir": "nc/fr"}),
        ("news-commentary-v1000", {}),
    )
    answered, files = req.answer(asked, inputs.anchors(spark, MEDIUM), standard_families())
    plan = req.lay_out_batch(answered, files)
    # a page may name one file at several positions
    assert plan.drop("pos").distinct().count() == 26
    assert collisions.first_per_path(plan).count() == 14
    assert sorted(r.req_id for r in req.unanswered(answered, files).collect()) == [0, 1, 5, 8]
    assert [r.urls for r in collisions.path_conflicts(plan).collect()] == [4] * 4
    counts = {n: QUERIES[n](spark, MEDIUM).count() for n in
              ("europarl_files", "news_files", "wmt_categories", "wmt_files", "candidates")}
    assert counts == {"europarl_files": 35, "news_files": 70, "wmt_categories": 24, "wmt_files": 92, "candidates": 198}
