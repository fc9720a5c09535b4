from html import unescape as reference_unescape
from os.path import basename, dirname, join, splitext

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from corpusplan.functions import archive, text
from corpusplan.functions.html import unescape

NAMES = ["training-parallel-un-v1.0.tgz", "x.tar.gz", ".bashrc", "a.", "a..b", "..a.b", "noext", "d.x/file",
         "d/.hid.x", "", "/", "a/b.c/", "...", "a\nb.gz"]


def column(spark, rows, build, schema="a string"):
    return [r.out for r in spark.createDataFrame(rows, schema).select(build.alias("out")).collect()]


def test_stem(spark):
    assert column(spark, [(n,) for n in NAMES], text.stem(F.col("a"))) == [splitext(n)[0] for n in NAMES]


def test_basename_and_dirname(spark):
    assert column(spark, [(n,) for n in NAMES], text.basename(F.col("a"))) == [basename(n) for n in NAMES]
    paths = ["d/x", "x", "a/b/c.gz", "./data/x"]
    assert column(spark, [(p,) for p in paths], text.dirname(F.col("a"))) == [dirname(p) for p in paths]


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="a./\n", max_size=8), min_size=1, max_size=30))
def test_stem_of_any_name(spark, names):
    assert column(spark, [(n,) for n in names], text.stem(F.col("a"))) == [splitext(n)[0] for n in names]


def test_join_path(spark):
    pairs = [("./data", "x/y"), ("./data/", "x"), ("./data", "/abs"), ("", "x"), ("./data", "")]
    got = column(spark, pairs, text.join_path(F.col("a"), F.col("b")), "a string, b string")
    assert got == [join(a, b) for a, b in pairs]


@pytest.mark.parametrize("row,expected", [
    (("t", "c", "de-en", "f.tgz"), "t"),
    (("", "c", "de-en", "f.tgz"), "c"),
    ((None, None, "de-en", "f.tgz"), "parallel/de-en"),
    ((None, None, None, "f.tar.gz"), "f.tar"),
    ((None, None, None, None), ""),
])
def test_subdirectory(spark, row, expected):
    place = text.subdirectory(*[F.col(c) for c in "abcd"])
    assert column(spark, [row], place, "a string, b string, c string, d string") == [expected]


def test_default_filename(spark):
    rows = [("http://h/d/x.tgz?a=1", None), ("http://h/d/x.tgz", "given")]
    got = column(spark, rows, text.default_filename(F.col("a"), F.col("b")), "a string, b string")
    assert got == ["x.tgz?a=1", "given"]


def test_archive_kind(spark):
    names = ["d/a.tgz", "a.tar.gz", "a.tsv.gz", "a.zip", "a.tsv", "a.TGZ"]
    assert column(spark, [(n,) for n in names], archive.archive_kind(F.col("a"))) == [
        "tar", "tar", "gzip", "unsupported", "none", "none"]
    assert column(spark, [(n,) for n in names], archive.unpacked_name(F.col("a"))) == [
        None, None, "a.tsv", None, None, None]


def test_unescape(spark):
    values = ["a&amp;b", "&amp;lt;", "&#233;&#xE9;&eacute;&#x1F600;", "&nope;", "&", "&&amp;", "plain", "&lt;&gt;&quot;&#39;"]
    assert column(spark, [(v,) for v in values], unescape(F.col("a"))) == [reference_unescape(v) for v in values]
    assert column(spark, [("&#0;&#xD800;&#9999999;",)], unescape(F.col("a"))) == ["&#0;&#xD800;&#9999999;"]
