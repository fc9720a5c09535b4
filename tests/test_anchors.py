import time

import pytest

from corpusplan.operators.anchors import anchors_at_addresses, extract_anchors


def hrefs(spark, html):
    df = spark.createDataFrame([("u", html)], "url string, html string")
    return [r.href for r in extract_anchors(df).orderBy("pos").collect()]


def test_forms_of_links(spark):
    assert hrefs(spark, """<a href="one"><a href='two'><A HREF=three><a
        class="x" href = "four" >""") == ["one", "two", "three", "four"]
    assert hrefs(spark, '<a href="d?a=1&amp;b=2"> <a href=" spaced ">') == ["d?a=1&b=2", " spaced "]


def test_what_is_not_a_link(spark):
    assert hrefs(spark, '<a>x</a><a name="n"><a href=""><a href><a data-href="x"><area href="x">'
                        '<abbr href="x"><link href="x">') == []
    assert hrefs(spark, '<!-- <a href="x"> --><script>"<a href=x>"</script><style><a href="x"></style>'
                        '<a href="y">') == ["y"]


def test_misleading_attributes(spark):
    assert hrefs(spark, """<a title="a > b" href="one"><a title="href='no'" href="two">"""
                        """<a download href="three"><a href="four" href="five">""") == [
        "one", "two", "three", "four"]


def test_comment_to_the_end(spark):
    assert hrefs(spark, '<a href="x"><!-- <a href="y">') == ["x"]


def test_unreadable_page_has_no_rows(spark):
    pages = spark.createDataFrame([("u", None), ("v", "<a href=x>")], "url string, html string")
    assert [tuple(r) for r in extract_anchors(pages).collect()] == [("v", 0, "x")]


def test_broken_pages_stay_linear(spark):
    many = "<a " + " ".join(f'x{i}="{i}>"' for i in range(20000)) + ' href="ok">' + "<!-- " * 20000
    open_quote = '<a title="' + "z>" * 200000 + '" href=ok2>' + "<a " * 100000
    start = time.time()
    assert hrefs(spark, many) == ["ok"]
    assert hrefs(spark, open_quote) == ["ok2"]
    assert time.time() - start < 30


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_only_asked_pages(spark, tmp_path, limit):
    path = str(tmp_path / "pages")
    spark.createDataFrame(
        [("u", "<a href=x>"), ("v", "<a href=y><a href=z>")], "url string, html string").write.parquet(path)
    asked = spark.createDataFrame([("v",), ("w",)], "page_url string")
    found = anchors_at_addresses(spark.read.parquet(path), asked, broadcast_bytes=limit)
    assert sorted(tuple(r) for r in found.collect()) == [("v", 0, "y"), ("v", 1, "z")]


def test_page_texts_are_not_shuffled(spark, tmp_path):
    path = str(tmp_path / "pages")
    spark.createDataFrame([("u", "<a href=x>")], "url string, html string").write.parquet(path)
    asked = spark.createDataFrame([("u",)], "page_url string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for limit in (0, 1 << 20):
            found = anchors_at_addresses(spark.read.parquet(path), asked, broadcast_bytes=limit)
            plan = found._jdf.queryExecution().executedPlan().toString()
            # whatever is exchanged lies above the parsing or beside it
            below = plan.split("Generate posexplode")[1]
            pages_part = below[:below.index("FileScan")]
            assert "Exchange hashpartitioning" not in pages_part
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_runs_on_a_stream(spark, tmp_path):
    source = str(tmp_path / "pages")
    spark.createDataFrame([("u", "<a href=x><a href=y>")], "url string, html string").write.parquet(source)
    stream = spark.readStream.schema("url string, html string").parquet(source)
    query = (extract_anchors(stream).writeStream.format("memory").queryName("links")
             .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
    assert query.awaitTermination(60)
    assert sorted(r.href for r in spark.table("links").collect()) == ["x", "y"]
