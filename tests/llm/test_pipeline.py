import re

import duckdb
import pytest

import corpus_pipeline
from corpusplan.llm import queries

SF = "/root/testdata/sf0.001"


def same(spark_df, sql, tables):
    db = duckdb.connect()
    for t in tables:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.execute(sql)
    names = [d[0] for d in want.description]
    got = sorted((tuple(r[n] for n in names) for r in spark_df.collect()), key=repr)
    assert got == sorted(want.fetchall(), key=repr)


@pytest.mark.parametrize("name, tables", [
    ("op3_suffix_dedup", ["documents"]), ("op5_html_extraction", ["pages"]), ("op8_topk", ["embeddings"]),
    ("op9_line_dedup", ["documents"]), ("op12_centroids", ["embeddings"]), ("op13_periodic_runs", ["documents"])])
def test_queries_with_sql(spark, name, tables):
    same(queries.queries()[name](spark, SF), queries.ORACLE[name], tables)


def test_every_operator_has_a_query():
    assert [re.match(r"op(\d+)_", n)[1] for n in queries.queries()] == [str(n) for n in range(1, 14)]


def test_stages_keep_columns_and_only_drop(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    left = {r.doc_id for r in docs.select("doc_id").collect()}
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= left
        if n in (1, 4):
            assert set(ids) == left  # lines go, documents stay
        left = set(ids)
        if n < 4:
            assert docs.columns == names
    assert left


def test_run_on_an_empty_table(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_whole_pipeline_against_plain_steps(spark, tmp_path):
    """Each stage again by the plainest means, over what the one before it kept."""
    import hashlib
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    from corpusplan.llm import decontaminate, toxicity
    from test_lines import brute as plain_lines
    from test_nearcopies import brute as plain_copies, edited

    rng = random.Random(4)
    source = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 900").orderBy("doc_id").limit(110).collect()
    items = [(i, " ".join(f"q{rng.randrange(900)}" for _ in range(18))) for i in range(6)]
    line = "A line that stands in many documents, and is long enough to be one of them."
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in source]
    for n, (d, t, *rest) in enumerate(rows[:40]):
        new = {0: t, 1: edited(rng, t, 1), 2: f"{t} {items[n % 6][1]}", 3: f"{line}\n{t}"}[n % 4]
        rows.append((10_000 + n, new, *rest))
    rows += [(20_000, None, "en", "s", 0), (20_001, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    model = toxicity.train(docs, labels)
    left = [(d, t) for d, t, *_ in rows if model.document(t or "")[0] < 0.5]
    left = [(d, t) for d, t, _, _ in plain_lines(left)]
    left = plain_copies(left)
    clean = [(decontaminate.normal(t), int(decontaminate.ERROR_RATE * len(decontaminate.normal(t)))) for _, t in items]
    left = [(d, t) for d, t in left if not any(decontaminate.best_match(i, decontaminate.normal(t or ""), e) for i, e in clean)]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for d, t in left:
        ids = library.encode(t or "", add_special_tokens=False).ids
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        text = library.decode(ids, skip_special_tokens=False)
        want.append((d, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert len(want) < len(rows) - 20 and sorted(map(tuple, got)) == sorted(want)
