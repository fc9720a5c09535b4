"""Registered queries of the operators: each over its whole table, with production parameters."""

import zlib

from pyspark.sql import functions as F

from corpusplan.llm import (
    bpe, centroids, decontaminate, html, lines, periods, quality, simhash, suffix, tokencounts, topk, toxicity, warc,
)
from corpusplan.llm.common import held_out


def _documents(spark, sf_dir, *columns):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def _labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_toxicity(spark, sf_dir):
    docs = _documents(spark, sf_dir, "doc_id", "text")
    model = toxicity.train(docs, _labels(spark, sf_dir))
    return toxicity.score(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", "predicted", "n_offending", "offending")


def op2_warc(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    _, index = warc.archive(pages)
    return warc.read_records(warc.look_up(pages, index))


def op3_suffix_dedup(spark, sf_dir):
    cleaned = suffix.remove_repeats(_documents(spark, sf_dir, "doc_id", "text"))
    return cleaned.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_benchmark_decontamination(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.leaks(_documents(spark, sf_dir, "doc_id", "text"), items)


def op5_html_extraction(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return html.extract(pages).select("page_id", "url", "text", "n_chars")


def op6_bpe(spark, sf_dir):
    docs = _documents(spark, sf_dir, "doc_id", "text")
    return bpe.encode_decode(docs, vocabulary(), keep=False).drop("text")


def op7_quality(spark, sf_dir):
    docs = _documents(spark, sf_dir, "doc_id", "text")
    rules = quality.train(docs, _labels(spark, sf_dir))
    return quality.score(docs, rules).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op8_topk(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_line_dedup(spark, sf_dir):
    kept = lines.dedup_lines(_documents(spark, sf_dir, "doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op10_simhash_near_dedup(spark, sf_dir):
    found = simhash.near_duplicates(_documents(spark, sf_dir, "doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_token_counts(spark, sf_dir):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    counted = tokencounts.count_tokens(_documents(spark, sf_dir, "doc_id", "text"), path, keep=False)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op12_centroids(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return centroids.cluster(vectors).withColumn("centroid_sha256", F.sha2("centroid", 256)).drop("centroid")


def made_periodic(doc_id, words):
    """The words of op13's contract: in a tenth of the documents all from some place on repeat a first part."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def op13_periodic_runs(spark, sf_dir):
    docs = _documents(spark, sf_dir, "doc_id", "text")
    return periods.collapse_runs(docs, prepare=made_periodic, keep=False).drop("text")


def queries():
    return {f.__name__: f for f in (
        op1_toxicity, op2_warc, op3_suffix_dedup, op4_benchmark_decontamination, op5_html_extraction, op6_bpe, op7_quality, op8_topk,
        op9_line_dedup, op10_simhash_near_dedup, op11_token_counts, op12_centroids, op13_periodic_runs)}


OP9_SQL = r"""
WITH parts AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM parts),
frequent AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (
  SELECT k.*, f.key IS NOT NULL AND k.doc_id <> f.last AS dropped FROM keyed k LEFT JOIN frequent f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

OP2_SQL = """
WITH payloads AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
hashed AS (
  SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS h,
         min(page_id) OVER (PARTITION BY payload) AS first FROM payloads)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((('0x' || substr(h, 1 + 5 * (i // 4)::INTEGER, 5))::INTEGER >> (15 - 5 * (i % 4))::INTEGER) & 31), 1)), '')
         AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM hashed
"""

OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS codes FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.codes, c.codes)::BIGINT AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM placed WHERE rank <= 5
"""


OP3_SQL = """
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
pieces AS (
  SELECT doc_id, base, substr(h, 2 * base + 1, 2 * 355) AS part
  FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 99, 0), 256)) AS base FROM texts)),
grams AS (
  SELECT doc_id, base + i AS i, md5(substr(part, 2 * i + 1, 200)) AS gram
  FROM (SELECT doc_id, base, part, unnest(range(0, length(part) // 2 - 99)) AS i FROM pieces)),
firsts AS (
  SELECT gram, min(struct_pack(doc_id := doc_id, i := i)) AS first FROM grams GROUP BY gram HAVING count(*) > 1),
later AS (
  SELECT g.doc_id, g.i FROM grams g JOIN firsts f USING (gram) WHERE g.doc_id <> f.first.doc_id OR g.i <> f.first.i),
marked AS (
  SELECT *, coalesce(i - lag(i) OVER w > 100, TRUE)::INTEGER AS new FROM later WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
spans AS (
  SELECT doc_id, min(i) AS s, max(i) + 100 AS e
  FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM marked) GROUP BY doc_id, span),
cuts AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS before FROM spans),
ends AS (
  SELECT doc_id, sum(e - s)::BIGINT AS n_removed, count(*) AS n_spans, max(e) AS last,
         string_agg(substr(t.h, 2 * before + 1, 2 * (s - before)), '' ORDER BY s) AS head
  FROM cuts JOIN texts t USING (doc_id) GROUP BY doc_id)
SELECT t.doc_id, length(t.h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(t.h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM texts t LEFT JOIN ends e USING (doc_id)
"""

OP5_SQL = r"""
WITH articles AS (SELECT page_id, url, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS body FROM pages),
cut AS (SELECT page_id, url, regexp_split_to_array(body, '</?(?:p|h1)>') AS parts FROM articles),
cleaned AS (
  SELECT page_id, url, list_filter(list_transform(parts, lambda p: trim(regexp_replace(replace(replace(
    regexp_replace(p, '<[^>]*>', ' ', 'g'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'))), lambda p: p <> '') AS parts FROM cut)
SELECT page_id, url, array_to_string(parts, chr(10)) AS text, length(array_to_string(parts, chr(10))) AS n_chars FROM cleaned
"""

OP13_SQL = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         CASE WHEN doc_id IS NULL THEN 1 ELSE xor(list_reduce(
           list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT),
           lambda crc, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)), xor(crc, b)),
           4294967295), 4294967295) END AS h FROM documents),
placed AS (SELECT *, len(w) AS n, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM split),
words AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: w[1 + CASE WHEN i < a THEN i
           ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END]) ELSE w END AS w FROM placed),
flat AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(0, n)) AS i FROM words),
same AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q FROM flat x JOIN flat y ON x.doc_id = y.doc_id AND x.word = y.word
    AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM same),
stretches AS (
  SELECT doc_id, min(i) AS s, count(*) + q AS size, q FROM islands GROUP BY doc_id, q, island
  HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT doc_id, s, size, min(q) AS q FROM stretches GROUP BY doc_id, s, size),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + size)) AS i FROM runs),
kept AS (
  SELECT f.doc_id, string_agg(word, ' ' ORDER BY f.i) AS text FROM flat f
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = f.doc_id AND g.i = f.i) GROUP BY f.doc_id),
best AS (
  SELECT * FROM runs r WHERE NOT EXISTS (
    SELECT 1 FROM runs o WHERE o.doc_id = r.doc_id AND (o.size * r.q > r.size * o.q
      OR o.size * r.q = r.size * o.q AND (o.s < r.s OR o.s = r.s AND o.q < r.q)))),
listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || size || ',' || q || chr(10), '' ORDER BY s, q) AS lines
  FROM runs GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.size AS length, b.q AS period, 1000 * b.size // b.q AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM documents d LEFT JOIN listed USING (doc_id) LEFT JOIN best b USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""


def _op12_sql(rounds: int = 5) -> str:
    """Plain rounds of assignment and means; scores as inner products of doubles, exact for such small codes."""
    steps = ["""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS c
  FROM embeddings
  WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
k0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, c) - 1 AS k, c FROM (
    SELECT c, sha256('2:' || vec_id::VARCHAR) AS h FROM v WHERE vec_id IS NOT NULL ORDER BY h, c LIMIT 40))"""]
    for n in range(rounds + 1):
        steps.append(f"""
a{n} AS MATERIALIZED (
  SELECT r, min(struct_pack(d := list_inner_product(v.c, v.c) - 2 * list_inner_product(v.c, k.c) + list_inner_product(k.c, k.c),
                            k := k.k)) AS best
  FROM v, k{n} k GROUP BY r)""")
        if n < rounds:
            steps.append(f"""
s{n} AS (
  SELECT best.k AS k, i, sum(x)::HUGEINT AS s, count(*) AS m
  FROM (SELECT r, unnest(c)::BIGINT AS x, unnest(range(1, 65)) AS i FROM v) JOIN a{n} USING (r) GROUP BY 1, 2),
m{n} AS (SELECT k, list(((s - ((s % m) + m) % m) // m)::DOUBLE ORDER BY i) AS c FROM s{n} GROUP BY k),
k{n + 1} AS MATERIALIZED (SELECT k, coalesce(m.c, o.c) AS c FROM k{n} o LEFT JOIN m{n} m USING (k))""")
    return ",".join(steps) + f"""
SELECT vec_id, best.k::INTEGER AS cluster, best.d::BIGINT AS distance,
       (sum(best.d) OVER (PARTITION BY best.k))::BIGINT AS cluster_inertia, (sum(best.d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(list_transform(f.c, lambda x: x::BIGINT), ',')) AS centroid_sha256
FROM v JOIN a{rounds} USING (r) JOIN k{rounds} f ON f.k = best.k
"""


ORACLE = {"op2_warc": OP2_SQL, "op3_suffix_dedup": OP3_SQL, "op5_html_extraction": OP5_SQL, "op8_topk": OP8_SQL, "op9_line_dedup": OP9_SQL,
          "op12_centroids": _op12_sql(), "op13_periodic_runs": OP13_SQL}
