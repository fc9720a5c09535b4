"""Registered queries: the package's operators over the test tables."""

from functools import partial

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

import corpusplan
import workload
from corpusplan import known
from corpusplan.functions import archive, text
from corpusplan.operators import anchors as anchor_ops, checksums, collisions, families as fam
from corpusplan.operators import landing, reports, requests as req
from corpusplan.operators.sql import register_functions
from corpusplan.plans import acquire as runs
from corpusplan.sources import archives, catalogue, inventory, ledger, pages, requests as request_source, streams
from workload import inputs

cloudpickle.register_pickle_by_value(workload)

STANDARD = corpusplan.standard_families()


def page_anchors(spark, sf_dir):
    return anchor_ops.extract_anchors(pages.read_pages(spark, f"{sf_dir}/pages.parquet"))


def resolve_ids(spark, sf_dir):
    return req.resolve(inputs.requests(spark, sf_dir), STANDARD).select(
        "req_id", "dataset_id", "family", "version", "index_url")


def registry_pairs(spark, sf_dir):
    asked = inputs.seeds(spark, sf_dir).selectExpr("doc_id AS req_id", f"{inputs.CATALOGUE_ID} AS dataset_id")
    known_ids = catalogue.list_datasets(spark)
    return reports.language_pairs(asked, known_ids).select(
        "req_id", "dataset_id", F.concat_ws(", ", "language_pairs").alias("language_pairs"),
        F.size("language_pairs").alias("pairs"))


def _unfiltered(spark, sf_dir, families=STANDARD):
    """One question without filters to each dataset of the families."""
    asked = req.with_selector(inputs.datasets(spark, sf_dir), STANDARD)
    return req.selectors_of(asked.where(F.col("family").isin([f.prefix for f in families])))


def _links(spark, sf_dir, families):
    return fam.link_index(_unfiltered(spark, sf_dir, families), inputs.index_anchors(spark, sf_dir), families)


def _page_files(spark, sf_dir, family):
    families = STANDARD.only(family)
    return fam.page_files(_links(spark, sf_dir, families), families).select("family", "version", *fam.FILE)


def europarl_files(spark, sf_dir):
    return _page_files(spark, sf_dir, known.EUROPARL)


def news_files(spark, sf_dir):
    return _page_files(spark, sf_dir, known.NEWS_COMMENTARY)


def _wmt_categories(spark, sf_dir, families):
    return fam.category_pages(_links(spark, sf_dir, families), families)


def wmt_categories(spark, sf_dir):
    return _wmt_categories(spark, sf_dir, STANDARD.only(known.WMT)).select("version", "category", "page_url", "pos")


def wmt_files(spark, sf_dir):
    families = STANDARD.only(known.WMT)
    categories = _wmt_categories(spark, sf_dir, families)
    return fam.category_files(categories, inputs.category_anchors(spark, sf_dir), families).select(
        "family", "version", "url", "filename", "category", "description", "pos")


def candidates(spark, sf_dir):
    files = fam.family_files(_unfiltered(spark, sf_dir), inputs.anchors(spark, sf_dir), STANDARD, _store(spark))
    return files.select("family", "version", *fam.FILE)


def _answer(spark, sf_dir):
    return req.answer(inputs.requests(spark, sf_dir), inputs.anchors(spark, sf_dir), STANDARD, _store(spark))


def request_files(spark, sf_dir):
    matched = req.match_files(*_answer(spark, sf_dir))
    return matched.select("req_id", "dataset_id", "family", "version", *fam.FILE)


def plan(spark, sf_dir):
    return req.lay_out_batch(*_answer(spark, sf_dir))


def plan_from_pages(spark, sf_dir):
    planned = runs.plan_from_pages(inputs.requests(spark, sf_dir), inputs.index_pages(spark, sf_dir))
    return planned.drop("pos")


def plan_kept(spark, sf_dir):
    return collisions.first_per_path(plan(spark, sf_dir))


def single_layout(spark, sf_dir):
    return req.lay_out_single(*_answer(spark, sf_dir))


def path_collisions(spark, sf_dir):
    return collisions.collisions(plan(spark, sf_dir)).select("req_id", "dataset_id", "url", "output_path", "pos")


def path_conflicts(spark, sf_dir):
    return collisions.path_conflicts(plan(spark, sf_dir))


def missing_requests(spark, sf_dir):
    return req.unanswered(*_answer(spark, sf_dir))


def batch_summary(spark, sf_dir):
    return reports.batch_summary(attributed_outcomes(spark, sf_dir))


def _objects(spark, sf_dir):
    """A mirror of all that is linked, and of the fixed files, that lacks every `.tar.gz` file."""
    linked = inputs.anchors(spark, sf_dir).where("href <> ''").select(
        F.concat(text.strip_slashes(F.col("page_url")), F.lit("/"), "href").alias("url"))
    urls = linked.unionByName(fam.fixed_files(_fixed(spark), STANDARD).select("url"))
    return urls.where(~F.endswith("url", F.lit(".tar.gz"))).distinct().select(
        "url", F.concat(F.lit("mirror/"), text.basename(F.col("url"))).alias("src_path"),
        F.length("url").cast("bigint").alias("length"))


def _fixed(spark):
    """One question to each family whose files are known beforehand."""
    asked = [(f.prefix, f.default_version, "", "", "") for f in STANDARD.of_kind(fam.FixedFamily)]
    return spark.createDataFrame(asked, ", ".join(f"{c} string" for c in fam.SELECTOR))


def _store(spark):
    return corpusplan.Store(corpusplan.shared_dir(spark, "tables"))


def _outcomes(spark, sf_dir, force=False, planned=None):
    kept = collisions.first_per_path(plan(spark, sf_dir) if planned is None else planned)
    return landing.fetch_status(kept, inputs.existing(spark, sf_dir), _objects(spark, sf_dir), force)


def fetch_outcomes(spark, sf_dir, force=False):
    return _outcomes(spark, sf_dir, force).select(
        "req_id", "dataset_id", "url", "output_path", "status", "error", "src_path", "length")


def skip_existing(spark, sf_dir):
    kept, there = _store(spark)(plan_kept(spark, sf_dir), "kept"), inputs.existing(spark, sf_dir)
    both = landing.to_fetch(kept, there).select("output_path", F.lit("fetch").alias("todo")).unionByName(
        landing.already_there(kept, there).select("output_path", F.lit("skip").alias("todo")))
    return both


def outcome_counts(spark, sf_dir, force=False):
    return reports.status_counts(_outcomes(spark, sf_dir, force))


def attributed_outcomes(spark, sf_dir):
    store = _store(spark)
    planned = store(plan(spark, sf_dir), "plan")
    outcomes = store(_outcomes(spark, sf_dir, planned=planned), "outcomes")
    return landing.attribute(planned, outcomes).select(
        "req_id", "dataset_id", "url", "output_path", "status", "error")


def paths_by_dataset(spark, sf_dir):
    return reports.paths_by_dataset(attributed_outcomes(spark, sf_dir))


def archive_kind(spark, sf_dir):
    rows = plan(spark, sf_dir).select("url", "output_path").distinct()
    path = F.col("output_path")
    return rows.select(
        "url", "output_path", archive.archive_kind(path).alias("archive_kind"),
        archive.unpacked_name(path).alias("unpacked_name"), text.basename(path).alias("name"),
        text.dirname(path).alias("folder"),
        text.default_filename(F.col("url"), F.lit(None).cast("string")).alias("default_name"))


def _event_ledger(spark, sf_dir):
    events = inputs.table(spark, sf_dir, "events")
    return events.select(
        F.concat(F.lit("http://mirror.example/"), "user_id").alias("url"),
        F.concat_ws("/", F.lit("./data"), "event_type", "user_id").alias("path"),
        F.unix_timestamp("ts").alias("ts"), "event_id")


def ledger_latest(spark, sf_dir):
    return ledger.latest(_event_ledger(spark, sf_dir), "event_id")


def ledger_snapshot(spark, sf_dir):
    """The log of one half of the events folded, and the other half appended to the fold."""
    log, folded = (corpusplan.shared_dir(spark, n) for n in ("ledger", "folded"))
    events = _event_ledger(spark, sf_dir)
    ledger.append_batch(events.where("event_id % 2 = 0"), log, "even")
    ledger.write_snapshot(ledger.read_log(spark, log), folded)
    ledger.append_batch(events.where("event_id % 2 = 1"), folded, "odd")
    return ledger.read_log(spark, folded)


def ledger_size(spark, sf_dir):
    return reports.ledger_size(ledger_latest(spark, sf_dir))


def ledger_recent(spark, sf_dir):
    return reports.ledger_recent(ledger_latest(spark, sf_dir))


def ledger_json(spark, sf_dir):
    """Ledgers written as JSON, one per event, every seventh cut short."""
    entry = F.struct("path", F.col("ts").alias("timestamp"))
    body = F.to_json(F.struct(F.create_map("url", entry).alias("downloads"), F.create_map().alias("datasets")))
    broken = F.substring(body, F.lit(1), F.length(body) - 20)
    texts = _event_ledger(spark, sf_dir).select(
        "event_id", F.when(F.expr("event_id % 7 = 0"), broken).otherwise(body).alias("value"))
    return ledger.parse_ledgers(texts)


def text_checksums(spark, sf_dir):
    documents = inputs.table(spark, sf_dir, "documents").select("doc_id", "text")
    return checksums.text_checksums(documents, "text").drop("text")


def _listing():
    return corpusplan.standard_families().register(fam.PageFamily(
        "listing", "0", "http://statmt.org/wmt{version}/", version_tag="", options=("suffix",),
        keep="endswith(href, get_json_object(want_extra, '$.suffix'))",
        category="get_json_object(want_extra, '$.suffix')",
    ))


def rule_extension(spark, sf_dir):
    """A family of one's own that takes a request option of its own."""
    own = _listing()
    asked = inputs.seeds(spark, sf_dir).select(
        F.col("doc_id").alias("req_id"), F.concat(F.lit("listing-"), "v").alias("dataset_id"),
        *[F.lit(None).cast("string").alias(c) for c in ("language_pair", "category", "target_dir")],
        F.lit(False).alias("has_target_dir"),
        F.create_map(F.lit("suffix"), F.when(F.expr("m < 4"), ".html").otherwise("/")).alias("extra"),
    )
    matched = req.match_files(*req.answer(asked, inputs.index_anchors(spark, sf_dir), own))
    return matched.select("req_id", "family", "version", "url", "category", "pos")


def rule_extension_sql(spark, sf_dir):
    """The same family, asked in SQL text through the session's functions."""
    register_functions(spark, _listing())
    inputs.seeds(spark, sf_dir).selectExpr("doc_id", "v", "m").createOrReplaceTempView("corpus_seeds")
    inputs.index_anchors(spark, sf_dir).createOrReplaceTempView("corpus_anchors")
    return spark.sql("""
        WITH asked AS (
            SELECT doc_id AS req_id, 'listing-' || v AS dataset_id, map('suffix', CASE WHEN m < 4 THEN '.html' ELSE '/' END) AS extra
            FROM corpus_seeds),
        resolved AS (SELECT req_id, corpus_resolve(dataset_id) AS to, corpus_asks(dataset_id, NULL, NULL, extra) AS wants FROM asked)
        SELECT req_id, to.family, to.version, corpus_file_url(a.page_url, a.href) AS url,
               corpus_category(to.family, to.version, a.href, wants.want_pair, wants.want_category, wants.want_extra) AS category, a.pos
        FROM resolved JOIN corpus_anchors a ON a.page_url = to.index_url
        WHERE a.href <> '' AND corpus_picks(to.family, to.version, a.href, wants.want_pair, wants.want_category, wants.want_extra)""")


def batch_requests(spark, sf_dir):
    """One batch text per document: a list, an object, or one of the malformed kinds."""
    entry = F.struct(
        F.concat(F.lit("wmt"), "v").alias("dataset_id"), F.col("lang").alias("language_pair"),
        F.lit("").alias("category"), F.col("k").alias("quality"))
    more = F.struct(F.lit("europarl").alias("dataset_id"), F.col("lang").alias("target_dir"))
    entries = F.to_json(F.array(F.from_json(F.to_json(entry), "map<string,string>"),
                                F.from_json(F.to_json(more), "map<string,string>")))
    value = (
        F.when(F.col("m") == 0, entries)
        .when(F.col("m") == 1, F.lit("{}"))
        .when(F.col("m") == 2, F.lit('{"datasets": null}'))
        .when(F.col("m") == 3, F.lit('[{"category": "test"}]'))
        .when(F.col("m") == 4, F.lit('{"datasets": ['))
        .otherwise(F.concat(F.lit('{"datasets": '), entries, F.lit("}")))
    )
    texts = inputs.seeds(spark, sf_dir).select("doc_id", value.alias("value"))
    parsed = request_source.parse_batches(texts)
    good = request_source.batch_requests(parsed).select(
        "doc_id", "req_id", "dataset_id", "language_pair", "category", "target_dir", "has_target_dir",
        F.to_json("extra").alias("extra"), F.lit(None).cast("string").alias("problem"))
    bad = parsed.where("problem IS NOT NULL").select("doc_id", "problem")
    return good.unionByName(bad, allowMissingColumns=True)


def _write_boxes(spark, sf_dir, folder):
    """Texts as gzip files, one folder per fifty documents."""
    documents = inputs.table(spark, sf_dir, "documents").selectExpr("text", f"{inputs.BOX} AS box")
    (documents.repartition("box").write.partitionBy("box").option("compression", "gzip")
     .option("lineSep", "\n").text(folder))


_BOX = r"box=([0-9]+)"


def gzip_lines(spark, sf_dir):
    folder = corpusplan.shared_dir(spark, "boxes")
    _write_boxes(spark, sf_dir, folder)
    lines = archives.read_gzip_text(spark, folder)
    return lines.select(F.regexp_extract("archive", _BOX, 1).cast("bigint").alias("box"), "line")


def _pack(group: pd.DataFrame, folder: str) -> pd.DataFrame:
    import io
    import tarfile

    path = f"{folder}/box-{group['box'].iloc[0]}.tgz"
    with streams.open_write(path) as stream, tarfile.open(fileobj=stream, mode="w|gz") as tar:
        for doc_id, body in zip(group["doc_id"], group["text"]):
            data = body.encode("utf-8")
            member = tarfile.TarInfo(f"texts/{doc_id}.txt")
            member.size = len(data)
            tar.addfile(member, io.BytesIO(data))
    return pd.DataFrame({"path": [path]})


def _pack_boxes(spark, sf_dir):
    """Tar archives of fifty documents each; returns their folder."""
    folder = inventory.qualified(spark, corpusplan.shared_dir(spark, "tars"))
    documents = inputs.table(spark, sf_dir, "documents").selectExpr("doc_id", "text", f"{inputs.BOX} AS box")
    packed = documents.groupBy("box").applyInPandas(lambda group: _pack(group, folder), "path string")
    packed.write.format("noop").mode("overwrite").save()
    return folder


def tar_lines(spark, sf_dir):
    files = inventory.list_files(spark, _pack_boxes(spark, sf_dir), pattern="*.tgz")
    return archives.tar_lines(files).select("member", "size", "number", "line")


def tar_checksums(spark, sf_dir):
    """Byte-exact pieces, checked by the checksum of members that are one piece."""
    files = inventory.list_files(spark, _pack_boxes(spark, sf_dir))
    return archives.tar_bytes(files).select("member", "size", "number", F.md5("data").alias("md5"))


def _box_mirror(spark, sf_dir):
    """(folder, family, links, requests) of a mirror with one gzip file per box."""
    base = corpusplan.shared_dir(spark, "mirror")
    mirror = f"{base}/mirror"
    _write_boxes(spark, sf_dir, f"{mirror}/boxes.example")
    own = corpusplan.standard_families().register(fam.PageFamily(
        "boxes", "0", "http://boxes.example/box={version}/", version_tag="",
        keep="endswith(href, '.gz')"))
    objects = inventory.mirror_objects(spark, mirror)
    listed = objects.select(
        F.regexp_extract("url", r"\A(.*/)[^/]*\z", 1).alias("page_url"), F.lit(0).alias("pos"),
        text.basename(F.col("url")).alias("href"))
    asked = inputs.table(spark, sf_dir, "documents").selectExpr(f"{inputs.BOX} AS box").distinct().selectExpr(
        "CAST(box AS INT) AS req_id", "'boxes-' || box AS dataset_id", "CAST(NULL AS STRING) AS language_pair",
        "CAST(NULL AS STRING) AS category", "CAST(NULL AS STRING) AS target_dir", "FALSE AS has_target_dir")
    return base, own, listed, asked


def _acquire_boxes(spark, sf_dir):
    """Two runs of the same batch over a mirror of gzip files."""
    base, own, listed, asked = _box_mirror(spark, sf_dir)
    data, log = f"{base}/data", f"{base}/ledger"
    twice = [runs.acquire(asked, listed, f"{base}/mirror", data, log, families=own) for _ in range(2)]
    return data, log, twice


def landing_mixed(spark, sf_dir):
    """Runs that skip, land and fail: the even boxes are there before, every third box links to
    a file that the mirror lacks."""
    base, own, listed, asked = _box_mirror(spark, sf_dir)
    broken = listed.where("try_cast(regexp_extract(page_url, 'box=([0-9]+)', 1) AS INT) % 3 = 0").select(
        "page_url", F.lit(1).alias("pos"), F.lit("missing.gz").alias("href")).distinct()
    links = _store(spark)(listed.unionByName(broken), "links")
    mirror, data, log = (f"{base}/{n}" for n in ("mirror", "data", "ledger"))
    runs.acquire(asked.where("req_id % 2 = 0"), listed, mirror, data, log, families=own)
    out = [
        runs.acquire(asked, links, mirror, data, log, families=own, force=force).outcomes.select(
            F.lit(force).alias("force"), "dataset_id", (F.col("filename") == "missing.gz").alias("missing"), "status",
            F.col("ts").isNotNull().alias("dated"), "error")
        for force in (False, True)
    ]
    return out[0].unionByName(out[1])


def landing_runs(spark, sf_dir):
    _, _, (first, second) = _acquire_boxes(spark, sf_dir)
    return first.outcomes.select(F.lit(1).alias("run"), "dataset_id", "status").unionByName(
        second.outcomes.select(F.lit(2).alias("run"), "dataset_id", "status"))


def landed_lines(spark, sf_dir):
    data, _, _ = _acquire_boxes(spark, sf_dir)
    lines = archives.read_gzip_text(spark, data)
    return lines.select(F.regexp_extract("archive", r"boxes-([0-9]+)", 1).cast("bigint").alias("box"), "line")


def landed_ledger(spark, sf_dir):
    """Ledger log after both runs, with the checksums of the files it names equal to
    those in the mirror."""
    data, log, (first, _) = _acquire_boxes(spark, sf_dir)
    entries = ledger.read_log(spark, log)
    ours = checksums.file_checksums(spark, data).select(F.col("path"), "md5")
    mirror = data.rsplit("/", 1)[0] + "/mirror"
    source = inventory.mirror_objects(spark, mirror).join(
        checksums.file_checksums(spark, mirror).select(F.col("path").alias("src_path"), "md5"), "src_path")
    same = entries.join(ours, "path").join(source.select("url", F.col("md5").alias("src_md5")), "url")
    return same.select(
        F.regexp_extract("url", _BOX, 1).cast("bigint").alias("box"),
        (F.col("md5") == F.col("src_md5")).alias("same"))


def _pack_all(group: pd.DataFrame, folder: str) -> pd.DataFrame:
    """Beside the tar archive a gzip file, a zip file and an archive that is cut short."""
    import gzip

    paths = _pack(group, folder)
    box = group["box"].iloc[0]
    with streams.open_read(paths["path"][0]) as stream:
        cut = stream.read(20)
    for name, data in ((f"box-{box}.tsv.gz", gzip.compress(b"box %d\n" % box)), (f"box-{box}.zip", b"PK"),
                       (f"cut-{box}.tar.gz", cut)):
        with streams.open_write(f"{folder}/{name}") as stream:
            stream.write(data)
    return paths


def unpacked_lines(spark, sf_dir):
    """Auto-unpacking: archives landed by a run, read member by member; those that do not
    unpack are rows without line."""
    base = corpusplan.shared_dir(spark, "tarmirror")
    mirror = inventory.qualified(spark, f"{base}/mirror")
    documents = inputs.table(spark, sf_dir, "documents").selectExpr("doc_id", "text", f"{inputs.BOX} AS box")
    folder = f"{mirror}/tars.example/all"
    packed = documents.groupBy("box").applyInPandas(lambda group: _pack_all(group, folder), "path string")
    packed.write.format("noop").mode("overwrite").save()
    own = corpusplan.standard_families().register(fam.PageFamily(
        "tars", "all", "http://tars.example/{version}/", keep="contains(href, '-')"))
    objects = inventory.mirror_objects(spark, mirror)
    listed = objects.select(
        F.lit("http://tars.example/all/").alias("page_url"), F.lit(0).alias("pos"),
        text.basename(F.col("url")).alias("href"))
    asked = request_source.single_request(spark, "tars")
    run = runs.acquire(asked, listed, mirror, f"{base}/data", families=own, single=True)
    errors = run.unpack_errors().select(text.basename(F.col("path")).alias("member"))
    return run.unpacked_lines().select("member", "number", "line").unionByName(errors, allowMissingColumns=True)


def catalogue_listing(spark, sf_dir):
    """What the catalogue says about the dataset each document asks for."""
    asked = inputs.seeds(spark, sf_dir).selectExpr("doc_id AS req_id", f"{inputs.CATALOGUE_ID} AS id")
    return asked.join(reports.catalogue_listing(catalogue.list_datasets(spark)), "id", "left").select(
        "req_id", "id", "description", "language_pairs", "categories")


def _written(batches):
    """Write files (path, data) as tasks of their own would."""
    for batch in batches:
        for path, data in batch[["path", "data"]].itertuples(index=False):
            with streams.open_write(path) as stream:
                stream.write(data)
        yield batch[["path"]]


def _write_files(files):
    """files(path, data) with qualified paths, by tasks."""
    files.mapInPandas(_written, "path string").write.format("noop").mode("overwrite").save()


# the files of each box: name and bytes for each of its documents
INVENTORY = {"plain.txt": 1, "_log/.hidden": 2, ".tmp/empty": 0, "a/b/c/_deep.gz": 3}


def file_inventory(spark, sf_dir):
    """What is found of hidden, empty and nested files, by level, by pattern and below a filtered path."""
    folder = inventory.qualified(spark, corpusplan.shared_dir(spark, "inventory"))
    boxes = inputs.table(spark, sf_dir, "documents").selectExpr(f"{inputs.BOX} AS box").groupBy("box").agg(F.count(F.lit(1)).alias("n"))
    kinds = F.explode(F.create_map(*[F.lit(x) for pair in INVENTORY.items() for x in pair])).alias("name", "times")
    rows = boxes.select("box", "n", kinds).repartition(spark.sparkContext.defaultParallelism, "box", "name")
    _write_files(rows.select(
        F.concat(F.lit(f"{folder}/box="), "box", F.lit("/"), "name").alias("path"),
        F.repeat(F.lit("x"), (F.col("n") * F.col("times")).cast("int")).cast("binary").alias("data")))
    everything = partial(inventory.list_files, spark, folder)
    asked = {
        "all": everything(recursive=True),
        "level": everything(pattern="*"),
        "hidden": everything(pattern="box=*/_*/.hid*"),
        "anywhere": everything(pattern="**/c/*.gz"),
        "below": everything(recursive=True).where(F.startswith("path", F.lit(f"{folder}/box=1"))),
    }
    out = None
    for name, files in asked.items():
        part = files.select(F.lit(name).alias("asked"), F.substring("path", len(folder) + 2, 1 << 30).alias("name"), "length", "is_dir")
        out = part if out is None else out.unionByName(part)
    return out


SAVED = "'/p' || page_id || '/' || CASE page_id % 4 WHEN 0 THEN '_a/' WHEN 1 THEN '.b/' WHEN 2 THEN 'c d+e%20/' ELSE '' END"


def saved_pages(spark, sf_dir):
    """The test pages saved as files, below folders of all kinds of names, and read again."""
    folder = inventory.qualified(spark, corpusplan.shared_dir(spark, "saved"))
    saved = inputs.table(spark, sf_dir, "pages").selectExpr(f"'{folder}/pages.example' || {SAVED} || 'index.html' AS path",
                                                            "CAST(coalesce(html, '') AS BINARY) AS data")
    _write_files(saved)
    return pages.read_saved_pages(spark, folder)


def landed_counts(spark, sf_dir):
    """Counts by status of two runs, as taken while files were copied and as counted from the outcomes."""
    _, _, twice = _acquire_boxes(spark, sf_dir)
    counted = spark.createDataFrame(
        [(n, s, c) for n, run in enumerate(twice, 1) for s, c in run.counts.items()], "run int, status string, counted long")
    read = None
    for n, run in enumerate(twice, 1):
        part = run.outcomes.groupBy("status").agg(F.count(F.lit(1)).alias("files")).select(F.lit(n).alias("run"), "status", "files")
        read = part if read is None else read.unionByName(part)
    return counted.join(read, ["run", "status"], "left").select("run", "status", "counted", F.coalesce("files", F.lit(0)).alias("files"))


ALL = {
    f.__name__: f for f in (
        page_anchors, resolve_ids, registry_pairs, europarl_files, news_files, wmt_categories, wmt_files,
        candidates, request_files, plan, plan_from_pages, plan_kept, single_layout, path_collisions, path_conflicts,
        missing_requests, batch_summary, fetch_outcomes, skip_existing, outcome_counts, attributed_outcomes,
        paths_by_dataset, archive_kind, ledger_latest, ledger_size, ledger_recent, ledger_json, text_checksums,
        rule_extension, batch_requests, gzip_lines, tar_lines, tar_checksums, landing_runs, landed_lines,
        landed_ledger, unpacked_lines, ledger_snapshot, landing_mixed, catalogue_listing,
        file_inventory, saved_pages, landed_counts, rule_extension_sql,
    )
} | {
    "fetch_outcomes_forced": partial(fetch_outcomes, force=True),
    "outcome_counts_forced": partial(outcome_counts, force=True),
}


def configured(query):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(corpusplan.configure(spark), sf_dir)
    return run


def queries():
    return {name: configured(query) for name, query in ALL.items()}
