import gzip
import hashlib
import io
import json
import tarfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusplan import acquire
from corpusplan.operators import checksums, landing, reports
from corpusplan.plans.acquire import page_links
from corpusplan.sources import archives, catalogue, inventory, ledger, streams
from corpusplan.sources.pages import read_saved_pages
from helpers import anchors, requests, values

EUROPARL = "http://statmt.org/europarl/v7/"
PAIRS = ["de-en", "fr-en", "es-en"]


def tar_bytes(members):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as tar:
        for name, data in members:
            info = tarfile.TarInfo(name)
            if data is None:
                info.type = tarfile.DIRTYPE
                tar.addfile(info)
            else:
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
    return out.getvalue()


@pytest.fixture
def mirror(tmp_path):
    folder = tmp_path / "mirror" / "statmt.org" / "europarl" / "v7"
    folder.mkdir(parents=True)
    for pair in PAIRS[:2]:
        (folder / f"{pair}-train.tgz").write_bytes(tar_bytes([(f"{pair}/x.txt", f"a {pair}\nb\n".encode())]))
    links = "".join(f'<a href="{p}-train.tgz">{p}</a>' for p in PAIRS)
    (folder / "index.html").write_text(f"<ul>{links}</ul>")
    return str(tmp_path / "mirror")


def run(spark, mirror, tmp_path, **options):
    pages = {EUROPARL: [f"{p}-train.tgz" for p in PAIRS]}
    asked = requests(spark, ("europarl-v7", {"target_dir": "ep"}), ("europarl-v99", {}))
    return acquire(asked, anchors(spark, pages), mirror, str(tmp_path / "data"), str(tmp_path / "ledger"), **options)


def test_two_runs(spark, mirror, tmp_path):
    first = run(spark, mirror, tmp_path)
    counts = Counter(r.status for r in first.outcomes.collect())
    assert counts == {"landed": 2, "failed": 1}
    assert first.outcomes.where("status = 'failed'").first().error.startswith("no object for ")
    assert [r.dataset_id for r in first.missing.collect()] == ["europarl-v99"]
    for pair in PAIRS[:2]:
        source = f"{mirror}/statmt.org/europarl/v7/{pair}-train.tgz"
        assert open(source, "rb").read() == (tmp_path / "data" / "ep" / f"{pair}-train.tgz").read_bytes()
    names = {p.name for p in (tmp_path / "data" / "ep").iterdir()}
    assert {n for n in names if not n.endswith(".crc")} == {f"{p}-train.tgz" for p in PAIRS[:2]}
    entries = ledger.read_log(spark, str(tmp_path / "ledger"))
    assert [r.url for r in entries.orderBy("url").collect()] == [EUROPARL + f"{p}-train.tgz" for p in PAIRS[:2]]

    second = run(spark, mirror, tmp_path)
    assert Counter(r.status for r in second.outcomes.collect()) == {"skipped": 2, "failed": 1}
    assert ledger.read_log(spark, str(tmp_path / "ledger")).count() == 2
    assert values(reports.paths_by_dataset(second.attributed), "url") == [
        (EUROPARL + f"{p}-train.tgz",) for p in PAIRS[:2]]

    forced = run(spark, mirror, tmp_path, force=True)
    assert Counter(r.status for r in forced.outcomes.collect()) == {"landed": 2, "failed": 1}
    assert values(forced.unpacked_lines(), "member", "number", "line") == [
        (f"{p}/x.txt", n, line) for p in PAIRS[:2] for n, line in enumerate([f"a {p}", "b"])]


def test_counts_add_up(spark, mirror, tmp_path):
    counts = reports.status_counts(run(spark, mirror, tmp_path).outcomes).first()
    assert counts.planned == counts.skipped + counts.landed + counts.failed == 3


def test_single_mode_from_saved_pages(spark, mirror, tmp_path):
    asked = requests(spark, ("europarl-v7", {"language_pair": "de-en"}))
    pages = read_saved_pages(spark, mirror)
    assert [r.url for r in pages.collect()] == [EUROPARL]
    done = acquire(asked, page_links(pages), mirror, str(tmp_path / "data"), single=True)
    assert (tmp_path / "data" / "de-en-train.tgz").exists()
    assert done.unpacked_lines().count() == 2  # unpacking covers single files as well


def test_a_copy_that_fails_leaves_nothing(spark, mirror, tmp_path):
    (tmp_path / "data").mkdir()
    (tmp_path / "data" / "ep").write_text("a file where the folder should be")
    outcomes = run(spark, mirror, tmp_path).outcomes
    assert Counter(r.status for r in outcomes.collect()) == {"failed": 3}
    assert (tmp_path / "data" / "ep").read_text() == "a file where the folder should be"


def test_unknown_id_and_empty_batch_raise(spark, mirror, tmp_path):
    source = anchors(spark, {EUROPARL: []})
    with pytest.raises(ValueError, match="zzz"):
        acquire(requests(spark, ("zzz", {})), source, mirror, str(tmp_path / "data"))
    with pytest.raises(ValueError, match="no files"):
        acquire(requests(spark, ("europarl", {})), source, mirror, str(tmp_path / "data"))


def test_attribution_of_shared_paths(spark):
    plan = spark.createDataFrame([(0, "a", "u1", "p"), (1, "b", "u1", "p"), (2, "b", "u2", "p")],
                                 "req_id int, dataset_id string, url string, output_path string")
    outcomes = spark.createDataFrame([("u1", "p", "landed", None)],
                                     "url string, output_path string, status string, error string")
    assert values(landing.attribute(plan, outcomes), "req_id", "status", "error") == [
        (0, "landed", None), (1, "landed", None), (2, "collision", "path taken by u1")]


@pytest.mark.parametrize("force", [False, True])
def test_status_from_inventories(spark, mirror, tmp_path, force):
    data = tmp_path / "data"
    data.mkdir()
    (data / "de-en-train.tgz").write_bytes(b"")  # existence alone counts
    plan = spark.createDataFrame(
        [(EUROPARL + f"{p}-train.tgz", f"file:{data}/{p}-train.tgz") for p in PAIRS], "url string, output_path string")
    status = landing.fetch_status(
        plan, inventory.existing_paths(spark, str(data)), inventory.mirror_objects(spark, mirror), force)
    assert values(status, "url", "status") == sorted(zip(
        [EUROPARL + f"{p}-train.tgz" for p in PAIRS], ["landed" if force else "skipped", "landed", "failed"]))


def test_list_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a.gz", "b.txt", ".hidden", "sub/c.gz"):
        (tmp_path / name).write_text("x")

    def names(**options):
        files = inventory.list_files(spark, str(tmp_path), **options)
        return sorted(r.path.rsplit("/", 1)[1] for r in files.collect())

    assert names() == [".hidden", "a.gz", "b.txt"]
    assert names(recursive=True) == [".hidden", "a.gz", "b.txt", "c.gz"]
    assert names(pattern="*") == [".hidden", "a.gz", "b.txt", "sub"]
    assert names(pattern="*.gz") == ["a.gz"]
    assert names(pattern="**/*.gz") == ["a.gz", "c.gz"]
    assert names(pattern="sub/*") == ["c.gz"]
    assert names(pattern="*/c.gz") == names(pattern="su*/*") == names(pattern="[st]ub/?.gz") == ["c.gz"]
    assert names(pattern="**/sub/*.gz") == names(pattern="*/*") == ["c.gz"] and names(pattern="x*/c.gz") == []
    assert names(pattern="*.none") == []
    assert inventory.list_files(spark, str(tmp_path / "none")).count() == 0


def test_a_deep_tree_is_listed_by_several_tasks(spark, tmp_path):
    want = set()
    for i in range(12):
        name = f"host/set/v1/part{i}/a/b/c/file"
        (tmp_path / name).parent.mkdir(parents=True)
        (tmp_path / name).write_text("x")
        want.add(name)
    files = inventory.list_files(spark, str(tmp_path), recursive=True).withColumn("task", F.spark_partition_id()).collect()
    assert {r.path[len(f"file:{tmp_path}/"):] for r in files} == want
    assert len({r.task for r in files}) > 3


def test_file_checksums(spark, tmp_path):
    bodies = {"a b.bin": b"\x00\xff" * 5000, "ü.txt": b"", "a/b/c/d/e/deep": b"xyz", "_hidden": b"1", "a/b/.x": b"2"}
    for name, body in bodies.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body)
    got = checksums.file_checksums(spark, str(tmp_path)).collect()
    assert {r.path[len(f"file:{tmp_path}/"):]: (r.length, r.md5) for r in got} == {
        n: (len(b), hashlib.md5(b).hexdigest()) for n, b in bodies.items()}
    one = checksums.file_checksums(spark, str(tmp_path / "a b.bin")).collect()
    assert [r.md5 for r in one] == [hashlib.md5(bodies["a b.bin"]).hexdigest()]


def test_checksum_of_missing_file_raises(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        checksums.file_checksums(spark, str(tmp_path / "none"))


def test_gzip_text(spark, tmp_path):
    with gzip.open(tmp_path / "x.tsv.gz", "wb") as out:
        out.write("a\tb\nc\td\r\n\n".encode())
    (tmp_path / "y.tar.gz").write_bytes(tar_bytes([("m", b"no")]))
    rows = archives.read_gzip_text(spark, str(tmp_path))
    assert values(rows, "member", "line") == [("x.tsv", ""), ("x.tsv", "a\tb"), ("x.tsv", "c\td\r")]


def test_hidden_and_odd_gzip_names(spark, tmp_path):
    for name in ("_x.gz", ".y.gz", "x y%20+.tsv.gz", "sub/_z.gz"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(gzip.compress(name.encode()))
    rows = archives.read_gzip_text(spark, str(tmp_path))
    assert values(rows, "member", "line") == [
        (".y", ".y.gz"), ("_x", "_x.gz"), ("_z", "sub/_z.gz"), ("x y%20+.tsv", "x y%20+.tsv.gz")]
    (tmp_path / "cut.gz").write_bytes(gzip.compress(b"text" * 1000)[:30])
    with pytest.raises(Exception, match="cut.gz"):
        archives.read_gzip_text(spark, str(tmp_path)).collect()


def test_broken_archives_are_rows(spark, tmp_path):
    good = tar_bytes([("a", b"x\n")])
    (tmp_path / "good.tgz").write_bytes(good)
    (tmp_path / "cut.tgz").write_bytes(good[:20])
    (tmp_path / "junk.tar.gz").write_bytes(b"junk")
    with tarfile.open(tmp_path / "links.tgz", "w:gz") as tar:
        for name, kind in (("soft", tarfile.SYMTYPE), ("hard", tarfile.LNKTYPE)):
            info = tarfile.TarInfo(name)
            info.type, info.linkname = kind, "a"
            tar.addfile(info)
    rows = archives.tar_lines(inventory.list_files(spark, str(tmp_path))).collect()
    assert sorted((r.archive.rsplit("/", 1)[1], r.member, r.line, r.link) for r in rows if not r.error) == [
        ("good.tgz", "a", "x", None), ("links.tgz", "hard", None, "a"), ("links.tgz", "soft", None, "a")]
    assert sorted(r.archive.rsplit("/", 1)[1] for r in rows if r.error) == ["cut.tgz", "junk.tar.gz"]


def test_pages_below_hidden_folders(spark, tmp_path):
    for name in ("h/_a/index.html", "h/.b/index.html", "h/c/index.html", "h/_index.html"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"" if "c" in name else b"\xff" + name.encode())
    assert values(read_saved_pages(spark, str(tmp_path)), "url", "html") == sorted([
        ("http://h/_a/", "\ufffdh/_a/index.html"), ("http://h/.b/", "\ufffdh/.b/index.html"), ("http://h/c/", "")], key=repr)


def test_pages_at_odd_addresses(spark, tmp_path):
    for name in ("host/a+b/index.html", "host/c d/dev.html"):
        (tmp_path / name).parent.mkdir(parents=True)
        (tmp_path / name).write_text(name)
    assert values(read_saved_pages(spark, str(tmp_path)), "url") == [("http://host/a+b/",)]
    assert values(read_saved_pages(spark, str(tmp_path), "*.html"), "url") == [
        ("http://host/a+b/",), ("http://host/c d/dev.html",)]


def test_paths_name_a_file_system(spark, mirror, tmp_path):
    pages = anchors(spark, {EUROPARL: [f"{p}-train.tgz" for p in PAIRS]})
    place = tmp_path / "abs"
    asked = requests(spark, ("europarl-v7", {"target_dir": str(place)}), ("europarl-v7", {"target_dir": f"file:{place}"}),
                     ("europarl-v7", {"target_dir": f"file://{place}"}))
    for single in (False, True):
        done = acquire(asked, pages, mirror, str(tmp_path / "data"), single=single)
        assert all(r.output_path.startswith("file:/") for r in done.outcomes.collect())
    assert done.collisions.count() == 6  # one place, however it is written
    for scheme in ("nosuch://host/x", "dbfs:/x"):
        with pytest.raises(ValueError, match="cannot write"):
            acquire(requests(spark, ("europarl-v7", {"target_dir": scheme})), pages, mirror, str(tmp_path / "d"), single=True)


def test_short_copy_fails(tmp_path):
    (tmp_path / "a").write_bytes(b"12345")
    attempt, size = streams.stage(str(tmp_path / "a"), str(tmp_path / "b"), 5)
    streams.publish(attempt, str(tmp_path / "b"))
    assert size == 5 and (tmp_path / "b").read_bytes() == b"12345"
    with pytest.raises(OSError, match="5 of 6"):
        streams.stage(str(tmp_path / "a"), str(tmp_path / "c"), 6)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a", "b"]


def test_ledger_learns_of_files_a_lost_run_left(spark, mirror, tmp_path):
    first = run(spark, mirror, tmp_path)
    dated = {r.url: r.ts for r in first.outcomes.where("status = 'landed'").collect()}
    (tmp_path / "ledger").rename(tmp_path / "lost")
    run(spark, mirror, tmp_path)
    assert {r.url: r.ts for r in ledger.read_log(spark, str(tmp_path / "ledger")).collect()} == dated


def test_tar_members(spark, tmp_path):
    big = bytes(range(256)) * 10000
    members = [("d", None), ("d/a.txt", "é\n\nlast".encode()), ("../../evil", b"out\n"), ("empty", b""), ("big", big)]
    (tmp_path / "x.tar.gz").write_bytes(tar_bytes(members))
    (tmp_path / "y.zip").write_bytes(b"PK")
    files = inventory.list_files(spark, str(tmp_path))
    lines = archives.tar_lines(files).where("member <> 'big'")
    assert values(lines.where("line IS NOT NULL"), "member", "size", "number", "line") == [
        ("../../evil", 4, 0, "out"), ("d/a.txt", 8, 0, "é"), ("d/a.txt", 8, 1, ""), ("d/a.txt", 8, 2, "last")]
    assert values(lines.where("line IS NULL"), "member", "size", "number", "error") == [("empty", 0, None, None)]
    pieces = archives.tar_bytes(files).where("member = 'big'").orderBy("number").collect()
    assert b"".join(p.data for p in pieces) == big and len(pieces) == 3
    assert [r.error for r in archives.unpack_errors(files).collect()] == ["unsupported archive: y.zip"]
    assert not (tmp_path.parent.parent / "evil").exists()


def test_json_ledger(spark, tmp_path):
    path = tmp_path / "ledger.json"
    assert ledger.read_json_ledger(spark, str(path)).count() == 0
    path.write_text(json.dumps({"downloads": {"u": {"path": "p", "timestamp": 5}}, "datasets": {}}))
    assert [tuple(r) for r in ledger.read_json_ledger(spark, str(path)).collect()] == [("u", "p", 5)]
    whole = path.read_text()
    for broken in ('{"downloads": {"u"', "", "[]", "{}", whole + " junk", whole + "} {", whole + ', "v": 1'):
        path.write_text(broken)
        assert ledger.read_json_ledger(spark, str(path)).count() == 0


def test_ledger_log(spark, tmp_path):
    log = str(tmp_path / "log")

    def entries(*rows):
        return spark.createDataFrame(list(rows), ledger.LEDGER)

    assert ledger.read_log(spark, log).count() == 0
    ledger.append_batch(entries(("u", "p", 1), ("v", "q", 1)), log, "1")
    ledger.append_batch(entries(("u", "p2", 2)), log, "2")
    ledger.append_batch(entries(("u", "p2", 2)), log, "2")
    state = values(ledger.read_log(spark, log), "url", "path", "ts")
    assert state == [("u", "p2", 2), ("v", "q", 1)]
    ledger.write_snapshot(ledger.read_log(spark, log), str(tmp_path / "snapshot"))
    assert values(ledger.read_log(spark, str(tmp_path / "snapshot")), "url", "path", "ts") == state
    ledger.append_batch(entries(("w", "r", 3), ("v", "a", 1)), str(tmp_path / "snapshot"), "3")
    # nothing of the fold is lost, and of equal times the later batch counts
    assert values(ledger.read_log(spark, str(tmp_path / "snapshot")), "url", "path", "ts") == [
        ("u", "p2", 2), ("v", "a", 1), ("w", "r", 3)]
    with pytest.raises(Exception):
        ledger.write_snapshot(ledger.read_log(spark, log), str(tmp_path / "snapshot"))
    assert values(reports.ledger_recent(ledger.read_log(spark, log)), "name") == [("p2",), ("q",)]
    assert reports.ledger_size(ledger.read_log(spark, log)).first().entries == 2


def test_catalogue(spark):
    listing = reports.catalogue_listing(catalogue.list_datasets(spark))
    assert listing.count() == 4
    assert listing.where("id = 'wmt14'").first().categories == "training-monolingual, training-parallel, test"
    asked = spark.createDataFrame([("europarl-v7",), ("wmt14",), ("zzz",)], "dataset_id string")
    pairs = reports.language_pairs(asked, catalogue.list_datasets(spark)).select("dataset_id", F.size("language_pairs"))
    assert values(pairs, "*") == [("europarl-v7", 5), ("wmt14", 0), ("zzz", 0)]
