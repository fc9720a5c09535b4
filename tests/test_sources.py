"""The inventory source and the object sink, on their own and through Spark."""

import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, StringStartsWith
from pyspark.sql.types import Row, StructType

from corpusplan.sources import inventory, objects, streams

FILES = ["x.gz", ".h", "a/x.gz", "a/_e/y.txt", "a/.b/x.gz", "b/c/d/e/x.gz", "b/c/z", "_q/x.gz"]


@pytest.fixture
def tree(tmp_path):
    for n, name in enumerate(FILES):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * n)
    return f"file:{tmp_path}"


def reader(root, **options):
    return inventory.Inventory({"path": root, **options}).reader(None)


def folders(found, root):
    return sorted((path[len(root):], deeper) for p in found.partitions() for path, deeper in p.value)


def names(found, root):
    rows = [r for p in found.partitions() for batch in found.read(p) for r in batch.to_pylist()]
    return sorted(r["path"][len(root) + 1:] for r in rows)


def test_folders_are_dealt_and_nothing_is_lost(tree):
    for tasks in ("1", "2", "5", "100"):
        assert names(reader(tree, recursive="true", tasks=tasks), tree) == sorted(FILES)
    assert folders(reader(tree, tasks="9"), tree) == [("", False)]
    assert names(reader(tree), tree) == [".h", "x.gz"]


def test_a_pattern_spares_folders(tree):
    found = reader(tree, pattern="b/*/z", tasks="50")
    assert folders(found, tree) == [("", False), ("/b", False), ("/b/c", False)]
    assert names(found, tree) == ["b/c/z"]
    assert names(reader(tree, pattern="x.gz", recursive="true"), tree) == sorted(n for n in FILES if n.endswith("x.gz"))
    assert names(reader(tree, pattern="c/?", recursive="true"), tree) == ["b/c/d", "b/c/z"]
    assert names(reader(tree, pattern=""), tree) == []


def test_filters_on_the_path_spare_folders(tree):
    found = reader(tree, recursive="true", tasks="50")
    other = EqualTo(("is_dir",), False)
    assert list(found.pushFilters([StringStartsWith(("path",), f"{tree}/a/."), other])) == [other]
    assert folders(found, tree) == [("", False), ("/a", False), ("/a/.b", False)]
    assert names(found, tree) == ["a/.b/x.gz"]
    found = reader(tree, recursive="true", tasks="50")
    assert list(found.pushFilters([EqualTo(("path",), f"{tree}/b/c/z"), StringStartsWith(("path",), f"{tree}/b")])) == []
    assert names(found, tree) == ["b/c/z"]
    assert ("/a", False) not in folders(found, tree)


def test_a_file_or_nothing_in_the_folders_place(tree):
    assert names(reader(f"{tree}/x.gz"), tree) == ["x.gz"]
    assert names(reader(f"{tree}/none", recursive="true"), tree) == []
    gone = reader(tree, recursive="true", tasks="50")
    assert [b.num_rows for b in gone.read(inventory.Folders([(f"{tree}/gone", True)]))] == [0]


def test_through_spark(spark, tree):
    files = inventory.list_files(spark, tree[len("file:"):], recursive=True)
    assert {r.path: r.length for r in files.collect()} == {f"{tree}/{n}": i for i, n in enumerate(FILES)}
    below = files.where(F.startswith("path", F.lit(f"{tree}/a/"))).where("length > 2")
    plan = below._jdf.queryExecution().executedPlan().toString()
    assert "StartsWith(path" not in plan.split("BatchScan")[0]  # settled by the source
    assert sorted(r.path[len(tree):] for r in below.collect()) == ["/a/.b/x.gz", "/a/_e/y.txt"]


SCHEMA = StructType().add("req_id", "long").add("src_path", "string").add("output_path", "string").add("length", "long")


def row(n, source, target, length=None):
    return Row(req_id=n, src_path=str(source), output_path=str(target), length=length)


def test_a_task_and_its_commit(tmp_path):
    (tmp_path / "s").write_bytes(b"12345")
    writer = objects.Objects({"outcomes": f"file:{tmp_path}/out"}).writer(SCHEMA, False)
    message = writer.write(iter([row(1, tmp_path / "s", tmp_path / "d/one", 5), row(2, tmp_path / "s", tmp_path / "d/two", 6),
                                 row(3, tmp_path / "none", tmp_path / "d/three")]))
    assert (message.landed, message.failed, message.bytes) == (1, 2, 5)
    assert message.length == os.path.getsize(message.path[len("file:"):]) and message.mtime > 0
    assert [p.name for p in (tmp_path / "d").iterdir()] == ["one"]
    assert not [p for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")]
    empty = writer.write(iter([]))
    writer.commit([message, empty, None])
    shown = sorted(p.name.split("-")[0] for p in (tmp_path / "out").iterdir() if p.suffix == ".parquet")
    assert shown == ["part", "part"]
    assert json.loads((tmp_path / "out" / "_counts.json").read_bytes()) == {"landed": 1, "failed": 2, "bytes": 5}


@pytest.mark.parametrize("place", ["rows", "name", "part"])
def test_a_task_that_fails_leaves_nothing(tmp_path, monkeypatch, place):
    class Lost(BaseException):
        pass

    def fail(*_, **__):
        raise Lost

    def rows():
        for n in range(4):
            yield row(n, tmp_path / "s", tmp_path / f"d/{n}", 5)
        if place == "rows":
            fail()

    (tmp_path / "s").write_bytes(b"12345")
    writer = objects.Objects({"outcomes": f"file:{tmp_path}/out"}).writer(SCHEMA, False)
    if place == "name":
        calls = []
        real = streams.publish
        monkeypatch.setattr(objects, "publish", lambda *a: fail() if len(calls) == 2 else (calls.append(a), real(*a)))
    if place == "part":
        monkeypatch.setattr(objects.pq, "write_table", fail)
    with pytest.raises(Lost):
        writer.write(rows())
    assert list((tmp_path / "d").iterdir()) == []


def test_abort_and_a_part_that_is_not_as_written(tmp_path):
    (tmp_path / "s").write_bytes(b"12345")
    writer = objects.Objects({"outcomes": f"file:{tmp_path}/out"}).writer(SCHEMA, False)
    message = writer.write(iter([row(1, tmp_path / "s", tmp_path / "one", 5)]))
    with open(message.path[len("file:"):], "ab") as part:
        part.write(b"x")
    with pytest.raises(OSError, match="not as it was"):
        writer.commit([message])
    writer.abort([message, None])
    assert list((tmp_path / "out").iterdir()) == [] and (tmp_path / "one").exists()


def test_objects_through_spark(spark, tmp_path):
    (tmp_path / "s").write_bytes(b"12345")
    rows = spark.createDataFrame([row(n, tmp_path / ("s" if n % 3 else "none"), tmp_path / f"d/{n}", 5) for n in range(9)], SCHEMA)
    outcomes, counts = objects.write_objects(rows.repartition(4), f"file:{tmp_path}/out")
    assert counts == {"landed": 6, "failed": 3, "bytes": 30}
    assert outcomes.columns == ["req_id", "src_path", "output_path", "status", "error", "length", "ts"]
    assert {r.req_id: (r.status, r.length, r.ts is not None) for r in outcomes.collect()} == {
        n: ("landed", 5, True) if n % 3 else ("failed", None, False) for n in range(9)}
    assert outcomes.where("status = 'failed'").first().error.startswith("FileNotFoundError")
    none, counts = objects.write_objects(rows.where("req_id < 0"), f"file:{tmp_path}/none")
    assert none.count() == 0 and counts == {"landed": 0, "failed": 0, "bytes": 0}
