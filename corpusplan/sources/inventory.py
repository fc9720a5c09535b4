"""Files in storage as tables.

Spark's own file sources leave out empty files and names that start with `.` or `_`. The `corpus_files`
source leaves nothing out: folders are its input partitions, and a pattern, or a filter on the path, keeps it
from looking into folders that can hold no match.
"""

from collections import deque
from fnmatch import fnmatchcase

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition, StringStartsWith

from corpusplan.session import use_source
from corpusplan.sources.streams import locate

_FILE = "path string, modificationTime timestamp, length bigint, is_dir boolean"
_ARROW = pa.schema([("path", pa.string()), ("modificationTime", pa.timestamp("us", "UTC")),
                    ("length", pa.int64()), ("is_dir", pa.bool_())])
_ROWS = 8192
# the planner looks into so many folders at most to find others to deal out
MOST_FOLDERS = 1024


def _hadoop_path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme and without a trailing slash."""
    target, system = _hadoop_path(spark, path)
    return system.makeQualified(target).toString()


def file_system_root(spark: SparkSession, path: str) -> str:
    """Scheme and authority of the path's file system, as `file:` or `hdfs://name:port`."""
    return qualified(spark, _hadoop_path(spark, path)[0].getFileSystem(
        spark._jsc.hadoopConfiguration()).getUri().toString() + "/").rstrip("/")


def path_exists(spark: SparkSession, path: str) -> bool:
    target, system = _hadoop_path(spark, path)
    return system.exists(target)


def require_path(spark: SparkSession, path: str) -> None:
    if not path_exists(spark, path):
        raise FileNotFoundError(path)


class Folders(InputPartition):
    """Folders for one task: (path, whether to go into the folders below)."""

    def __init__(self, folders: list[tuple[str, bool]]):
        super().__init__(folders)


class Inventory(DataSource):
    """`spark.read.format("corpus_files")`: path, modificationTime, length and is_dir of what a folder holds.

    Options: `path` (with its scheme), `pattern` (folders and a name, each with `*`, `?` and `[...]`), `recursive`, and
    `tasks`, the number of partitions to aim at.
    """

    @classmethod
    def name(cls):
        return "corpus_files"

    def schema(self):
        return _FILE

    def reader(self, schema):
        return InventoryReader(self.options)


class InventoryReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"].rstrip("/")
        self.recursive = options.get("recursive", "false").lower() == "true"
        self.parts = options["pattern"].split("/") if "pattern" in options else None
        self.tasks = max(1, int(options.get("tasks", "1")))
        self.start, self.only = "", None

    def pushFilters(self, filters):
        """What is asked of the path is tested here, and spares the folders it rules out; the rest is Spark's."""
        for f in filters:
            if isinstance(f, StringStartsWith) and f.attribute == ("path",) and not self.start:
                self.start = f.value
            elif isinstance(f, EqualTo) and f.attribute == ("path",) and self.only is None:
                self.only = f.value
            else:
                yield f

    def _matches(self, names: list[str]) -> bool:
        return all(fnmatchcase(name, part) for name, part in zip(names, self.parts))

    def enters(self, path: str, names: list[str]) -> bool:
        """Whether a folder, `names` below the root, may hold what is asked for."""
        inside = path + "/"
        if self.only is not None and not self.only.startswith(inside):
            return False
        if not (inside.startswith(self.start) or self.start.startswith(inside)):
            return False
        return self.recursive or self.parts is not None and len(names) < len(self.parts) and self._matches(names)

    def wants(self, path: str, names: list[str], is_dir: bool) -> bool:
        if not path.startswith(self.start) or self.only not in (None, path):
            return False
        if self.parts is None:
            return not is_dir
        if self.recursive:
            return len(names) >= len(self.parts) and self._matches(names[-len(self.parts):])
        return len(names) == len(self.parts) and self._matches(names)

    def content(self, folder: str):
        """(path, names below the root, entry) of what is in a folder that may be gone by now."""
        system, name = locate(folder)
        cut = len(name.rstrip("/")) + 1
        for info in system.get_file_info(fs.FileSelector(name, allow_not_found=True)):
            path = f"{folder}/{info.path[cut:]}"
            yield path, path[len(self.root) + 1:].split("/"), info

    def partitions(self):
        """Folders dealt over tasks, from the root down until there are enough or nothing is left to look into.

        The planner keeps names of folders only; what is in them is listed by the tasks.
        """
        system, name = locate(self.root)
        if system.get_file_info(name.rstrip("/") or "/").type != fs.FileType.Directory:
            return [Folders([(self.root, False)])]
        looked, todo, enough = [], deque([self.root]), min(4 * self.tasks, MOST_FOLDERS)
        while todo and len(todo) < enough and len(looked) < MOST_FOLDERS:
            looked.append(todo.popleft())
            todo.extend(path for path, names, info in self.content(looked[-1])
                        if info.type == fs.FileType.Directory and self.enters(path, names))
        dealt = [(f, False) for f in looked] + [(f, True) for f in todo]
        tasks = min(self.tasks, len(dealt))
        return [Folders(dealt[i::tasks]) for i in range(tasks)]

    def read(self, partition):
        rows = []
        for folder, deeper in partition.value:
            for row in self._rows(folder, deeper):
                rows.append(row)
                if len(rows) >= _ROWS:
                    yield _batch(rows)
                    rows = []
        yield _batch(rows)

    def _rows(self, folder, deeper):
        system, name = locate(folder)
        itself = system.get_file_info(name.rstrip("/") or "/")
        if itself.type == fs.FileType.File:  # a file in the root's place
            if self.wants(folder, [folder.rsplit("/", 1)[-1]], False):
                yield folder, itself.mtime, itself.size, False
            return
        todo = [folder] if itself.type == fs.FileType.Directory else []
        while todo:  # folder by folder: no more than one folder's list is held
            for path, names, info in self.content(todo.pop()):
                is_dir = info.type == fs.FileType.Directory
                if deeper and is_dir and self.enters(path, names):
                    todo.append(path)
                if self.wants(path, names, is_dir):
                    yield path, info.mtime, None if is_dir else info.size, is_dir


def _batch(rows):
    columns = zip(*rows) if rows else [[]] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


def list_files(spark: SparkSession, directory: str, pattern: str | None = None,
               recursive: bool = False) -> DataFrame:
    """path, modificationTime, length and is_dir; contents are not read.

    A folder that is not there gives no rows. Without a pattern only regular files
    are listed. A pattern tests names, folders' too; it may start with folders, themselves
    patterns if need be. With `**/` before it, or `recursive`, it is looked for at every level. Filters on
    `path` (equality, a common beginning) spare the folders they rule out.
    """
    use_source(spark, Inventory)
    if pattern and pattern.startswith("**/"):
        recursive, pattern = True, pattern[3:]
    options = {"path": qualified(spark, directory), "recursive": str(recursive), "tasks": str(4 * spark.sparkContext.defaultParallelism)}
    if pattern is not None:
        options["pattern"] = pattern
    return spark.read.format("corpus_files").options(**options).load()


def existing_paths(spark: SparkSession, directory: str) -> DataFrame:
    """output_path of every file below a folder, for the skip test."""
    return list_files(spark, directory, recursive=True).select(F.col("path").alias("output_path"))


def mirror_objects(spark: SparkSession, mirror_dir: str, scheme: str = "http://") -> DataFrame:
    """objects(url, src_path, length) of a mirror laid out as host/path.

    Addresses come from paths one to one, so each is there once.
    """
    root = qualified(spark, mirror_dir) + "/"
    files = list_files(spark, mirror_dir, recursive=True)
    rest = F.substring("path", len(root) + 1, 1 << 30)
    return files.select(F.concat(F.lit(scheme), rest).alias("url"), F.col("path").alias("src_path"), "length")
