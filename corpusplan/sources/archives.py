"""Compressed corpora as rows."""

import gzip
import tarfile
import zlib
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusplan.functions.archive import archive_kind
from corpusplan.functions.text import basename
from corpusplan.sources.inventory import list_files
from corpusplan.sources.streams import open_read

_ROWS = 4096
_BYTES = 8 << 20
_PIECE = 1 << 20
# a task unpacks about this many compressed bytes
_TASK_BYTES = 256 << 20
_BROKEN = (OSError, EOFError, tarfile.TarError, zlib.error, ValueError)


def _tar_members(path, stream):
    with tarfile.open(fileobj=stream, mode="r|gz") as tar:
        for member in tar:
            if member.isfile():
                yield member.name, member.size, None, tar.extractfile(member)
            elif member.issym() or member.islnk():
                yield member.name, 0, member.linkname, None


def _gzip_member(path, stream):
    yield path.rsplit("/", 1)[-1].removesuffix(".gz"), None, None, gzip.GzipFile(fileobj=stream)


def _lines(data):
    for line in data:
        yield line.rstrip(b"\n").decode("utf-8", "replace")


def _pieces(data):
    while piece := data.read(_PIECE):
        yield piece


def _rows(path, kind, cut):
    """(archive, member, size, number, value, link, error): the parts of every member in order.

    A member without parts is one row without number and value, and so is a link. What is
    broken ends with a row that has only the archive and the error.
    """
    try:
        with open_read(path) as stream:
            for name, size, link, data in (_tar_members if kind == "tar" else _gzip_member)(path, stream):
                number = -1
                for number, value in enumerate(cut(data) if data else ()):
                    yield path, name, size, number, value, link, None
                if number < 0:
                    yield path, name, size, None, None, link, None
    except _BROKEN as problem:
        yield path, None, None, None, None, None, f"{type(problem).__name__}: {problem}"


def _expand(batches, cut, columns):
    held, size = [], 0

    def frame():
        out = pd.DataFrame(held, columns=columns)
        out[["size", "number"]] = out[["size", "number"]].astype("Int64")
        return out

    for batch in batches:
        for path, kind in zip(batch["path"], batch["kind"]):
            for row in _rows(path, kind, cut):
                held.append(row)
                size += len(row[4] or "")
                if len(held) == _ROWS or size >= _BYTES:
                    yield frame()
                    held, size = [], 0
    if held:
        yield frame()


def _expanded(files: DataFrame, tasks, kinds, cut, value: str) -> DataFrame:
    columns = ["archive", "member", "size", "number", value.split()[0], "link", "error"]
    schema = f"archive string, member string, size bigint, number bigint, {value}, link string, error string"
    kind = archive_kind(F.col("path"))
    known = [c for c in ("path", "length") if c in files.columns]
    archives = files.select(*known, kind.alias("kind")).where(F.col("kind").isin(*kinds))
    tasks = tasks or tasks_for(archives, _TASK_BYTES)
    return archives.repartition(tasks).mapInPandas(partial(_expand, cut=cut, columns=columns), schema)


def tasks_for(files: DataFrame, task_bytes: int) -> int:
    """How many tasks to deal files over: by their bytes where `length` is known, at least as many as run at once."""
    least = files.sparkSession.sparkContext.defaultParallelism
    if "length" not in files.columns:
        return least
    return max(least, -(-(files.agg(F.sum("length")).first()[0] or 0) // task_bytes))


def archive_lines(files: DataFrame, tasks: int | None = None) -> DataFrame:
    """files(path[, length]) -> lines of every member of the tar and gzip archives among them.

    Columns: archive, member, size (NULL for gzip), number, line, link, error. A member without
    lines and a link (with its target in `link`) are one row without number and line; an archive
    that cannot be read to its end ends in a row with `error`. Bytes that are not UTF-8 become
    replacement characters; `tar_bytes` has them as they are.

    Archives are read as streams: of an archive no more than a line is held at once (a member
    without line ends is one line), and nothing is written, so member names cannot reach
    outside. A gzip stream cannot be split; archives run side by side on `tasks` tasks.
    """
    return _expanded(files, tasks, ("tar", "gzip"), _lines, "line string")


def tar_lines(files: DataFrame, tasks: int | None = None) -> DataFrame:
    """As `archive_lines`, for the tar archives alone."""
    return _expanded(files, tasks, ("tar",), _lines, "line string")


def tar_bytes(files: DataFrame, tasks: int | None = None) -> DataFrame:
    """As `tar_lines`, but byte-exact: members as numbered pieces of at most 1 MiB."""
    return _expanded(files, tasks, ("tar",), _pieces, "data binary")


def read_gzip_text(spark: SparkSession, path: str, tasks: int | None = None) -> DataFrame:
    """Lines of the gzip text files below a folder, hidden ones too, with the name each unpacks
    to. A file that cannot be read to its end raises."""
    files = list_files(spark, path, recursive=True).select("path", "length")
    lines = _expanded(files, tasks, ("gzip",), _lines, "line string")
    checked = F.when(F.col("error").isNull(), F.col("line")).otherwise(
        F.raise_error(F.concat("archive", F.lit(": "), "error")))
    return lines.where("number IS NOT NULL OR error IS NOT NULL").select("archive", "member", checked.alias("line"))


def unpack_errors(files: DataFrame) -> DataFrame:
    """Archives whose form is attempted but never works."""
    return files.where(archive_kind(F.col("path")) == "unsupported").select(
        "path", F.concat(F.lit("unsupported archive: "), basename(F.col("path"))).alias("error"))
