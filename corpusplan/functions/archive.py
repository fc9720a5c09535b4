"""Column functions on archive names."""

from pyspark.sql import Column, functions as F

from corpusplan import known
from corpusplan.functions.text import basename, ends_with_any


def is_archive(name: Column) -> Column:
    """Whether unpacking is attempted at all."""
    return ends_with_any(name, known.ARCHIVE_SUFFIXES)


def archive_kind(path: Column) -> Column:
    """`tar`, `gzip`, `unsupported` (attempted but always an error) or `none`."""
    name = basename(path)
    return (
        F.when(ends_with_any(name, (".tar.gz", ".tgz")), "tar")
        .when(F.endswith(name, F.lit(".gz")), "gzip")
        .when(is_archive(name), "unsupported")
        .otherwise("none")
    )


def unpacked_name(path: Column) -> Column:
    """Name of the single file inside a gzip file, NULL for anything else."""
    name = basename(path)
    return F.when(archive_kind(path) == "gzip", F.regexp_replace(name, r"[.]gz\z", ""))
