"""Column functions on names and paths."""

from functools import reduce

from pyspark.sql import Column, functions as F

# Everything before the last extension; a name that only starts with dots has none.
_STEM = r"(?s)\A((?:.*/)?[.]*[^./][^/]*)[.][^./]*\z"


def nonempty(value: Column) -> Column:
    """NULL for an empty string: missing and empty mean the same at the edge."""
    return F.nullif(value, F.lit(""))


def any_of(tests) -> Column:
    return reduce(lambda a, b: a | b, tests)


def ends_with_any(text: Column, suffixes) -> Column:
    return any_of([F.endswith(text, F.lit(s)) for s in suffixes])


def strip_slashes(text: Column) -> Column:
    """Without its trailing slashes."""
    return F.regexp_replace(text, r"/+\z", "")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*\z", "")


def stem(name: Column) -> Column:
    """Name without its last extension."""
    return F.coalesce(nonempty(F.regexp_extract(name, _STEM, 1)), name)


def join_path(parent: Column, child: Column) -> Column:
    """`child` under `parent`; an absolute child stands alone."""
    bare = (parent == "") | F.endswith(parent, F.lit("/"))
    return (
        F.when(F.startswith(child, F.lit("/")), child)
        .when(bare, F.concat(parent, child))
        .otherwise(F.concat(parent, F.lit("/"), child))
    )


def default_filename(url: Column, filename: Column) -> Column:
    """Given name, else the last segment of the address, query string kept."""
    return F.coalesce(filename, basename(url))


def subdirectory(target_dir: Column, category: Column, language_pair: Column, filename: Column) -> Column:
    """Where a file belongs below the parent: explicit directory, category,
    language pair or its own stem, whichever is known first."""
    return F.coalesce(
        nonempty(target_dir),
        category,
        F.concat(F.lit("parallel/"), language_pair),
        stem(filename),
        F.lit(""),
    )
