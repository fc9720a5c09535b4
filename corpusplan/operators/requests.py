"""From requests to files: resolving ids, matching, layout and what is missing."""

from pyspark.sql import Column, DataFrame, functions as F

from corpusplan import known
from corpusplan.functions.shape import settle
from corpusplan.functions.skew import mark_alone, spread_lookup
from corpusplan.functions.text import default_filename, join_path, nonempty, subdirectory
from corpusplan.operators.families import (
    SELECTOR, AnchorSource, Families, Keep, family_files, lazy, literal,
)

def per_family(families, rule) -> str:
    """CASE over the first prefix the id starts with."""
    cases = " ".join(f"WHEN startswith(dataset_id, {literal(f.prefix)}) THEN {rule(f)}" for f in families)
    return f"CASE {cases} END"


_VERSION = r"""CASE WHEN _facts.fixed_version THEN _facts.default_version ELSE coalesce(
    _facts.version_tag || nullif(regexp_extract(dataset_id, '([0-9]+)\\z', 1), ''), _facts.default_version) END"""

# over the columns dataset_id and _facts
RESOLUTION = {
    "family": "_facts.family",
    "version": _VERSION,
    "index_url": f"_facts.head || {_VERSION} || _facts.tail",
}


def _with_facts(requests: DataFrame, families: Families) -> DataFrame:
    return requests.withColumn("_facts", F.expr(per_family(families, lambda f: f.facts())))


def resolve(requests: DataFrame, families: Families) -> DataFrame:
    """Add family, version and index_url; all NULL where no family matches."""
    return settle(_with_facts(requests, families), RESOLUTION).drop("_facts")


def asked_options(families: Families, has_extra: bool = True) -> dict[str, str]:
    """What a request asks of its family, over its columns and _facts."""
    optional = [f for f in families if f.extra_options()]
    extra = "''"
    if optional and has_extra:
        asked = per_family(optional, lambda f: "to_json(named_struct({}))".format(
            ", ".join(f"{literal(o)}, extra[{literal(o)}]" for o in f.extra_options())))
        names = ", ".join(literal(f.prefix) for f in optional)
        extra = f"CASE WHEN _facts.family IN ({names}) THEN {asked} ELSE '' END"
    return {
        "want_pair": "CASE WHEN _facts.uses_pair THEN coalesce(language_pair, '') ELSE '' END",
        "want_category": "CASE WHEN _facts.uses_category THEN coalesce(category, '') ELSE '' END",
        "want_extra": extra,
    }


def with_selector(requests: DataFrame, families: Families) -> DataFrame:
    """Add family, version, index_url and the question each request asks of its
    family, as plain join keys.

    Fields a family does not look at are blanked, so that however many requests
    ask the same thing, its files are worked out once.
    """
    wanted = asked_options(families, "extra" in requests.columns)
    return settle(_with_facts(requests, families), RESOLUTION | wanted).drop("_facts")


def selectors_of(requests: DataFrame) -> DataFrame:
    """Distinct questions of requests that went through `with_selector`."""
    return requests.where(F.col("family").isNotNull()).select(*SELECTOR, "index_url").distinct()


def answer(requests: DataFrame, source: AnchorSource, families: Families,
           store: Keep = lazy) -> tuple[DataFrame, DataFrame]:
    """(requests with their selector, files per selector).

    The pair and category tests run once per distinct selector, whatever the number
    of requests. Of the steps only the links are stored: the requests and the files are cheap to work out from
    what is stored, and most callers read them once; who reads them more often stores them.
    """
    asked = with_selector(requests, families)
    return asked, family_files(selectors_of(asked), source, families, store)


def match_files(asked: DataFrame, files: DataFrame) -> DataFrame:
    """One row per request and file it asks for; an equi-join."""
    return asked.select("req_id", "dataset_id", "target_dir", "has_target_dir", *SELECTOR).join(files, SELECTOR)


def lay_out_batch(asked: DataFrame, files: DataFrame, parent_dir: str = known.DEFAULT_PARENT) -> DataFrame:
    """Files of a batch with their output paths.

    A request without a target directory uses its dataset id; one whose target
    directory is there but empty follows the layout rule.
    """
    override = F.when(F.col("has_target_dir"), F.col("target_dir")).otherwise(F.col("dataset_id"))
    place = subdirectory(override, F.col("category"), F.col("language_pair"), F.col("filename"))
    return _planned(match_files(asked, files), join_path(F.lit(parent_dir), place))


def lay_out_single(asked: DataFrame, files: DataFrame, parent_dir: str = known.DEFAULT_PARENT) -> DataFrame:
    """Files of stand-alone requests with their output paths.

    The target directory is the parent here. A request with exactly one file puts
    it there directly, one with more follows the layout rule. Which case holds is
    settled per selector, before the join.
    """
    marked = mark_alone(files, SELECTOR, "single", spread=["url", "pos"])
    parent = F.coalesce(nonempty(F.col("target_dir")), F.lit(parent_dir))
    place = subdirectory(F.lit(None).cast("string"), F.col("category"), F.col("language_pair"), F.col("filename"))
    return _planned(
        match_files(asked, marked), F.when(F.col("single"), parent).otherwise(join_path(parent, place)))


def plan_batch(requests: DataFrame, source: AnchorSource, families: Families,
               parent_dir: str = known.DEFAULT_PARENT) -> DataFrame:
    """Requests and anchors to planned files, as one lazy plan."""
    return lay_out_batch(*answer(requests, source, families), parent_dir)


def plan_single(requests: DataFrame, source: AnchorSource, families: Families,
                parent_dir: str = known.DEFAULT_PARENT) -> DataFrame:
    """As `plan_batch` for stand-alone requests."""
    return lay_out_single(*answer(requests, source, families), parent_dir)


def _planned(matched: DataFrame, directory: Column) -> DataFrame:
    named = matched.withColumn("filename", default_filename(F.col("url"), F.col("filename")))
    return named.withColumn("target_dir", directory).select(
        "req_id", "dataset_id", "url", "filename", "language_pair", "category", "description",
        "target_dir", join_path(F.col("target_dir"), F.col("filename")).alias("output_path"), "pos",
    )


def unanswered(asked: DataFrame, files: DataFrame) -> DataFrame:
    """Requests that lead to no file, unresolvable ids included."""
    answered = files.select(*SELECTOR).distinct()
    missing = spread_lookup(asked, answered, SELECTOR, "left_anti", spread=["req_id"])
    return missing.select("req_id", "dataset_id", "language_pair", "category", "family", "version")


def require_known(requests: DataFrame, families: Families) -> DataFrame:
    """Raise when an id belongs to no family; else return the requests."""
    unknown = resolve(requests, families).where(F.col("family").isNull()).select("dataset_id")
    first = unknown.take(5)
    if first:
        names = ", ".join(str(r.dataset_id) for r in first)
        raise ValueError(f"unsupported dataset id in {unknown.count()} requests, the first: {names}")
    return requests
