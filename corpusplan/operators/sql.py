"""Families as functions of the session's SQL.

`register_functions` makes the declared rules callable from SQL text, with what Spark itself offers for it:
functions whose body is an expression. Nothing runs in Python, and the optimizer sees through them.

    corpus_resolve(dataset_id)   struct<family, version, index_url>, its fields null where no family matches
    corpus_asks(dataset_id, language_pair, category, extra)
                                 struct<want_pair, want_category, want_extra>: what its family looks at
    corpus_picks(family, version, href, want_pair, want_category, want_extra)   boolean
    corpus_language_pair(...), corpus_category(...), corpus_description(...)   of a picked link, same arguments
    corpus_file_url(page_url, href), corpus_output_path(directory, filename)   text
"""

from pyspark.sql import SparkSession

from corpusplan.operators.families import DirectoryFamily, Families, FixedFamily, LinkFamily, PageFamily, literal
from corpusplan.operators.requests import RESOLUTION, asked_options, per_family

_LINK = {"family": "STRING", "version": "STRING", "href": "STRING", "want_pair": "STRING", "want_category": "STRING",
         "want_extra": "STRING"}


def _case(families, rule, otherwise: str) -> str:
    cases = " ".join(f"WHEN {literal(f.prefix)} THEN {rule(f)}" for f in families)
    return f"CASE family {cases} ELSE {otherwise} END" if cases else otherwise


def _struct(fields: dict[str, str]) -> str:
    return "named_struct(" + ", ".join(f"'{name}', {sql}" for name, sql in fields.items()) + ")"


def function_bodies(families: Families) -> dict[str, tuple[dict[str, str], str, str]]:
    """name -> (arguments, type, expression)."""
    facts = per_family(families, lambda f: f.facts())
    listing, leading = families.of_kind(PageFamily), families.of_kind(DirectoryFamily)
    none = "CAST(NULL AS STRING)"

    def with_facts(fields: dict[str, str]) -> str:
        return f"transform(array({facts}), _facts -> {_struct(fields)})[0]"

    def described(rule) -> str:
        return _case(listing, rule, none)

    return {
        "corpus_resolve": ({"dataset_id": "STRING"}, "STRUCT<family: STRING, version: STRING, index_url: STRING>", with_facts(RESOLUTION)),
        "corpus_asks": (
            {"dataset_id": "STRING", "language_pair": "STRING", "category": "STRING", "extra": "MAP<STRING, STRING>"},
            "STRUCT<want_pair: STRING, want_category: STRING, want_extra: STRING>", with_facts(asked_options(families))),
        "corpus_picks": (_LINK, "BOOLEAN", _case(families.of_kind(LinkFamily), LinkFamily.picks, "FALSE")),
        "corpus_language_pair": (_LINK, "STRING", described(lambda f: f.language_pair)),
        "corpus_category": (_LINK, "STRING", _case([*listing, *leading], lambda f: f.category, none)),
        "corpus_description": (_LINK, "STRING", described(lambda f: f.description)),
        "corpus_file_url": ({"page_url": "STRING", "href": "STRING"}, "STRING", "concat(page_url, href)"),
        "corpus_output_path": (
            {"directory": "STRING", "filename": "STRING"}, "STRING",
            "CASE WHEN startswith(filename, '/') THEN filename WHEN directory = '' OR endswith(directory, '/') "
            "THEN concat(directory, filename) ELSE concat(directory, '/', filename) END"),
    }


def register_functions(spark: SparkSession, families: Families) -> list[str]:
    """Make the families' rules temporary functions of the session; returns their names. Registering again replaces them.

    There is also a table function, `corpus_fixed_files()`: the files of families that need no page.
    """
    made = []
    for name, (arguments, kind, body) in function_bodies(families).items():
        signature = ", ".join(f"{a} {t}" for a, t in arguments.items())
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({signature}) RETURNS {kind} RETURN {body}")
        made.append(name)
    rows = [f"SELECT {literal(f.prefix)} AS family, inline({f.rows()})" for f in families.of_kind(FixedFamily)]
    if rows:
        spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION corpus_fixed_files() RETURNS TABLE(family STRING, url STRING, filename STRING, "
                  f"description STRING, pos INT) RETURN {' UNION ALL '.join(rows)}")
        made.append("corpus_fixed_files")
    return made
