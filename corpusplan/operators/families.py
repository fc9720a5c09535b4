"""Dataset families: which files an index page offers to a request.

A family is declared with SQL expressions, so the rules of all families run as one
filter and one projection over one join of requests with anchors. New families are
added with `Families.register`; registration order is match priority.

Tables passed between the steps:

* selectors: what is asked of a family, one row per distinct question
  (family, version, want_pair, want_category, want_extra, index_url)
* links: selectors joined with the anchors of their index page that a rule keeps
  (+ pos, href, and step: `page`, `category` or `table`)
* files: selectors' answers (SELECTOR columns + FILE columns)
"""

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusplan import known
from corpusplan.functions.shape import settle
from corpusplan.functions.text import strip_slashes
from corpusplan.operators.substrings import containing

SELECTOR = ["family", "version", "want_pair", "want_category", "want_extra"]
FILE = ["url", "filename", "language_pair", "category", "description", "pos"]

_NONE = "CAST(NULL AS STRING)"

# with more filters than this on one page, links are looked up by their substrings
FEW_FILTERS = 64

# anchors(page_url, pos, href), or what finds them at given addresses(page_url)
AnchorSource = DataFrame | Callable[[DataFrame], DataFrame]

# writes an intermediate table under a name and reads it back, or leaves it lazy
Keep = Callable[[DataFrame, str], DataFrame]


def lazy(df: DataFrame, name: str) -> DataFrame:
    return df


def literal(value: str | bool | None) -> str:
    """A value as SQL text."""
    if value is None:
        return _NONE
    if isinstance(value, bool):
        return str(value)
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


@dataclass(frozen=True)
class Family:
    """What every family has.

    `options` names the request fields its rule looks at; all others are ignored, so
    requests that differ only there share one answer.
    """

    prefix: str
    default_version: str
    index: str | None = None
    version_tag: str = "v"
    fixed_version: bool = False
    options: Sequence[str] = ()

    def facts(self) -> str:
        """The declaration as one constant row."""
        head, tail = self.index.split("{version}") if self.index else (None, None)
        values = {
            "family": self.prefix, "default_version": self.default_version, "fixed_version": self.fixed_version,
            "version_tag": self.version_tag, "head": head, "tail": tail,
            "uses_pair": "language_pair" in self.options, "uses_category": "category" in self.options,
        }
        return "named_struct(" + ", ".join(f"'{k}', {literal(v)}" for k, v in values.items()) + ")"

    def extra_options(self) -> list[str]:
        return sorted(o for o in self.options if o not in ("language_pair", "category"))


@dataclass(frozen=True)
class LinkFamily(Family):
    """A family that picks links of its index page: `keep` sees the link columns, those that say what a request wants too.

    How a request's language pair (or else its category) picks among the kept links is best declared: `within`, it must be part of the
    link; or `equal`, it must equal this expression of the link. `keep` must then look at the link alone, and
    `unasked` is what holds for requests that leave the field empty. Links are then looked up, however many
    requests there are.
    """

    keep: str = field(kw_only=True)
    within: bool = field(kw_only=True, default=False)
    equal: str | None = field(kw_only=True, default=None)
    unasked: str = field(kw_only=True, default="true")

    def want(self) -> str:
        return "want_pair" if "language_pair" in self.options else "want_category"

    def filters(self) -> str:
        """Whether a selector names what it wants, and links can be looked up by it."""
        return f"{self.want()} <> ''" if self.within or self.equal else "false"

    def picks(self) -> str:
        """The whole rule, over selectors joined with links."""
        if not (self.within or self.equal):
            return f"({self.keep})"
        fits = f"contains(href, {self.want()})" if self.within else f"{self.want()} = {self.equal}"
        return f"(({self.keep}) AND CASE WHEN {self.want()} = '' THEN {self.unasked} ELSE {fits} END)"


@dataclass(frozen=True)
class PageFamily(LinkFamily):
    """Files are listed on the index page itself. Rules see the link columns."""

    language_pair: str = field(kw_only=True, default=_NONE)
    category: str = field(kw_only=True, default=_NONE)
    description: str = field(kw_only=True, default="href")


@dataclass(frozen=True)
class DirectoryFamily(LinkFamily):
    """The index page leads to category pages, which list the files.

    `keep` and `category` see the link columns; `is_file` and `description` see
    `href` of the category page and the settled `category`.
    """

    category: str = field(kw_only=True)
    is_file: str = field(kw_only=True)
    description: str = field(kw_only=True, default="href")


@dataclass(frozen=True)
class FixedFamily(Family):
    """Files are known beforehand: (url, filename, description)."""

    files: Sequence[tuple[str, str, str]] = field(kw_only=True)

    def rows(self) -> str:
        structs = [
            f"named_struct('url', {literal(url)}, 'filename', {literal(name)}, "
            f"'description', {literal(text)}, 'pos', {place})"
            for place, (url, name, text) in enumerate(self.files)
        ]
        return f"array({', '.join(structs)})"


@dataclass(frozen=True)
class TableFamily(Family):
    """Anything else: `select` turns the family's links into files: SELECTOR
    columns, `url`, and whichever other FILE columns it knows."""

    select: Callable[[DataFrame], DataFrame] = field(kw_only=True)


class Families:
    """Ordered registry of families."""

    def __init__(self, families: Sequence[Family] = ()):
        self._by_prefix: dict[str, Family] = {}
        for family in families:
            self.register(family)

    def register(self, family: Family) -> "Families":
        self._by_prefix[family.prefix] = family
        return self

    def __iter__(self):
        return iter(self._by_prefix.values())

    def only(self, *prefixes: str) -> "Families":
        """These families alone, for selectors that ask no other."""
        return Families([f for f in self if f.prefix in prefixes])

    def of_kind(self, kind: type) -> list[Family]:
        return [f for f in self if isinstance(f, kind)]


def _any(tests: Sequence[str]) -> str:
    return "(" + " OR ".join(tests) + ")"


# the text before the first mark; the pair part of a news file name
_TRAIN_PAIR = f"substring_index(href, {literal(known.TRAIN_MARK)}, 1)"
_NEWS_PAIR = f"regexp_extract(href, {literal(known.NEWS_PAIR)}, 1)"

_CATEGORY_WORD = _any([f"contains(href, {literal(w)})" for w in known.CATEGORY_WORDS])


def standard_families() -> Families:
    """The families known from the start."""
    europarl = PageFamily(
        known.EUROPARL, known.EUROPARL_VERSION, known.EUROPARL_INDEX, options=("language_pair",),
        # the pair is searched in the whole name: `en` asks for every English pair
        keep=f"endswith(href, {literal(known.TRAIN_SUFFIX)}) AND contains(href, {literal(known.TRAIN_MARK)})",
        within=True,
        language_pair=_TRAIN_PAIR,
        description=f"concat('Europarl ', version, ' ', {_TRAIN_PAIR}, ' corpus')",
    )
    news = PageFamily(
        known.NEWS_COMMENTARY, known.NEWS_COMMENTARY_VERSION, known.NEWS_COMMENTARY_INDEX,
        options=("language_pair",),
        # a prefix test: version v1 takes the files of v15 as well
        keep=f"startswith(href, concat({literal(known.NEWS_STEM)}, version)) AND {_NEWS_PAIR} <> ''",
        equal=_NEWS_PAIR,
        language_pair=_NEWS_PAIR,
        description=f"concat('News Commentary ', version, ' ', {_NEWS_PAIR}, ' corpus')",
    )
    wmt = DirectoryFamily(
        known.WMT, known.WMT_VERSION, known.WMT_INDEX, version_tag="", options=("category",),
        keep="true", within=True, unasked=_CATEGORY_WORD,
        category=r"coalesce(nullif(want_category, ''), regexp_replace(href, '/+\\z', ''))",
        is_file=_any([f"endswith(href, {literal(s)})" for s in known.ARCHIVE_SUFFIXES]),
        description="concat('WMT', version, ' ', category, ' dataset - ', href)",
    )
    un_corpus = FixedFamily(
        known.UN_CORPUS, known.UN_CORPUS_VERSION, fixed_version=True,
        files=[(known.UN_CORPUS_FILE, "training-parallel-un-v1.0.tgz", "UN parallel corpus v1.0")],
    )
    return Families([europarl, news, wmt, un_corpus])


def _one_of(families: Sequence[Family], rule: Callable[[Family], str]) -> Column:
    """CASE over the `family` column."""
    cases = " ".join(f"WHEN {literal(f.prefix)} THEN {rule(f)}" for f in families)
    return F.expr(f"CASE family {cases} END")


def _for_some(families: Sequence[Family], rule: Callable[[Family], str]) -> str:
    return _any([f"(family = {literal(f.prefix)} AND {rule(f)})" for f in families])


def anchors_at(source: AnchorSource, addresses: DataFrame, store: Keep, name: str) -> DataFrame:
    """Anchors for a step: the whole table, or what the source finds at the addresses."""
    if callable(source):
        return source(store(addresses.select("page_url").distinct(), name))
    return source


def link_index(selectors: DataFrame, source: AnchorSource, families: Families,
               store: Keep = lazy, few_filters: int = FEW_FILTERS) -> DataFrame:
    """First hop: selectors with the links of their index page that a rule keeps.

    All rules are tested in the one join. If some page is asked with more than `few_filters` different
    wishes, selectors that name one are left out of that join, and their links are looked up; this is
    measured if there is a `store` that writes tables. The steps that follow each read the result: give a
    `store`, or it is worked out once per step.
    """
    steps = {"page": families.of_kind(PageFamily), "category": families.of_kind(DirectoryFamily)}
    picking, tables = families.of_kind(LinkFamily), families.of_kind(TableFamily)
    asked = selectors.withColumnRenamed("index_url", "page_url")
    found = anchors_at(source, asked.where("page_url IS NOT NULL"), store, "index_addresses").where("href <> ''")
    picks = [_for_some(picking, LinkFamily.picks)] if picking else []
    picks += [f"family = {literal(f.prefix)}" for f in tables]
    rule = _any(picks) if picks else "false"
    named = _for_some(picking, LinkFamily.filters) if picking else "false"
    if store is not lazy and _most_filters(asked.where(named)) > few_filters:
        links = asked.where(f"NOT {named}").join(found, "page_url").where(rule)
        links = links.unionByName(_looked_up(asked.where(named), found, picking, store).select(*links.columns))
    else:
        links = asked.join(found, "page_url").where(rule)
    cases = [f"WHEN {literal(f.prefix)} THEN '{step}'" for step, kinds in steps.items() for f in kinds]
    links = links.withColumnRenamed("page_url", "index_url")
    if len(list(families)) == 1 and cases:
        return links.withColumn("step", F.lit("page" if steps["page"] else "category"))
    step = f"CASE family {' '.join(cases)} ELSE 'table' END" if cases else "'table'"
    return settle(links, {"step": step})


def _most_filters(named: DataFrame) -> int:
    return named.groupBy("page_url").count().agg(F.max("count")).first()[0] or 0


def _looked_up(named: DataFrame, found: DataFrame, families: Sequence[LinkFamily], store: Keep) -> DataFrame:
    """Links for selectors that name what they want: joins on equal columns only."""
    page = ["family", "version", "page_url"]
    families = [f for f in families if f.within or f.equal]
    links = named.select(*page).distinct().join(found, "page_url").where(_for_some(families, lambda f: f.keep))
    links = store(links, "page_links")
    wanted = named.withColumn("_want", _one_of(families, LinkFamily.want))
    parts = []
    for f in families:
        if f.equal:
            own = F.col("family") == f.prefix
            parts.append(links.where(own).withColumn("_want", F.expr(f.equal)).join(wanted.where(own), [*page, "_want"]))
    within = [f.prefix for f in families if f.within]
    if within:
        own = F.col("family").isin(within)
        parts.append(containing(links.where(own), wanted.where(own), page, "href", "_want", store))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def page_files(links: DataFrame, families: Families) -> DataFrame:
    """Files listed on index pages, all page families in one pass."""
    kinds = families.of_kind(PageFamily)
    return links.where("step = 'page'").select(
        *SELECTOR,
        F.concat("index_url", "href").alias("url"),
        F.col("href").alias("filename"),
        _one_of(kinds, lambda f: f.language_pair).alias("language_pair"),
        _one_of(kinds, lambda f: f.category).alias("category"),
        _one_of(kinds, lambda f: f.description).alias("description"),
        "pos",
    )


def category_pages(links: DataFrame, families: Families) -> DataFrame:
    """Category pages found on index pages.

    When a category is met twice the last link of the page counts. The filter on
    the row number lets Spark keep one row per category before the shuffle, so a
    very long index page does not gather in one task.
    """
    kinds = families.of_kind(DirectoryFamily)
    last = Window.partitionBy(*SELECTOR, "category").orderBy(F.desc("pos"))
    return (
        links.where("step = 'category'")
        .select(
            *SELECTOR,
            _one_of(kinds, lambda f: f.category).alias("category"),
            F.concat("index_url", "href").alias("page_url"),
            "pos",
        )
        .withColumn("nth", F.row_number().over(last))
        .where("nth = 1")
        .select(*SELECTOR, "category", "page_url", "pos")
    )


def category_files(categories: DataFrame, source: AnchorSource, families: Families,
                   store: Keep = lazy) -> DataFrame:
    """Second hop: files on category pages. A page that is not there drops only
    its own category."""
    kinds = families.of_kind(DirectoryFamily)
    is_file = _for_some(kinds, lambda f: f.is_file)
    found = anchors_at(source, categories, store, "category_addresses")
    return (
        categories.drop("pos").join(found, "page_url").where(F.col("href") != "").where(is_file)
        .select(
            *SELECTOR,
            F.concat(strip_slashes(F.col("page_url")), F.lit("/"), F.col("href")).alias("url"),
            F.col("href").alias("filename"),
            F.lit(None).cast("string").alias("language_pair"),
            "category",
            _one_of(kinds, lambda f: f.description).alias("description"),
            "pos",
        )
    )


def fixed_files(selectors: DataFrame, families: Families) -> DataFrame:
    """Files that need no page."""
    kinds = families.of_kind(FixedFamily)
    return (
        selectors.where(F.col("family").isin([f.prefix for f in kinds]))
        .select(*SELECTOR, F.explode(_one_of(kinds, FixedFamily.rows)).alias("file"))
        .select(*SELECTOR, "file.*")
    )


def _whole_rows(files: DataFrame) -> DataFrame:
    """Optional columns a family leaves out are NULL, the position 0."""
    left_out = {
        c: F.lit(0) if c == "pos" else F.lit(None).cast("string") for c in FILE if c not in files.columns
    }
    return files.withColumns(left_out).select(*SELECTOR, *FILE) if left_out else files.select(*SELECTOR, *FILE)


def family_files(selectors: DataFrame, source: AnchorSource, families: Families,
                 store: Keep = lazy) -> DataFrame:
    """Every selector's files: SELECTOR + FILE columns, all families together.

    With a `store` that writes tables, anchors are read once per hop.
    """
    links = store(link_index(selectors, source, families, store), "links")
    parts = []
    if families.of_kind(PageFamily):
        parts.append(page_files(links, families))
    if families.of_kind(DirectoryFamily):
        categories = category_pages(links, families)
        if callable(source):
            categories = store(categories, "categories")
        parts.append(category_files(categories, source, families, store))
    if families.of_kind(FixedFamily):
        parts.append(fixed_files(selectors, families))
    for family in families.of_kind(TableFamily):
        own = links.where(f"step = 'table' AND family = {literal(family.prefix)}").drop("step")
        parts.append(_whole_rows(family.select(own)))
    if not parts:
        raise ValueError("no families registered")
    files = parts[0]
    for part in parts[1:]:
        files = files.unionByName(part, allowMissingColumns=True)
    return _whole_rows(files)
