"""Main text of web pages: flat text blocks classified by a small decision tree.

A page becomes a flat list of text blocks. Each is described by its word count and link
density, those of its neighbours, and the kind of container it stands in; a decision tree
fitted on the table below says which blocks are the article.
"""

import html
import re
from dataclasses import dataclass

from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession

from corpusplan.llm.common import store_of, texts_of, with_columns
from corpusplan.llm.trees import decide, nested

# Names that HTML itself or common page templates give to parts of a page.
HIDDEN = frozenset("script style noscript template head title svg math iframe object canvas audio video select textarea".split())
RAW = frozenset("script style title textarea iframe".split())  # no tags inside, only their own end tag counts
HEAD_TAGS = frozenset("html head base link meta title script style noscript template".split())
SIDE_TAGS = frozenset("nav aside footer form menu dialog button fieldset".split())
BODY_TAGS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
INLINE = frozenset("""a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q
    rp rt ruby s samp small span strike strong sub sup time tt u var wbr""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SIDE_NAMES = frozenset("""ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion
    nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar aside widget related recommended
    footer comment comments respond disqus reply replies discussion cookie cookies consent gdpr notice notices alert
    complementary contentinfo popup modal overlay newsletter subscribe subscription signup login share sharing social toolbar copyright
    legal disclaimer form search""".split())
COMMENT_NAMES = frozenset("comment comments respond disqus reply replies discussion".split())
MODIFIERS = frozenset("no not non has have with without is w".split())  # they make a name say something about a page, not what it is
HEADER_NAMES = frozenset("header masthead topbar".split())
# what stands beside such a name in a class without changing what the part is
LAYOUT_NAMES = frozenset("""area bar block body bottom box button buttons card cell center cell col column container content entry
    fixed full group header holder inline inner item items label large left link links list main message mobile module outer page panel
    post posts article articles primary right row secondary section site slot small sticky tab tag text title top unit wrap wrapper
    zone desktop native in feed story stories""".split())

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?:[^\"'<>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+)>?"
    r"|<[!?][^>]*+>?|<|[^<]++", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_HREF = re.compile(r"(?:^|[\s\"'/])href\s*=", re.I)
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+>?", re.I) for t in RAW}
_SPLIT = re.compile(r"[^a-z0-9]+")


@dataclass(eq=False)
class Container:
    """An open part of a page; `wraps` if it may turn out to be a side part by name only."""
    tag: str
    kind: str
    wraps: bool = False
    comments: bool = False
    words: int = 0  # not linked
    main: bool = False
    bodies: int = 0


@dataclass
class Block:
    text: str
    words: int
    link_words: int
    side: bool
    header: bool
    body: bool
    heading: bool

    @property
    def density(self) -> float:
        return self.link_words / self.words if self.words else 0.0


def blocks(page: str) -> list[Block]:
    """The text blocks in page order; character references decoded, white space as one blank.

    Tags need not be closed: an end tag closes all that was opened inside, an unknown one is
    passed over, a block tag ends a paragraph and a heading, a list item the one before. A head
    ends at the first tag or word that cannot stand in it. A form or a container named like a side
    part is none if it wraps the page's content: it holds a main element; all article elements and a
    quarter of the words that are not links; or, where no article element is, half of these words.
    """
    out: list[Block] = []
    held: list[list[Container]] = []  # the containers of each block
    stack: list[Container] = []
    parts: list[tuple[str, bool]] = []
    heading = link = False
    opened = 0  # containers that were open where the link began
    hidden, in_head, at, bodies = None, False, 0, 0

    def close_block():
        nonlocal parts
        text = " ".join(html.unescape("".join(p for p, _ in parts)).split())
        if text:
            linked = sum(len(html.unescape(p).split()) for p, inside in parts if inside)
            words = len(text.split(" "))
            out.append(Block(text, words, min(words, linked), False, False, False, heading))
            held.append(stack[:])
            for c in stack:
                c.words += words - min(words, linked)
        parts = []

    while m := _TOKEN.match(page, at):
        at, tag = m.end(), m.group("tag")
        if tag is None:
            if hidden == "head" and not m.group().startswith(("<!", "<?")) and m.group().strip():
                hidden, in_head = None, False
            if hidden is None and not m.group().startswith("<!") and not m.group().startswith("<?"):
                parts.append((m.group(), link))
            continue
        tag, ending = tag.lower(), bool(m.group("end"))
        if hidden == "head" and not ending and tag not in HEAD_TAGS:
            hidden, in_head = None, False
        if tag in RAW and not ending and not m.group("attrs").rstrip().endswith("/"):
            if hidden is None and tag not in INLINE:
                close_block()
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        if hidden is not None:
            if ending and tag == hidden:
                hidden = "head" if in_head and tag != "head" else None
                in_head = hidden is not None
            elif hidden == "head" and not ending and tag in HIDDEN and not m.group("attrs").rstrip().endswith("/"):
                hidden = tag
            continue
        if tag in HIDDEN:
            if tag == "select" or tag not in INLINE:
                close_block()
            if not ending and not m.group("attrs").rstrip().endswith("/"):
                hidden, in_head = tag, tag == "head"
            continue
        if tag in INLINE:
            if tag == "a":
                link, opened = not ending and _HREF.search(m.group("attrs")) is not None, len(stack)
            elif tag == "br":
                parts.append((" ", link))
            continue
        close_block()
        if tag in VOID:
            continue
        if not ending and stack and (stack[-1].tag == "p" or stack[-1].tag == tag == "li"):
            stack.pop()
        heading = tag in HEADINGS and not ending
        if tag in HEADINGS and not m.group("attrs"):
            continue
        if ending:
            for n in range(len(stack) - 1, -1, -1):
                if stack[n].tag == tag:
                    del stack[n:]
                    link &= n >= opened  # a link goes on over blocks inside it, not beyond the part it stands in
                    break
        elif tag != "p" and tag != "li" or m.group("attrs"):
            new = _container(tag, m.group("attrs"), any(c.kind == "body" for c in stack))
            if new.kind == "body":
                for c in stack:
                    c.bodies += 1
                    c.main |= tag == "main"
                bodies += 1
            stack.append(new)
    close_block()
    total = sum(b.words - b.link_words for b in out)

    def kind(c: Container) -> str:
        if c.wraps and (c.main or (4 * c.words >= total and c.bodies == bodies if bodies else 2 * c.words >= total and not c.comments)):
            return "plain"
        return c.kind

    for b, inside in zip(out, held):
        kinds = {kind(c) for c in inside}
        b.side, b.header, b.body = "side" in kinds, "header" in kinds, "body" in kinds
    return out


def _container(tag: str, attrs: str, inside: bool) -> Container:
    """Inside an article a class names a side part only as a whole: `ad-box` does, `ad-free` and `share-price` don't."""
    values = {n.lower(): a or b or c for n, a, b, c in reversed(_ATTRIBUTE.findall(attrs))} if attrs else {}  # the first of equal names
    page = tag in ("body", "html")
    if not page and ("hidden" in values or values.get("aria-hidden", "").lower() == "true" or _NO_DISPLAY.search(values.get("style", ""))):
        return Container(tag, "side")
    names = set()
    for token in " ".join(values.get(n, "") for n in ("class", "id", "role")).lower().split():
        pieces = {p for p in _SPLIT.split(token) if p}
        if pieces & MODIFIERS:
            continue
        if not inside or all(p in SIDE_NAMES or p in LAYOUT_NAMES or not p.isalpha() for p in pieces):
            names |= pieces
    if tag in SIDE_TAGS:
        return Container(tag, "side", tag == "form")
    if tag in BODY_TAGS and not names & SIDE_NAMES:
        return Container(tag, "body")
    if names & SIDE_NAMES and not page:
        return Container(tag, "side", tag not in BODY_TAGS, bool(names & COMMENT_NAMES))
    if tag == "header" or names & HEADER_NAMES and not page:
        return Container(tag, "header")
    return Container(tag, "plain")


FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after",
            "side", "header", "body", "heading")


def describe(page: list[Block]) -> list[tuple[float, ...]]:
    """The features of each block; beyond the page's ends there are no words and no links."""
    w, d = [0, *(b.words for b in page), 0], [0.0, *(b.density for b in page), 0.0]
    return [(w[i], d[i], w[i - 1], d[i - 1], w[i + 1], d[i + 1], float(b.side), float(b.header), float(b.body),
             float(b.heading)) for i, b in enumerate(page, 1)]


# A small labelled table: the features in the order of FEATURES, then 1 for a block of the article.
LABELLED = [
    # paragraphs and titles of an article element, long, short, linked and between each other
    (42, 0.00, 38, 0.00, 51, 0.00, 0, 0, 1, 0, 1), (8, 0.00, 44, 0.00, 30, 0.00, 0, 0, 1, 0, 1),
    (3, 0.00, 12, 0.00, 25, 0.00, 0, 0, 1, 0, 1), (1, 0.00, 60, 0.00, 40, 0.00, 0, 0, 1, 0, 1),
    (12, 0.00, 9, 0.00, 48, 0.00, 0, 0, 1, 1, 1), (2, 0.00, 0, 0.00, 90, 0.00, 0, 0, 1, 1, 1),
    (25, 0.40, 33, 0.00, 45, 0.00, 0, 0, 1, 0, 1), (10, 1.00, 40, 0.00, 35, 0.00, 0, 0, 1, 0, 1),
    (95, 0.05, 12, 0.00, 11, 0.00, 0, 0, 1, 0, 1), (5, 0.00, 5, 1.00, 14, 0.00, 0, 0, 1, 0, 1),
    (9, 0.00, 1, 1.00, 70, 0.00, 0, 1, 1, 1, 1), (14, 0.00, 70, 0.00, 0, 0.00, 0, 0, 1, 0, 1),
    (60, 0.00, 0, 0.00, 0, 0.00, 0, 0, 1, 0, 1), (7, 0.30, 10, 0.00, 80, 0.00, 0, 1, 1, 0, 1),
    (32, 0.00, 2, 0.00, 17, 0.00, 0, 0, 1, 0, 1), (17, 0.00, 3, 0.00, 12, 0.00, 0, 0, 1, 0, 1),
    (40, 0.00, 4, 0.00, 6, 1.00, 0, 0, 1, 0, 1), (4, 0.00, 3, 0.00, 2, 1.00, 0, 0, 1, 0, 1),
    (21, 0.10, 2, 1.00, 3, 1.00, 0, 0, 1, 0, 1), (2, 0.00, 2, 0.00, 3, 0.00, 0, 0, 1, 0, 1),
    (1, 1.00, 1, 1.00, 1, 1.00, 0, 0, 1, 0, 1), (1, 1.00, 30, 0.00, 1, 1.00, 0, 0, 1, 0, 1),
    (2, 1.00, 2, 1.00, 28, 0.00, 0, 0, 1, 0, 1), (4, 0.80, 3, 1.00, 5, 1.00, 0, 0, 1, 0, 1),
    (3, 1.00, 0, 0.00, 2, 1.00, 0, 0, 1, 1, 1), (26, 1.00, 8, 1.00, 31, 1.00, 0, 0, 1, 0, 1),
    (2, 1.00, 1, 1.00, 0, 0.00, 0, 0, 1, 0, 1), (6, 0.70, 44, 0.00, 3, 1.00, 0, 0, 1, 0, 1),
    (5, 1.00, 5, 1.00, 6, 1.00, 0, 1, 1, 0, 1), (3, 1.00, 1, 1.00, 22, 0.00, 0, 1, 1, 0, 1),
    (6, 0.00, 11, 0.00, 2, 0.00, 0, 0, 1, 1, 1), (16, 0.20, 3, 0.00, 28, 0.90, 0, 1, 1, 0, 1),
    # text of a page without such an element
    (48, 0.00, 40, 0.00, 44, 0.00, 0, 0, 0, 0, 1), (70, 0.10, 12, 0.00, 33, 0.00, 0, 0, 0, 0, 1),
    (9, 0.00, 2, 1.00, 55, 0.00, 0, 0, 0, 1, 1), (6, 0.00, 48, 0.00, 52, 0.00, 0, 0, 0, 1, 1),
    (14, 0.00, 45, 0.00, 38, 0.00, 0, 0, 0, 0, 1), (11, 0.00, 30, 0.00, 42, 0.00, 0, 0, 0, 0, 1),
    (33, 0.15, 60, 0.00, 8, 0.80, 0, 0, 0, 0, 1), (28, 0.00, 7, 0.00, 6, 1.00, 0, 0, 0, 0, 1),
    (18, 0.00, 9, 0.00, 0, 0.00, 0, 0, 0, 0, 1), (22, 0.00, 0, 0.00, 0, 0.00, 0, 0, 0, 0, 1),
    (12, 0.00, 8, 0.00, 10, 0.00, 0, 0, 0, 0, 1), (7, 0.00, 0, 0.00, 14, 0.00, 0, 0, 0, 0, 1),
    (30, 0.00, 3, 0.00, 21, 0.00, 0, 0, 0, 0, 1), (15, 0.00, 2, 0.00, 4, 0.00, 0, 0, 0, 0, 1),
    (41, 0.00, 4, 1.00, 3, 1.00, 0, 0, 0, 0, 1), (16, 0.05, 1, 1.00, 2, 1.00, 0, 0, 0, 0, 1),
    (8, 0.00, 3, 0.00, 19, 0.00, 0, 0, 0, 0, 1), (24, 0.10, 3, 0.90, 5, 1.00, 0, 0, 0, 0, 1),
    (3, 0.00, 1, 1.00, 40, 0.00, 0, 0, 0, 1, 1), (2, 0.00, 30, 0.00, 44, 0.00, 0, 0, 0, 1, 1),
    (4, 0.00, 0, 0.00, 30, 0.00, 0, 0, 0, 1, 1), (3, 0.00, 20, 0.00, 25, 0.00, 0, 0, 0, 0, 1),
    (1, 0.00, 33, 0.00, 18, 0.00, 0, 0, 0, 0, 1), (4, 0.00, 26, 0.00, 12, 0.00, 0, 0, 0, 0, 1),
    # menus, lists of links and their neighbours
    (1, 1.00, 1, 1.00, 1, 1.00, 0, 0, 0, 0, 0), (2, 1.00, 0, 0.00, 1, 1.00, 0, 0, 0, 0, 0),
    (3, 1.00, 2, 1.00, 40, 0.00, 0, 0, 0, 0, 0), (4, 0.75, 3, 1.00, 5, 0.80, 0, 0, 0, 0, 0),
    (12, 0.90, 10, 0.95, 14, 0.85, 0, 0, 0, 0, 0), (9, 0.66, 44, 0.00, 3, 1.00, 0, 0, 0, 0, 0),
    (30, 0.80, 25, 0.90, 31, 0.85, 0, 0, 0, 0, 0), (6, 1.00, 60, 0.00, 2, 1.00, 0, 0, 0, 0, 0),
    (1, 1.00, 1, 1.00, 1, 1.00, 1, 0, 0, 0, 0), (2, 1.00, 1, 1.00, 12, 0.00, 1, 0, 0, 0, 0),
    (5, 0.80, 20, 0.00, 33, 0.00, 0, 0, 0, 0, 0), (14, 0.90, 3, 0.00, 2, 0.00, 0, 0, 0, 0, 0),
    (2, 1.00, 40, 0.00, 28, 0.10, 0, 0, 0, 0, 0), (8, 0.75, 2, 0.00, 50, 0.00, 0, 0, 0, 0, 0),
    (20, 1.00, 31, 0.00, 0, 0.00, 0, 0, 0, 0, 0), (7, 0.70, 0, 0.00, 0, 0.00, 0, 0, 0, 0, 0),
    # adverts, notices, sidebars, forms, comments and footers, also inside the article
    (12, 0.00, 3, 1.00, 10, 0.00, 1, 0, 0, 0, 0), (45, 0.00, 40, 0.00, 42, 0.00, 1, 0, 0, 0, 0),
    (60, 0.05, 55, 0.00, 9, 0.00, 1, 0, 0, 0, 0), (20, 0.00, 50, 0.00, 0, 0.00, 1, 0, 0, 0, 0),
    (5, 0.00, 48, 0.00, 30, 0.00, 1, 0, 1, 0, 0), (38, 0.00, 44, 0.00, 41, 0.00, 1, 0, 1, 0, 0),
    (3, 0.00, 40, 0.00, 25, 0.00, 1, 0, 1, 1, 0), (9, 1.00, 45, 0.00, 43, 0.00, 1, 0, 1, 0, 0),
    (6, 0.00, 0, 0.00, 2, 1.00, 1, 0, 0, 1, 0), (80, 0.00, 0, 0.00, 0, 0.00, 1, 0, 0, 0, 0),
    # mastheads
    (3, 0.00, 0, 0.00, 1, 1.00, 0, 1, 0, 1, 0), (5, 1.00, 0, 0.00, 1, 1.00, 0, 1, 0, 0, 0),
    (10, 0.00, 3, 0.00, 2, 1.00, 0, 1, 0, 0, 0), (30, 0.00, 4, 0.00, 40, 0.00, 0, 1, 0, 0, 0),
    (6, 0.00, 0, 0.00, 8, 1.00, 0, 1, 0, 1, 0), (12, 0.00, 3, 0.00, 20, 0.00, 0, 1, 0, 0, 0),
    (4, 0.00, 0, 0.00, 9, 0.90, 0, 1, 0, 1, 0), (8, 0.00, 2, 0.00, 15, 0.00, 0, 1, 0, 1, 0),
    (7, 0.00, 4, 1.00, 31, 0.00, 0, 1, 0, 0, 0), (9, 0.00, 5, 0.00, 6, 0.00, 0, 1, 0, 0, 0),
    # heads of articles
    (15, 0.00, 3, 1.00, 40, 0.00, 0, 1, 1, 1, 1), (22, 0.00, 15, 0.00, 38, 0.00, 0, 1, 1, 0, 1),
    (12, 0.00, 2, 1.00, 5, 0.00, 0, 1, 1, 1, 1), (5, 0.00, 12, 0.00, 50, 0.00, 0, 1, 1, 0, 1),
    # stray short lines between links
    (2, 0.00, 1, 1.00, 2, 1.00, 0, 0, 0, 0, 0), (3, 0.00, 4, 1.00, 3, 1.00, 0, 0, 0, 0, 0),
    (4, 0.00, 2, 1.00, 0, 0.00, 0, 0, 0, 0, 0), (2, 0.00, 3, 0.90, 1, 1.00, 0, 0, 0, 1, 0),
]


def train(spark: SparkSession, labelled=LABELLED, depth: int = 6):
    """A fitted tree as nested splits."""
    rows = spark.createDataFrame([(float(r[-1]), [float(x) for x in r[:-1]]) for r in labelled],
                                 "label double, values array<double>").coalesce(1)
    fitted = DecisionTreeClassifier(maxDepth=depth, maxBins=64, minInstancesPerNode=2, seed=1).fit(
        rows.select("label", array_to_vector("values").alias("features")))
    return nested(fitted.toDebugString)


def main_text(page: str, tree) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, x in zip(found, describe(found)) if decide(tree, x) >= 0.5)


def extract(pages: DataFrame, page: str = "html", tree=None) -> DataFrame:
    """Add `text`, the blocks of the article joined by line ends, and `n_chars`, its code points.

    Null or empty html gives the empty text. Columns of these names are replaced.
    """
    store_of(pages.sparkSession, "html")
    tree = tree or train(pages.sparkSession)

    def work():
        def step(batch):
            out = [main_text(p, tree) for p in texts_of(batch, page)]
            return [out, [len(t) for t in out]]
        return step

    return with_columns(pages, "text string, n_chars bigint", work)
