"""Links of index pages."""

from pyspark.sql import DataFrame, functions as F

from corpusplan.functions.html import links

# addresses are broadcast up to this many bytes, counting some per row
BROADCAST_BYTES = 32 << 20
_ROW_BYTES = 64


def extract_anchors(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """pages(url, html) -> anchors(page_url, pos, href), no shuffle.

    Links without `href` or with an empty one are dropped; nothing is trimmed and
    nothing is resolved against the page address. A page without text (one that
    could not be read) gives no rows. Differences from a full HTML parser: no
    markup repair, and only character references closed by `;` are decoded.
    """
    return pages.select(F.col(url).alias("page_url"), F.posexplode(links(F.col(html))).alias("pos", "href"))


def anchors_at_addresses(pages: DataFrame, addresses: DataFrame, url: str = "url", html: str = "html",
                         broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Anchors of the pages at the given distinct addresses(page_url). Page texts are
    never shuffled.

    The addresses are measured first (give a written table, so that this is cheap).
    When they are few they are broadcast, and only their pages are parsed. When they
    are many, pages are parsed where they are read and the links, a small part of the
    text, are joined; this is an inner join, because Spark moves a semi-join below
    the parsing.
    """
    size = addresses.agg(F.sum(F.octet_length("page_url") + _ROW_BYTES).alias("bytes")).first().bytes or 0
    if size <= broadcast_bytes:
        few = F.broadcast(addresses.select(F.col("page_url").alias(url)))
        return extract_anchors(pages.join(few, url, "left_semi"), url, html)
    return extract_anchors(pages, url, html).join(addresses.select("page_url"), "page_url")
