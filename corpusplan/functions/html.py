"""Links of an HTML text as column expressions."""

from html.entities import name2codepoint

from pyspark.sql import Column, functions as F

# One pass over the text. Comments, scripts and styles match without setting
# group 2, so links inside them are consumed, not reported. In a link every
# attribute before `href` is consumed whole (possessive, no backtracking), so
# `href=` or `>` inside another attribute's value does not mislead it. Every
# alternative matches once it has begun, which keeps broken pages linear.
_VALUE = r"""(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*)"""
LINK = (
    r"(?is)<(?:"
    r"!--.*?(?:-->|\z)"
    r"|(script|style)\b.*?(?:</\1\s*>|\z)"
    r"|a(?=[\s/>])(?:[\s/]+(?!href[\s=/>])[^\s=>/\"']+(?:\s*=\s*" + _VALUE + r")?)*+"
    r"(?:[\s/]+href\s*=\s*(" + _VALUE + r"))?"
    r")"
)
_ENTITY = r"\A(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"


def links(html: Column) -> Column:
    """`href` values in document order, decoded, empty ones left out.

    Meant to be exploded: the array is worked out inside the generator, so later
    tests on a link see a plain column and not this expression.
    """
    found = F.regexp_extract_all(html, F.lit(LINK), F.lit(2))
    tokens = F.filter(found, lambda token: ~token.isin("", '""', "''"))
    return F.transform(F.transform(tokens, unquote), unescape)


def unquote(token: Column) -> Column:
    quoted = token.rlike(r"""\A["']""")
    return F.when(quoted, F.substring(token, F.lit(2), F.length(token) - 2)).otherwise(token)


def unescape(text: Column) -> Column:
    """Character references decoded once: decimal, hexadecimal and the named
    ones of HTML 4. Unknown references stay as written."""
    named = F.create_map(*[F.lit(v) for name, code in name2codepoint.items() for v in (name, chr(code))])

    def reference(piece: Column) -> Column:
        return F.struct(piece.alias("piece"), F.regexp_extract(piece, _ENTITY, 1).alias("ref"))

    def numbered(part: Column) -> Column:
        ref = part["ref"]
        code = (
            F.when(ref.rlike(r"\A#[xX]"), F.conv(F.substring(ref, F.lit(3), F.length(ref)), 16, 10))
            .when(F.startswith(ref, F.lit("#")), F.substring(ref, F.lit(2), F.length(ref)))
        )
        return F.struct(part["piece"].alias("piece"), ref.alias("ref"), code.cast("int").alias("code"))

    def decoded(part: Column) -> Column:
        piece, ref, code = part["piece"], part["ref"], part["code"]
        valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        char = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        rest = F.substring(piece, F.length(ref) + 2, F.length(piece))
        return F.coalesce(
            F.concat(F.coalesce(char, F.try_element_at(named, ref)), rest), F.concat(F.lit("&"), piece))

    pieces = F.split(text, "&")
    after = F.slice(pieces, F.lit(2), F.size(pieces))
    whole = F.array_join(F.transform(F.transform(F.transform(after, reference), numbered), decoded), "")
    return F.when(F.instr(text, "&") > 0, F.concat(pieces[0], whole)).otherwise(text)
