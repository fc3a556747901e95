"""Text taken from stored HTML, phone numbers, mail addresses and escaping."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sitemill.functions.binding import let, once
from sitemill.functions.unicode import collapse_spaces, nfkc


def plain_text(html: Column) -> Column:
    """Rough text for descriptions: scripts dropped, tags to spaces, six entities, single spaces."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style).*?</\1>", " ")
    text = F.regexp_replace(text, r"<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return collapse_spaces(text)


def text_value(c: Column) -> Column:
    return collapse_spaces(c)


def excerpt(c: Column, maximum: int = 160) -> Column:
    """Cut at a word when that keeps over 60 percent; trailing punctuation gives way to an ellipsis."""
    def shortened(text: Column) -> Column:
        cut = F.substring(text, 1, maximum - 1)
        back = F.instr(F.reverse(cut), " ")
        space = F.length(cut) - back
        head = F.when((back > 0) & (space > maximum * 0.6), F.substr(cut, F.lit(1), space)).otherwise(cut)
        return F.concat(F.regexp_replace(head, r"[\s,.;:–-]+\z", ""), F.lit("…"))

    return let(collapse_spaces(c), lambda text: F.when(F.length(text) <= maximum, text).otherwise(shortened(text)))


@once
def tel_link(text: Column) -> Column:
    """'tel:' link of one written number, or null when the text does not name one number."""
    digits = F.regexp_replace(text, r"[\s().-]", "")
    local = F.regexp_extract(digits, r"\A(?:\+48|0048)?([0-9]{9})\z", 1)
    return F.when(local != "", F.concat(F.lit("tel:+48"), local)).when(
        digits.rlike(r"\A\+[1-9][0-9]{7,14}\z"), F.concat(F.lit("tel:"), digits)
    )


def phone_parts(raw: Column) -> Column:
    """array<struct<text, href>>: several numbers, each with its own text and link."""
    pieces = F.split(F.coalesce(raw, F.lit("")), r"(?i)[,;\n]|\s/\s|\s+lub\s+")
    pieces = F.filter(F.transform(pieces, lambda piece: F.trim(piece)), lambda piece: piece != "")
    return F.transform(pieces, lambda piece: F.struct(piece.alias("text"), tel_link(piece).alias("href")))


def tel_href(raw: Column) -> Column:
    links = F.filter(phone_parts(raw), lambda part: part["href"].isNotNull())
    return F.when(F.size(links) > 0, links[0]["href"])


_EMAIL = r"\A[^\s@]+@[^\s@]+\.[^\s@]+\z"


@once
def valid_email(c: Column) -> Column:
    """Lower-case trimmed address, or null."""
    ok = lambda address: address.rlike(_EMAIL) & (F.length(address) <= 254) & ~address.rlike(r"[\x00-\x1F]")
    return let(F.lower(F.trim(c)), lambda address: F.when(ok(address), address))


def xml_escape(c: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def html_escape(c: Column, quotes: bool = True) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")]
    for char, entity in pairs + ([('"', "&quot;"), ("'", "&#x27;")] if quotes else []):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def script_safe_json(c: Column) -> Column:
    """JSON that can sit inside a script tag."""
    for char, escape in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026"), (" ", "\\u2028"), (" ", "\\u2029")):
        c = F.replace(c, F.lit(char), F.lit(escape))
    return c


def legal_role(title: Column, path: Column) -> Column:
    text = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(path, F.lit(""))))
    return (
        F.when(text.rlike("prywatno|privacy|rodo|cookie"), F.lit("privacy"))
        .when(text.rlike("regulamin|terms"), F.lit("terms"))
        .otherwise(F.lit("other"))
    )


def catalog_search_text(*parts: Column) -> Column:
    """Folded search column: NFKC, lower case, single spaces."""
    return collapse_spaces(F.lower(nfkc(F.concat_ws(" ", *parts))))
