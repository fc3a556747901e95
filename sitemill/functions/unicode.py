"""Unicode forms, lengths and character-class checks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NON_ASCII = r"[^\x00-\x7F]"


def _icu(c: Column, cls: str, method: str, flag: bool) -> Column:
    """Spark has no normalizer, but it ships ICU: the call stays in the JVM, and only for text
    that is not plain ASCII (plain ASCII is already normal)."""
    call = F.reflect(F.lit(cls), F.lit(method), c, F.lit(flag))
    return F.when(c.rlike(NON_ASCII), call).otherwise(c)


def nfc(c: Column) -> Column:
    return _icu(c, "com.ibm.icu.text.Normalizer", "compose", False)


def nfkc(c: Column) -> Column:
    return _icu(c, "com.ibm.icu.text.Normalizer", "compose", True)


def collision_key(c: Column) -> Column:
    """File-name identity: NFC plus full case folding."""
    return _icu(nfc(F.lower(c)), "com.ibm.icu.lang.UCharacter", "foldCase", True)


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units: a character outside the basic plane counts twice."""
    return F.length(c) + F.regexp_count(c, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def has_control(c: Column) -> Column:
    return c.rlike(r"[\x00-\x1F\x7F-\x9F]")


def has_control_except_whitespace(c: Column) -> Column:
    return c.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]")


def has_invisible(c: Column) -> Column:
    return c.rlike(r"\p{Cf}")


def text_problem(c: Column, limit: int) -> Column:
    """Null when the text is fine, else a short reason."""
    size = utf16_length(c)
    return F.when(size > limit, F.concat(F.lit(f"longer than {limit} characters ("), size.cast("string"), F.lit(")"))).when(
        has_control(c), F.lit("contains control characters")
    )


def collapse_spaces(c: Column) -> Column:
    """Whitespace runs become one space, ends trimmed; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s\p{Z}\x{85}]+", " "))
