"""Digests used for identity and change detection."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def stable_hash(*fields: Column) -> Column:
    """sha256 over the JSON of a struct whose field order is fixed by the caller; nulls count."""
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)


def text_digest(*parts: Column) -> Column:
    """sha256 over parts joined by a unit separator; null parts are marked."""
    marked = [F.coalesce(part.cast("string"), F.lit("\x00")) for part in parts]
    return F.sha2(F.concat_ws("\x1f", *marked), 256)


def fnv1a32(c: Column) -> Column:
    """FNV-1a over UTF-16 code units, 8 hex digits."""
    units = F.hex(F.encode(c, "UTF-16BE"))
    unit = lambda i: F.conv(F.substr(units, i * 4 + 1, F.lit(4)), 16, 10).cast("long")
    step = lambda h, i: (h.bitwiseXOR(unit(i)) * F.lit(16777619)).bitwiseAND(F.lit(4294967295))
    start = F.lit(2166136261).cast("long")
    value = F.aggregate(F.sequence(F.lit(0), (F.length(units) / 4).cast("int") - 1), start, step)
    return F.lpad(F.lower(F.hex(F.when(F.length(c) == 0, start).otherwise(value))), 8, "0")


def file_digest(content: Column) -> Column:
    return F.sha2(content, 256)


def digest_lanes(*fields: Column) -> list[Column]:
    """All 256 bits of a row's digest as eight numbers, whose sums do not depend on row order (see table_digest)."""
    digest = text_digest(*fields)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("decimal(38,0)") for k in range(8)]
