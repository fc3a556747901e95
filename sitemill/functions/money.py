"""Prices in integer cents, stock and quantities. Unknown stock is null, never zero."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sitemill import constants as K
from sitemill.functions.binding import let


def _cents(c: Column) -> Column:
    return F.when(c >= 0, c.cast("long"))


def cents_of(cents: Column, amount: Column) -> Column:
    """The cents field first; the decimal field only when cents are empty."""
    usable = ~F.isnan(amount) & (amount >= 0) & (amount < 10_000_000)
    return F.coalesce(_cents(cents), F.when(usable, F.round(amount * 100).cast("long")))


def legacy_cents(amount: Column) -> Column:
    """Half-up cents of a non-negative decimal amount, null when out of range."""
    value = F.floor((amount + F.lit(2.220446049250313e-16)) * 100 + 0.5).cast("long")
    return F.when((amount >= 0) & (value <= K.MAX_CENTS), value)


def product_price(base: Column, sale: Column) -> Column:
    """struct(base, sale, current): a sale counts only as a real reduction of a known price."""
    on_sale = F.coalesce((sale > 0) & (sale < base), F.lit(False))
    return F.struct(
        base.alias("base"),
        F.when(on_sale, sale).alias("sale"),
        F.when(on_sale, sale).otherwise(F.nullif(base, F.lit(0).cast("long"))).alias("current"),
    )


def variant_price(base: Column, sale: Column, own: Column) -> Column:
    """A variant's own price replaces the product price and its promotion."""
    has_own = F.coalesce(own >= 0, F.lit(False))
    product = product_price(base, sale)
    return F.struct(
        F.when(has_own, own).otherwise(product["base"]).alias("base"),
        F.when(~has_own, product["sale"]).alias("sale"),
        F.when(has_own, F.nullif(own, F.lit(0).cast("long"))).otherwise(product["current"]).alias("current"),
    )


def quote_unit_price(base: Column, sale: Column, own: Column) -> Column:
    """Price a cart line is charged; 0 or null means the line is rejected."""
    on_sale = F.coalesce((sale > 0) & (sale < base), F.lit(False))
    return F.coalesce(own, F.when(on_sale, sale).otherwise(base))


def price_span(base: Column, sale: Column, variants: Column) -> Column:
    """struct(min, max) of current prices over variants (or of the product); nulls skipped."""
    product = F.array(product_price(base, sale)["current"])
    per_variant = F.transform(variants, lambda v: variant_price(base, sale, v["price_cents"])["current"])
    known = F.array_compact(F.when(F.size(variants) > 0, per_variant).otherwise(product))
    span = lambda prices: F.struct(F.array_min(prices).alias("min"), F.array_max(prices).alias("max"))
    return let(known, lambda prices: F.when(F.size(prices) > 0, span(prices)))


def stock_number(stock: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.floor(stock).cast("long"))


def known_stock(stock: Column, variants: Column) -> Column:
    """Sum of known variants; null when none is known, or a zero sum leaves some unknown."""
    known = F.transform(F.filter(variants, lambda v: v["stock"].isNotNull()), lambda v: stock_number(v["stock"]))
    total = F.aggregate(known, F.lit(0).cast("long"), lambda acc, n: acc + n)
    unclear = (F.size(known) == 0) | ((total == 0) & (F.size(known) < F.size(variants)))
    own = F.when(stock.isNotNull(), stock_number(stock))
    return F.when(F.size(variants) > 0, F.when(~unclear, total)).otherwise(own)


def stored_stock(stock: Column, variants: Column) -> Column:
    """Product stock as stored: null when any variant is unknown, else the sum."""
    total = F.aggregate(variants, F.lit(0).cast("long"), lambda acc, v: acc + v["stock"])
    return F.when(F.size(variants) > 0, F.when(~F.exists(variants, lambda v: v["stock"].isNull()), total)).otherwise(stock)


def stock_state(stock: Column) -> Column:
    return F.when(stock.isNull(), F.lit("unknown")).when(stock > 0, F.lit("in")).otherwise(F.lit("out"))


def seats_left(capacity: Column, reserved: Column) -> Column:
    """Null without a capacity limit, never negative."""
    taken = F.greatest(F.coalesce(reserved, F.lit(0)), F.lit(0))
    return F.when(capacity >= 1, F.greatest(F.lit(0).cast("long"), F.floor(capacity - taken).cast("long")))


def parse_pln_cents(text: Column) -> Column:
    """'1 299,00 zł' is 129900; anything not plainly in that notation is null."""
    shape = r"(?iu)\A([0-9]{1,3}(?:[ .][0-9]{3})+|[0-9]+)(?:,([0-9]{2}))?\s*(?:zł|pln)\z"

    def cents(value: Column) -> Column:
        whole = F.regexp_replace(F.regexp_extract(value, shape, 1), "[ .]", "")
        part = F.regexp_extract(value, shape, 2)
        return F.when(value.rlike(shape), whole.cast("long") * 100 + F.when(part == "", F.lit("0")).otherwise(part).cast("long"))

    return let(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s\x{00A0}\x{202F}\x{2009}]+", " ")), cents)


def format_cents(cents: Column) -> Column:
    """'12,34 zł' style text of integer cents."""
    return F.concat(
        F.floor(cents / 100).cast("long").cast("string"), F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0"), F.lit(" zł")
    )


def format_money(cents: Column) -> Column:
    """Display form: thousands apart from five digits on, non-breaking spaces; empty for null."""
    whole = F.floor(F.abs(cents) / 100).cast("long").cast("string")
    grouped = F.when(F.length(whole) > 4, F.regexp_replace(whole, r"(?<=[0-9])(?=(?:[0-9]{3})+\z)", " ")).otherwise(whole)
    sign = F.when(cents < 0, F.lit("-")).otherwise(F.lit(""))
    text = F.concat(sign, grouped, F.lit(","), F.lpad((F.abs(cents) % 100).cast("string"), 2, "0"), F.lit(" zł"))
    return F.coalesce(text, F.lit(""))


def clamp_qty(qty: Column, cap: Column) -> Column:
    """Whole quantity between 1 and the smaller of the known stock and 99."""
    top = F.least(F.coalesce(cap, F.lit(K.MAX_QTY)), F.lit(K.MAX_QTY))
    return F.greatest(F.lit(1).cast("long"), F.least(F.floor(qty).cast("long"), top.cast("long")))


def course_price(session_cents: Column, course_cents: Column) -> Column:
    """The next session's price, else the course price."""
    return F.coalesce(session_cents, course_cents)
