"""JSON documents: structured data, page metadata, consent and quotes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sitemill.functions.money import known_stock, product_price, variant_price
from sitemill.functions.paths import canonical_path, content_href, public_seo_path
from sitemill.functions.text import excerpt, phone_parts, plain_text, script_safe_json

_SCHEMA = "https://schema.org"


def seo_url(path: Column, origin: str) -> Column:
    """Absolute address of a public path; each segment percent-encoded."""
    safe = public_seo_path(path)
    encoded = F.array_join(F.transform(F.split(safe, "/"), lambda part: F.replace(F.url_encode(part), F.lit("+"), F.lit("%20"))), "/")
    return F.concat(F.lit(origin.rstrip("/")), encoded)


def _money(cents: Column) -> Column:
    return F.format_string("%d.%02d", F.floor(cents / 100).cast("long"), (cents % 100).cast("long"))


def _offer(url: Column, price: Column, stock: Column, name: Column) -> Column:
    state = F.when(stock > 0, F.lit(f"{_SCHEMA}/InStock")).when(stock.isNotNull(), F.lit(f"{_SCHEMA}/OutOfStock"))
    return F.struct(
        F.lit("Offer").alias("@type"), url.alias("url"), F.lit("PLN").alias("priceCurrency"), _money(price).alias("price"),
        F.nullif(name, F.lit("")).alias("name"), state.alias("availability"),
    )


def product_json(name: Column, url: Column, base: Column, sale: Column, stock: Column, variants: Column, text: Column, sku: Column, maker: Column) -> Column:
    """Product with one offer per priced variant; availability only where stock is known."""
    none = F.lit(None).cast("string")
    own = product_price(base, sale)["current"]
    priced = F.filter(variants, lambda v: variant_price(base, sale, v["price_cents"])["current"].isNotNull())
    offers = F.transform(
        priced,
        lambda v: _offer(url, variant_price(base, sale, v["price_cents"])["current"], v["stock"].cast("long"), F.trim(v["label"])),
    )
    single = F.when(own.isNotNull(), F.array(_offer(url, own, known_stock(stock, variants), none)))
    chosen = F.when(F.size(variants) > 0, F.when(F.size(offers) > 0, offers)).otherwise(single)
    brand = F.when(F.coalesce(maker, F.lit("")) != "", F.struct(F.lit("Brand").alias("@type"), maker.alias("name")))
    doc = F.struct(
        F.lit(_SCHEMA).alias("@context"), F.lit("Product").alias("@type"), name.alias("name"), url.alias("url"),
        F.nullif(excerpt(plain_text(text), 1000), F.lit("")).alias("description"),
        F.nullif(sku, F.lit("")).alias("sku"), brand.alias("brand"), chosen.alias("offers"),
    )
    return F.when(F.trim(name) != "", script_safe_json(F.to_json(doc)))


def course_json(name: Column, url: Column, lead: Column, body: Column, provider: str, origin: str) -> Column:
    title = F.trim(name)
    doc = F.struct(
        F.lit(_SCHEMA).alias("@context"), F.lit("Course").alias("@type"), title.alias("name"), url.alias("url"),
        F.nullif(excerpt(plain_text(F.coalesce(F.nullif(lead, F.lit("")), body)), 1000), F.lit("")).alias("description"),
        F.struct(F.lit("Organization").alias("@type"), F.lit(provider).alias("name"), F.lit(origin).alias("url")).alias("provider"),
    )
    return F.when((title != "") & url.isNotNull(), script_safe_json(F.to_json(doc)))


def organization_json(name: str, origin: str, phone: Column, mail: Column, address: Column, profiles: Column) -> Column:
    numbers = F.array_distinct(
        F.transform(F.filter(phone_parts(phone), lambda p: p["href"].isNotNull()), lambda p: F.substr(p["href"], F.lit(5)))
    )
    links = F.array_distinct(F.filter(profiles, lambda link: link.rlike(r"\Ahttps://[^/?#@:]+(?:/[^?#]*)?\z")))
    doc = F.struct(
        F.lit(_SCHEMA).alias("@context"), F.lit("Organization").alias("@type"), F.lit(origin + "/#organization").alias("@id"),
        F.lit(name).alias("name"), F.lit(origin).alias("url"),
        F.when(F.size(numbers) > 0, numbers).alias("telephone"),
        F.when(F.trim(mail).rlike(r"\A[^\s@]+@[^\s@]+\.[^\s@]+\z"), F.trim(mail)).alias("email"),
        F.nullif(F.trim(address), F.lit("")).alias("address"),
        F.when(F.size(links) > 0, links).alias("sameAs"),
    )
    return script_safe_json(F.to_json(doc))


def page_meta(title: Column, seo_title: Column, seo_text: Column, lead: Column, body: Column, path: Column, legacy: Column) -> Column:
    """struct(title, description, canonical): source metadata first, then the record's own text."""
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.struct(
        F.coalesce(some(seo_title), some(title)).alias("title"),
        F.coalesce(some(seo_text), F.nullif(excerpt(plain_text(lead)), F.lit("")), F.nullif(excerpt(plain_text(body)), F.lit(""))).alias("description"),
        public_seo_path(canonical_path(content_href(path), legacy)).alias("canonical"),
    )


def parse_consent(raw: Column) -> Column:
    """struct(decided, analytics): only version 1 with a boolean answer counts."""
    value = F.from_json(raw, "v double, analytics string")
    strict = F.get_json_object(raw, "$.analytics").isin("true", "false") & ~raw.rlike(r'"analytics"\s*:\s*"') & ~raw.rlike(r'"v"\s*:\s*"')
    decided = F.coalesce((value["v"] == 1) & strict, F.lit(False))
    return F.struct(decided.alias("decided"), (decided & F.coalesce(value["analytics"] == "true", F.lit(False))).alias("analytics"))


_QUOTE = (
    "items array<struct<product long, name string, variantId string, variant string, qty long, unitPriceCents long, lineTotalCents long>>,"
    "subtotalCents long, deliveryCents long, totalCents long, currency string, deliveryMethod string,"
    "deliveryMethods array<struct<id string, label string, priceCents long>>"
)


def parse_quote(raw: Column) -> Column:
    """The quote as a struct, or null when its shape is wrong."""
    q = F.from_json(raw, _QUOTE)
    items_ok = F.forall(
        q["items"],
        lambda i: i["product"].isNotNull() & (F.length(i["name"]) <= 300) & i["qty"].isNotNull()
        & i["unitPriceCents"].isNotNull() & i["lineTotalCents"].isNotNull(),
    )
    methods_ok = F.forall(
        q["deliveryMethods"], lambda m: (F.length(m["id"]) <= 80) & (F.length(m["label"]) <= 300) & m["priceCents"].isNotNull()
    )
    head_ok = (
        q["subtotalCents"].isNotNull() & q["deliveryCents"].isNotNull() & q["totalCents"].isNotNull()
        & (F.length(q["currency"]) <= 8) & (F.length(q["deliveryMethod"]) <= 80)
    )
    return F.when(F.coalesce(items_ok & methods_ok & head_ok, F.lit(False)), q)
