"""Validation: every check is a column; the result is the clean rows and a table of issues."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sitemill import constants as K
from sitemill.functions import paths as P
from sitemill.operators.files import one_row
from sitemill.functions.unicode import collision_key, has_control, has_control_except_whitespace, nfc, utf16_length
from sitemill.session import cut_lineage

# ------------------------------------------------------------------ field kinds

_INSTANT = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]{1,9})?)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?)?\z"


#: The source's limits where a spec gives none.
DEFAULT_MAX = {"text": 500, "textarea": 20_000, "html": 1_000_000, "rows": 500}


def field_problem(c: Column, kind: str, required: bool = False, **limits) -> Column:
    """Code of the first rule a value breaks, null when it is fine. Kinds: text, textarea, html, int,
    number, money, cents, stock, date, bool, select, path, slug, key, media, rows, group. Lengths are limited by max (DEFAULT_MAX
    without one); max=None means no limit."""
    low, high = limits.get("min"), limits["max"] if "max" in limits else DEFAULT_MAX.get(kind)
    over = lambda size: F.lit(False) if high is None else size > high
    bad = {
        "text": lambda: over(utf16_length(c)) | has_control(c),
        "textarea": lambda: over(utf16_length(c)) | has_control_except_whitespace(c),
        "html": lambda: over(utf16_length(c)),
        "int": lambda: (c != F.floor(c)) | ~c.between(low, high),
        "number": lambda: F.isnan(c.cast("double")) | ~c.between(low, high),
        "money": lambda: F.isnan(c) | ~c.between(0, 1_000_000) | (F.abs(F.round(c * 100) - c * 100) > 1e-6),
        "cents": lambda: (c != F.floor(c)) | ~c.between(0, K.MAX_CENTS),
        "stock": lambda: (c != F.floor(c)) | ~c.between(0, K.MAX_STOCK),
        "date": lambda: ~c.rlike(_INSTANT) | c.try_cast("timestamp").isNull(),
        "bool": lambda: F.lit(False),
        "select": lambda: ~c.isin(*limits["options"]),
        "path": lambda: P.bundle_path(c).isNull(),
        "slug": lambda: ~P.is_safe_slug(nfc(c), limits.get("nested", True)),
        "key": lambda: ~P.is_key(c),
        "media": lambda: ~(c.startswith("media:") & P.is_key(F.substr(c, F.lit(7)))),
        "rows": lambda: over(F.size(c)),
        "group": lambda: F.lit(False),
    }[kind]()
    problem = F.when(F.coalesce(bad, F.lit(False)), F.lit(f"invalid-{kind}"))
    return F.when(c.isNull(), F.lit("required") if required else F.lit(None).cast("string")).otherwise(problem)


def validate_fields(df: DataFrame, spec: Mapping[str, tuple], key: str = "key") -> tuple[DataFrame, DataFrame]:
    """spec maps a column to (kind, options). Returns (clean rows, issues(key, field, code)); every
    broken field is reported, not only the first. One pass, no shuffle."""
    checks = [
        F.when(problem.isNotNull(), F.struct(F.lit(name).alias("field"), problem.alias("code")))
        for name, (kind, options) in spec.items()
        for problem in [field_problem(F.col(name), kind, **options)]
    ]
    return split_issues(df, F.array_compact(F.array(*checks)), key)


def split_issues(df: DataFrame, found: Column, key: str = "key") -> tuple[DataFrame, DataFrame]:
    marked = df.withColumn("_found", found)
    issues = marked.where(F.size("_found") > 0).select(F.col(key).alias("key"), F.explode("_found").alias("i")).select("key", "i.field", "i.code")
    return marked.where(F.size("_found") == 0).drop("_found"), issues


def row_rules(df: DataFrame, rules: Mapping[str, tuple[str, Column]], key: str = "key") -> tuple[DataFrame, DataFrame]:
    """rules maps a code to (field, condition that is true when the rule is broken)."""
    found = F.array_compact(F.array(*[
        F.when(F.coalesce(broken, F.lit(False)), F.struct(F.lit(field).alias("field"), F.lit(code).alias("code"))) for code, (field, broken) in rules.items()
    ]))
    return split_issues(df, found, key)


def unknown_fields(json: Column, declared: Sequence[str]) -> Column:
    """Top-level keys of a JSON object that are not declared."""
    return F.array_except(F.coalesce(F.json_object_keys(json), F.array().cast("array<string>")), F.array(*[F.lit(name) for name in declared]))


# ------------------------------------------------------------------ collection rules

def product_rules() -> dict[str, tuple[str, Column]]:
    c = F.col
    folded = lambda name: F.transform(F.filter("variants", lambda v: v[name].isNotNull()), lambda v: F.lower(F.trim(nfc(v[name]))))
    repeated = lambda name: F.size(F.array_distinct(folded(name))) != F.size(folded(name))
    return {
        "price-missing": ("price", c("price").isNull() & c("price_cents").isNull()),
        "price-disagrees": ("price", F.round(c("price") * 100).cast("long") != c("price_cents")),
        "sale-price-disagrees": ("sale_price", F.round(c("sale_price") * 100).cast("long") != c("sale_price_cents")),
        "duplicate-variant-key": ("variants", repeated("legacy_key")),
        "duplicate-variant-sku": ("variants", repeated("sku")),
        "duplicate-variant-label": ("variants", repeated("label")),
        "stock-is-derived": ("stock", (F.size("variants") > 0) & c("stock").isNotNull()),
    }


def page_rules() -> dict[str, tuple[str, Column]]:
    c = F.col
    listed = [c("listing_from"), c("listing_to"), c("listing_total")]
    some = listed[0].isNotNull() | listed[1].isNotNull() | listed[2].isNotNull()
    all_set = listed[0].isNotNull() & listed[1].isNotNull() & listed[2].isNotNull()
    ordered = (listed[0] <= listed[1]) & (listed[1] <= listed[2])
    on = F.coalesce(c("listing"), F.lit(False))
    own = F.exists("listing_links", lambda l: P.route_key(l["path"]) == P.route_key(c("path")))
    return {
        "listing-fields-without-listing": ("listing", ~on & (some | (F.size("listing_links") > 0))),
        "listing-needs-page-kind": ("listing", on & (c("kind") != "page")),
        "listing-range-incomplete": ("listing_from", some & (~all_set | ~F.coalesce(ordered, F.lit(False)))),
        "listing-link-to-self": ("listing_links", own),
    }


def redirect_rules() -> dict[str, tuple[str, Column]]:
    source, target = P.route_key(F.col("from_path")), P.route_key(F.col("to_path"))
    return {
        "redirect-to-self": ("to_path", source == target),
        "redirect-hides-application": ("from_path", P.is_app_route(source) | P.fixed_section(source).isNotNull()),
    }


def period_rules() -> dict[str, tuple[str, Column]]:
    return {"end-before-start": ("ends_at", F.col("ends_at") < F.col("starts_at"))}


def catalogue_rules() -> dict[str, tuple[str, Column]]:
    c = F.col
    stock_bad = lambda s: (s < 0) | (s > K.MAX_STOCK)
    total = F.aggregate("variants", F.lit(0).cast("long"), lambda a, v: a + v["stock"])
    rolled = F.when(~F.exists("variants", lambda v: v["stock"].isNull()), total)
    return {
        "price-disagrees": ("price", F.round(c("price") * 100).cast("long") != c("price_cents")),
        "stock-out-of-range": ("stock", stock_bad(c("stock"))),
        "variant-stock-out-of-range": ("variants", F.exists("variants", lambda v: F.coalesce(stock_bad(v["stock"]), F.lit(False)))),
        "tax-out-of-range": ("tax_rate", F.isnan(c("tax_rate")) | ~c("tax_rate").between(0, 100)),
        "stock-not-rolled-up": ("stock", (F.size("variants") > 0) & ~c("stock").eqNullSafe(rolled)),
    }


def session_rules() -> dict[str, tuple[str, Column]]:
    c, taken = F.col, F.coalesce(F.col("reserved"), F.lit(0))
    return {
        "capacity-below-one": ("capacity", c("capacity") < 1),
        "reserved-out-of-range": ("reserved", (taken < 0) | (taken > c("capacity"))),
        "end-before-start": ("ends_at", c("ends_at") < c("starts_at")),
    }


def settings_rules() -> dict[str, tuple[str, Column]]:
    c = F.col
    host = lambda name, *hosts: ~(
        (P.url_parts(c(name))["scheme"] == "https") & ~P.url_parts(c(name))["has_user"]
        & P.url_parts(c(name))["host"].rlike(r"\A(?:.+\.)?(?:" + "|".join(h.replace(".", r"\.") for h in hosts) + r")\z")
    )
    return {
        "email-invalid": ("email", ~c("email").rlike(r"\A[^\s@]+@[^\s@]+\.[^\s@]+\z")),
        "facebook-host": ("facebook", F.when(c("facebook").isNotNull(), F.coalesce(host("facebook", "facebook.com"), F.lit(True)))),
        "youtube-host": ("youtube", F.when(c("youtube").isNotNull(), F.coalesce(host("youtube", "youtube.com", "youtu.be"), F.lit(True)))),
    }


def cart_rules() -> dict[str, tuple[str, Column]]:
    c = F.col
    return {
        "product-id-invalid": ("product_id", c("product_id").isNull() | (c("product_id") < 1)),
        "quantity-out-of-range": ("qty", c("qty").isNull() | ~c("qty").between(1, K.MAX_QTY)),
    }


def cart_sizes(cart: DataFrame) -> DataFrame:
    """Carts with no lines never appear; carts over 50 lines are rejected whole."""
    return cart.groupBy("order_id").agg(F.count("*").alias("lines")).where(F.col("lines") > K.MAX_CART_LINES)


def handoff_rules() -> dict[str, tuple[str, Column]]:
    c = F.col
    unsafe = lambda name: ~c(name).rlike(r"\A/(?!/)") | c(name).rlike(r"[?#\s\\\x00-\x1F]")
    return {
        "status-not-301": ("status", c("status") != 301),
        "record-id-invalid": ("record_id", c("record_id").isNull() | (c("record_id") <= 0)),
        "unsafe-route": ("from_path", unsafe("from_path") | unsafe("to_path")),
        "redirect-to-self": ("to_path", c("from_path") == c("to_path")),
    }


def handoff_gate(routes: DataFrame, blocking: DataFrame) -> DataFrame:
    """One row: safe only without broken rules, repeated sources and blocking issues."""
    _, issues = row_rules(routes, handoff_rules(), "record_id")
    repeated = routes.groupBy("from_path").agg(F.count("*").alias("n")).where("n > 1")
    row = one_row({"routes": routes, "rule_issues": issues, "repeated": repeated, "blocking": blocking})
    return row.withColumn("safe", (F.col("rule_issues") == 0) & (F.col("repeated") == 0) & (F.col("blocking") == 0))


# ------------------------------------------------------------------ relations, claims, files

def relation_issues(edges: DataFrame, spec: DataFrame) -> DataFrame:
    """edges(src_id, collection, field, pos, dst_id), spec(collection, field, target, many) -> issues:
    undeclared relation, wrong target, a list where one is allowed, repeats, more than 500."""
    # a stored table has a known size: one of unknown size would be joined by a shuffle, all edges of a field in one task
    spec = cut_lineage(spec)
    joined = edges.join(spec, ["collection", "field"], "left")
    per_row = joined.select(
        "src_id", "field",
        F.when(F.col("target").isNull(), F.lit("unsupported-relation"))
        .when(~F.col("dst_id").startswith(F.concat("target", F.lit(":"))), F.lit("wrong-target")).alias("code"),
    ).where("code is not null").distinct()
    per_target = edges.groupBy("src_id", "collection", "field", "dst_id").agg(F.count("*").alias("n"))
    sized = per_target.groupBy("src_id", "collection", "field").agg(F.sum("n").alias("n"), F.max("n").alias("most")).join(spec, ["collection", "field"])
    per_field = sized.select(
        "src_id", "field",
        F.when((F.col("n") > 1) & ~F.col("many"), F.lit("single-reference-expected"))
        .when(F.col("most") > 1, F.lit("duplicate-reference"))
        .when(F.col("n") > K.MAX_RELATIONS, F.lit("too-many-references")).alias("code"),
    ).where("code is not null")
    return per_row.unionByName(per_field)


def missing_required(entities: DataFrame, edges: DataFrame, spec: DataFrame) -> DataFrame:
    """entities(id, collection) without a required relation: (src_id, field)."""
    wanted = entities.join(spec.where("required"), "collection").select(F.col("id").alias("src_id"), "field")
    return wanted.join(edges.select("src_id", "field").distinct(), ["src_id", "field"], "left_anti")


def missing_references(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges whose target does not exist."""
    return edges.join(ids.select(F.col("id").alias("dst_id")).distinct(), "dst_id", "left_anti")


def redirect_rule_issues(rules: DataFrame, live: DataFrame, chains: DataFrame) -> DataFrame:
    """rules(id, from_path, to_path), live(route), chains(src, cycle, too_long) -> (id, code)."""
    local, issues = row_rules(rules, redirect_rules(), "id")
    routed = local.withColumn("route", P.route_key(F.col("from_path")))
    over_live = routed.join(live.select("route").distinct(), "route", "left_semi").select("id", F.lit("redirect-over-content").alias("code"))
    looping = routed.join(chains.where("cycle or too_long").select(F.col("src").alias("route")), "route", "left_semi").select("id", F.lit("redirect-chain-does-not-end").alias("code"))
    return issues.select(F.col("key").alias("id"), "code").unionByName(over_live).unionByName(looping)


def file_set_issues(files: DataFrame, max_files: int, max_bytes: int) -> DataFrame:
    """files(path, size) -> unsafe paths, names that collide after normalisation, and quota breaches."""
    unsafe = files.where(~P.safe_file_path(F.col("path"))).select("path", F.lit("unsafe-path").alias("code"))
    named = files.withColumn("_name", collision_key(F.col("path")))
    clash = named.groupBy("_name").agg((F.min("path") != F.max("path")).alias("clash")).where("clash").select("_name")
    collisions = named.join(clash, "_name", "left_semi").select("path", F.lit("name-collision").alias("code"))
    totals = files.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    over = totals.select(F.explode(F.array_compact(F.array(
        F.when(F.col("n") > max_files, F.lit("too-many-files")), F.when(F.col("bytes") > max_bytes, F.lit("too-many-bytes"))
    ))).alias("code")).select(F.lit(None).cast("string").alias("path"), "code")
    return unsafe.unionByName(collisions).unionByName(over)


def descriptor_issues(media: DataFrame) -> DataFrame:
    """media(key, path, sha256, url_path) -> (key, code): safe relative path, digest, unique key, one
    key per address."""
    rules = {
        "key-invalid": ("key", ~P.is_key(F.col("key"))),
        "path-unsafe": ("path", ~P.safe_file_path(F.col("path"))),
        "digest-invalid": ("sha256", ~F.coalesce(F.col("sha256").rlike(r"\A[a-f0-9]{64}\z"), F.lit(False))),
    }
    _, issues = row_rules(media, rules)
    repeated = media.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.lit("key").alias("field"), F.lit("key-repeated").alias("code"))
    shared = media.where("url_path is not null").groupBy("url_path").agg((F.min("key") != F.max("key")).alias("clash")).where("clash").select("url_path")
    claimed = media.join(shared, "url_path", "left_semi").select("key", F.lit("url").alias("field"), F.lit("url-claimed-twice").alias("code"))
    return issues.unionByName(repeated).unionByName(claimed)
