"""Change detection, validation, media and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sitemill.functions.hashing import text_digest
from sitemill.operators import cdc as D, files as FS, media as M, nested as N, validate as V
from sitemill.operators.pages import numbered_list, text_limit_issues
from sitemill.sources.adapters import table, view, with_views


# ------------------------------------------------------------------ change detection

def _decisions(spark: SparkSession, sf: str) -> DataFrame:
    stored = view(spark, sf, "v_stored")
    old = stored.select(
        F.col("legacy_key").alias("key"),
        F.when(F.col("legacy_key") % 13 != 0, text_digest(F.col("name"), F.col("imported"))).alias("stored_source_hash"),
        F.when(F.col("legacy_key") % 13 != 0, text_digest(F.col("name"), F.col("imported"))).alias("stored_content_hash"),
        text_digest(F.col("name"), F.col("content")).alias("content_hash"), (F.col("legacy_key") % 6).alias("reserved"),
    )
    new = view(spark, sf, "v_incoming").select(F.col("legacy_key").alias("key"), text_digest(F.col("name"), F.col("content")).alias("source_hash"), (F.col("legacy_key") % 5).alias("capacity"))
    return D.capacity_guard(D.decide(new, old))


def cdc_decisions(spark: SparkSession, sf: str) -> DataFrame:
    return _decisions(spark, sf).select("key", "action", "reason")


def cdc_plan_counts(spark: SparkSession, sf: str) -> DataFrame:
    return D.plan_counts(_decisions(spark, sf))


def cdc_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    group = lambda df: df.select(F.concat(F.lit("c"), (F.col("legacy_key") % 3).cast("string")).alias("collection"), F.col("legacy_key").alias("key"))
    return D.reconcile(group(view(spark, sf, "v_incoming")), group(view(spark, sf, "v_stored")))


def missing_and_extra(spark: SparkSession, sf: str) -> DataFrame:
    return D.missing_and_extra(view(spark, sf, "v_incoming"), view(spark, sf, "v_stored"), "legacy_key")


def unresolved_list(spark: SparkSession, sf: str) -> DataFrame:
    """All distinct notes with their place in the report."""
    notes = _decisions(spark, sf).where("action = 'conflicts'").select(F.concat_ws(":", "reason", F.col("key").cast("string")).alias("note"))
    return numbered_list(notes, "note")


def variant_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Stored and incoming variants: keys agree for some, others match by sku or label, some are new."""
    v = view(spark, sf, "v_variant")
    p, n = F.col("product_id"), F.col("pos")
    key = F.concat(F.lit("k"), n.cast("string"))
    old = v.select(
        "product_id", (p * 10 + n).alias("row_id"), F.when(p % 2 == 0, key).alias("legacy_key"), F.when(p % 3 == 1, F.concat(F.lit("SKU-"), n.cast("string"))).alias("sku"),
        F.concat(F.lit("Size "), n.cast("string")).alias("label"), F.col("stock").cast("long").alias("stock"),
    ).where("not (product_id % 7 = 0 and row_id % 10 = 1)")
    new = v.select(
        "product_id", "pos", F.when(p % 4 == 0, key).alias("legacy_key"), F.when(p % 3 == 1, F.concat(F.lit("sku-"), n.cast("string"))).alias("sku"),
        F.when(p % 11 == 0, F.lit("size 0")).otherwise(F.concat(F.lit("size "), n.cast("string"))).alias("label"), F.lit(9).cast("long").alias("stock"),
    ).where("not (product_id % 5 = 0 and pos = 2)")
    return D.merge_variants(old, new)


def foreign_collisions(spark: SparkSession, sf: str) -> DataFrame:
    claims = view(spark, sf, "v_incoming").select(F.concat(F.lit("/n-"), (F.col("legacy_key") % 700).cast("string")).alias("claim"), F.col("legacy_key").alias("owner"))
    held = view(spark, sf, "v_stored").select(
        F.concat(F.lit("/n-"), F.col("legacy_key").cast("string")).alias("claim"), F.when(F.col("legacy_key") % 17 > 0, F.col("legacy_key")).alias("owner")
    )
    return D.foreign_collisions(claims, held)


def settings_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Nation comments stand for settings: some empty, some equal, some different."""
    nation = table(spark, sf, "nation")
    incoming = nation.select(F.col("n_name").alias("name"), F.col("n_name").alias("value"))
    current = nation.select(F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 3 == 0, F.lit("")).when(F.col("n_nationkey") % 3 == 1, F.col("n_name")).otherwise(F.lit("other")).alias("value"))
    return D.settings_changes(incoming, current).select("name", "change")


def snapshot_changes(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    old = orders.select("o_orderkey", "o_totalprice", "o_orderstatus")
    new = orders.select("o_orderkey", F.when(F.col("o_orderkey") % 10 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("o_totalprice"),
                        F.when(F.col("o_orderkey") % 15 == 0, F.lit(None)).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))
    return D.snapshot_changes(old, new, "o_orderkey", ["o_totalprice", "o_orderstatus"])


def table_digests(spark: SparkSession, sf: str) -> DataFrame:
    """Order-independent digests of two tables; equal before and after a shuffle of the rows."""
    one = lambda name, columns: D.table_digest(table(spark, sf, name), columns).withColumn("name", F.lit(name))
    return one("orders", ["o_orderkey", "o_custkey", "o_orderstatus"]).unionByName(one("customer", ["c_custkey", "c_name"]))


# ------------------------------------------------------------------ validation

def entity_field_rejects(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    k = F.col("p_partkey")
    rows = part.select(
        k.alias("key"),
        F.when(k % 19 != 0, F.col("p_name")).alias("name"),
        F.when(k % 8 == 0, F.concat(F.lit("bad slug "), k.cast("string"))).otherwise(F.concat(F.lit("p-"), k.cast("string"))).alias("slug"),
        F.when(k % 9 == 0, F.col("p_retailprice") + 0.001).otherwise(F.col("p_retailprice")).alias("price"),
        F.when(k % 7 == 0, F.lit(-1)).when(k % 5 != 0, F.col("p_size")).cast("long").alias("stock"),
        F.when(k % 6 == 0, F.lit("/a/../b")).otherwise(F.concat(F.lit("/p-"), k.cast("string"), F.lit("/"))).alias("legacy_path"),
        F.when(k % 4 == 0, F.lit("PADI")).when(k % 4 == 1, F.lit("none")).alias("org"),
        F.when(k % 3 == 0, F.lit("2026-02-30")).otherwise(F.lit("2026-03-01T10:00:00Z")).alias("next_date"),
    )
    spec = {
        "name": ("text", {"max": 300, "required": True}), "slug": ("slug", {"required": True}), "price": ("money", {}), "stock": ("stock", {}),
        "legacy_path": ("path", {}), "org": ("select", {"options": ["PADI", "IANTD", "TDI/SDI", "Freediving", "Inne"]}), "next_date": ("date", {}),
    }
    return V.validate_fields(rows, spec)[1]


# a record with lists and groups as a batch brings it
_NESTED = {
    "name": ("text", {"max": 300, "required": True}), "seo": ("group", {"fields": {"title": ("text", {"max": 300}), "image": ("media", {})}}),
    "features": ("rows", {"fields": {"text": ("text", {"max": 1000, "required": True})}}), "price": ("money", {}), "featured": ("bool", {}),
    "variants": ("rows", {"max": 3, "fields": {"label": ("text", {"max": 300, "required": True}), "sku": ("text", {"max": 200}), "stock": ("stock", {}), "image": ("media", {})}}),
}


def nested_entity_issues(spark: SparkSession, sf: str) -> DataFrame:
    """Products as JSON with faults at several depths; files m-0 to m-29 come with the batch."""
    part, k = table(spark, sf, "part"), F.col("p_partkey")
    media = lambda n: F.concat(F.lit("media:m-"), n.cast("string"))
    variant = lambda n: F.struct(
        F.when((k + n) % 11 > 0, F.concat(F.lit("é "), n.cast("string"))).alias("label"), F.when((k + n) % 7 == 0, F.lit(-1)).otherwise(n).alias("stock"),
        F.when(n == 1, media(k % 37)).when((n == 2) & (k % 2 == 0), F.lit("picture.jpg")).alias("image"), F.when((k + n) % 13 == 0, F.lit("x")).alias("id"),
    )
    seo = F.struct(F.when(k % 17 == 0, F.repeat(F.lit("w"), 400)).otherwise(F.col("p_name")).alias("title"), media(k % 40).alias("image"), F.when(k % 19 == 0, F.lit("a,b")).alias("keywords"))
    record = F.struct(
        F.when(k % 5 > 0, F.col("p_name")).alias("name"), F.when(k % 6 > 0, seo).alias("seo"), F.when(k % 23 == 0, F.lit("none")).alias("features"), F.col("p_retailprice").alias("price"),
        F.transform(F.sequence(F.lit(1), (k % 4 + 1).cast("int")), variant).alias("variants"), F.when(k % 29 == 0, k).alias("id"), F.when(k % 31 == 0, F.lit("yes")).alias("featured"),
    )
    rows = part.select(k.alias("key"), F.when(k % 41 == 0, F.lit("[1]")).otherwise(F.to_json(record)).alias("data"))
    bundle = part.select(F.concat(F.lit("m-"), (k % 30).cast("string")).alias("key"))
    return N.validate_nested(rows, _NESTED, bundle=bundle)[1]


def entity_missing_refs(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines refer to parts; parts over a limit are not in the batch."""
    edges = view(spark, sf, "v_order_item").select(F.col("order_id").alias("src_id"), "pos", F.col("product_id").alias("dst_id"))
    return V.missing_references(edges, table(spark, sf, "part").where("p_partkey % 23 <> 0").select(F.col("p_partkey").alias("id"))).select("src_id", "pos", "dst_id")


def relation_issues(spark: SparkSession, sf: str) -> DataFrame:
    items = view(spark, sf, "v_order_item")
    edges = items.select(
        F.col("order_id").alias("src_id"), F.lit("products").alias("collection"),
        F.when(F.col("pos") == 7, F.lit("category")).when(F.col("pos") == 6, F.lit("unknown")).otherwise(F.lit("images")).alias("field"), "pos",
        F.concat(F.when(F.col("pos") == 5, F.lit("courses:")).when(F.col("pos") == 7, F.lit("categories:")).otherwise(F.lit("media:")), (F.col("product_id") % 30).cast("string")).alias("dst_id"),
    )
    spec = spark.createDataFrame([("products", "images", "media", True, False), ("products", "category", "categories", False, True)], "collection string, field string, target string, many boolean, required boolean")
    return V.relation_issues(edges, spec)


def redirect_rule_issues(spark: SparkSession, sf: str) -> DataFrame:
    from sitemill.functions.paths import route_key
    from sitemill.operators.graph import redirect_closure

    rules = view(spark, sf, "v_redirect").select("id", F.col("src").alias("from_path"), F.col("dst").alias("to_path"))
    edges = rules.select(route_key(F.col("from_path")).alias("src"), route_key(F.col("to_path")).alias("dst"))
    live = table(spark, sf, "supplier").select(F.concat(F.lit("r-"), F.col("s_suppkey").cast("string")).alias("route"))
    return V.redirect_rule_issues(rules, live, redirect_closure(edges))


def session_rule_issues(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "v_schedule").where("kind = 'course'").select(
        F.col("id").alias("key"), "capacity", "reserved", "starts_at", F.when(F.col("id") % 9 == 0, F.col("starts_at") - F.expr("interval 1 day")).alias("ends_at")
    )
    return V.row_rules(rows, V.session_rules())[1]


# ------------------------------------------------------------------ media and files

def media_attach(spark: SparkSession, sf: str) -> DataFrame:
    available = table(spark, sf, "part").where("p_partkey % 6 <> 0").select(F.concat(F.lit("m-"), F.col("p_partkey").cast("string")).alias("media_key"))
    return M.attach_media(view(spark, sf, "v_media_target"), available)


def media_inventory(spark: SparkSession, sf: str) -> DataFrame:
    item = view(spark, sf, "v_media_target")
    refs = item.select(
        F.concat(F.lit("img/"), "media_key", F.lit(".jpg")).alias("path"),
        F.concat(F.lit("https://shop.example.com/img/"), "media_key", F.when(F.col("pos") % 3 == 0, F.lit("%2Ejpg")).otherwise(F.lit(".jpg"))).alias("url"),
        F.when(F.col("pos") % 2 == 0, F.concat(F.lit("alt "), (F.col("entity_id") % 10).cast("string"))).otherwise(F.lit("")).alias("alt"),
        (F.col("entity_id") * 10 + F.col("pos")).alias("pos"),
    )
    return M.media_inventory(refs)


def content_refs(spark: SparkSession, sf: str) -> DataFrame:
    item = view(spark, sf, "v_media_target")
    number = F.col("entity_id") * 10 + F.col("pos")
    refs = item.select(
        number.alias("ref_id"), F.when(number % 11 == 0, F.lit("external")).when(number % 13 == 0, F.lit("unsafe")).otherwise(F.lit("path")).alias("kind"),
        F.concat(F.lit("/img/"), "media_key", F.lit(".jpg")).alias("path"),
    )
    part = table(spark, sf, "part")
    key = F.concat(F.lit("m-"), F.col("p_partkey").cast("string"))
    media = part.where("p_partkey % 4 <> 0").select(F.concat(F.lit("/img/"), key, F.lit(".jpg")).alias("path"), key.alias("media_key"))
    return M.reference_outcomes(refs, media, part.where("p_partkey % 5 <> 0").select(key.alias("media_key"))).select("ref_id", "outcome", "media_key")


def _files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents stand for files: path, size and digest come from their text."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.concat(F.lit("docs/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.octet_length(F.encode("text", "utf-8")).cast("long").alias("size"), F.sha2(F.encode("text", "utf-8"), 256).alias("sha256"))


def manifest_diff(spark: SparkSession, sf: str) -> DataFrame:
    files = _files(spark, sf)
    manifest = files.where("doc_id % 10 <> 3").select("path", F.when(F.col("doc_id") % 10 == 5, F.col("size") + 1).otherwise(F.col("size")).alias("size"), F.when(F.col("doc_id") % 10 == 7, F.lit("0" * 64)).otherwise(F.col("sha256")).alias("sha256"))
    return FS.manifest_diff(manifest, files.where("doc_id % 10 <> 4"))


def file_states(spark: SparkSession, sf: str) -> DataFrame:
    files = _files(spark, sf)
    k = F.col("doc_id") % 10
    records = files.where("doc_id % 10 < 7").select("path", F.when(k == 1, F.col("size") + 5).otherwise(F.col("size")).alias("inventory_bytes"), "sha256", (~k.isin(2, 6)).alias("complete"))
    objects = files.where("doc_id % 10 not in (6, 8)").select("path", F.when(k == 3, F.lit("bad")).otherwise(F.col("sha256")).alias("sha256"))
    return FS.snapshot_states(files, records, objects)


def file_set_issues(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    name = F.when(F.col("doc_id") % 9 == 0, F.lit(".env.local")).when(F.col("doc_id") % 7 == 0, F.concat(F.lit("File-"), (F.col("doc_id") % 50).cast("string"))).otherwise(F.concat(F.lit("file-"), F.col("doc_id").cast("string")))
    files = d.select(F.concat(F.lit("d/"), name).alias("path"), F.col("n_chars").alias("size"))
    return V.file_set_issues(files, 100, 10**15)


def file_totals(spark: SparkSession, sf: str) -> DataFrame:
    return FS.size_totals(_files(spark, sf))


def table_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return FS.table_statistics({name: table(spark, sf, name) for name in ("orders", "lineitem", "part", "customer", "pages")})


def metric_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select(F.col("event_type").alias("route"), "value")
    return FS.metric_summary(rows, 25.0)


def coverage_summary(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    outcome = F.when(F.col("event_id") % 10 == 0, F.lit("skipped")).when(F.col("event_id") % 7 == 0, F.lit("failed")).otherwise(F.lit("passed"))
    return FS.coverage_summary(e.select(F.col("event_type").alias("kind"), outcome.alias("outcome")))


def settings_consensus(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as captures of a setting per customer: some customers always show one value."""
    o = table(spark, sf, "orders")
    return D.settings_consensus(o.select(F.concat(F.lit("s-"), (F.col("o_custkey") % 500).cast("string")).alias("name"), F.when(F.col("o_custkey") % 500 < 250, F.lit("same")).otherwise(F.col("o_orderstatus")).alias("value")))


def document_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """Linked PDF addresses against the files at hand."""
    d = table(spark, sf, "documents")
    name = F.concat(F.lit("/docs/"), (F.col("doc_id") - F.col("doc_id") % 7).cast("string"))
    links = d.select(F.concat(name, F.when(F.col("doc_id") % 3 == 0, F.lit(".html")).otherwise(F.lit(".PDF"))).alias("path"))
    files = d.where("doc_id % 7 = 0 and doc_id % 4 <> 0").select(F.concat(name, F.lit(".PDF")).alias("path"), F.sha2(F.encode("text", "utf-8"), 256).alias("sha256"), F.col("n_chars").alias("size"))
    return FS.document_inventory(links, files)


def cache_reuse(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    part = table(spark, sf, "part").select(k, F.concat(F.lit("m-"), k.cast("string")).alias("media_key"), F.sha2(F.encode("p_name", "utf-8"), 256).alias("sha256"))
    cache = part.where("p_partkey % 2 = 0").select("media_key", F.when(k % 6 == 0, F.lit("x")).otherwise(F.col("sha256")).alias("sha256"))
    return M.reuse_cache(part.select("media_key", F.when(k % 5 > 0, F.col("sha256")).alias("sha256")), cache, part.where("p_partkey % 3 = 0").select("media_key", "sha256"))


def media_staging(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    part = table(spark, sf, "part").select(k, F.concat(F.lit("m-"), k.cast("string")).alias("media_key"))
    wanted = part.select("media_key", F.concat(F.lit("img/"), F.when(k % 10 == 0, k + 1).otherwise(k).cast("string")).alias("path"))
    return M.staging_plan(wanted, part.where("p_partkey % 3 = 0"), part.where("p_partkey % 4 = 0")).select("media_key", "state")


def document_attachment(spark: SparkSession, sf: str) -> DataFrame:
    files = _files(spark, sf)
    descriptors = files.select(F.col("path").alias("key"), "sha256", F.when(F.col("doc_id") % 6 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"))
    ready, rejected = M.attach_documents(descriptors, files)
    return ready.select("key", F.lit("ready").alias("status")).unionByName(rejected.select("key", F.lit("rejected").alias("status")))


def home_aliases(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as page contents: a third of them repeats the home page's."""
    d = table(spark, sf, "documents")
    path = F.when(F.col("doc_id") == 0, F.lit("/")).otherwise(F.concat(F.lit("/strona-glowna/"), F.col("doc_id").cast("string")))
    mains = d.select(path.alias("path"), F.when(F.col("doc_id") % 3 == 0, F.lit("home")).otherwise(F.sha2(F.encode("text", "utf-8"), 256)).alias("main_hash"))
    live = d.where("doc_id % 9 = 0").select(F.concat(F.lit("strona-glowna/"), F.col("doc_id").cast("string")).alias("route"))
    return M.home_aliases(mains, live).select("from_path", "to_path")


def text_limits(spark: SparkSession, sf: str) -> DataFrame:
    """Whole document texts against the title and body limits: a required field drops the row."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("key"), F.col("text").alias("body"), F.regexp_extract("text", r"\A([^\n]*)", 1).alias("title"))
    return text_limit_issues(d, {"title": 300, "body": 1_000_000}, optional=["title"])[1].select("key", "code", "field")


def formatted_prices(spark: SparkSession, sf: str) -> DataFrame:
    from sitemill.functions.money import format_cents, parse_pln_cents

    cents = F.round(F.col("p_retailprice") * 100).cast("long")
    text = format_cents(cents)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), text.alias("text"), parse_pln_cents(text).alias("cents"))


QUERIES = {
    query.__name__: query
    for query in (
        settings_consensus, document_inventory, cache_reuse, media_staging, document_attachment, home_aliases, text_limits, formatted_prices, cdc_decisions, cdc_plan_counts, cdc_reconcile, missing_and_extra, unresolved_list, variant_merge, foreign_collisions, settings_changes, snapshot_changes,
        table_digests, entity_field_rejects, nested_entity_issues, entity_missing_refs, relation_issues, redirect_rule_issues, session_rule_issues, media_attach, media_inventory,
        content_refs, manifest_diff, file_states, file_set_issues, file_totals, table_statistics, metric_summary, coverage_summary,
    )
}

_CDC = f"""{with_views('v_stored', 'v_incoming')}, j AS (SELECT i.legacy_key AS key, s.legacy_key IS NULL AS fresh, s.legacy_key % 13 = 0 AS untraced, s.content <> s.imported AS edited, s.imported = i.content AS same, i.legacy_key % 6 > i.legacy_key % 5 AS below
 FROM v_incoming i LEFT JOIN v_stored s USING (legacy_key)),
a AS (SELECT key, below, CASE WHEN fresh THEN 'created' WHEN untraced THEN 'conflicts' WHEN edited AND same THEN 'preserved' WHEN edited THEN 'conflicts' WHEN same THEN 'unchanged' ELSE 'updated' END AS act FROM j),
dec AS (SELECT key, CASE WHEN act = 'updated' AND below THEN 'conflicts' ELSE act END AS action, CASE WHEN act = 'updated' AND below THEN 'capacity-below-reserved' WHEN act = 'conflicts' THEN 'manual-edit' END AS reason FROM a)"""
_FILES = "f AS (SELECT doc_id, concat('docs/', lang, '/', CAST(doc_id AS VARCHAR), '.txt') AS path, CAST(strlen(text) AS BIGINT) AS size, sha256(text) AS sha256 FROM documents)"
_LANES = " || ':' || ".join(f"CAST(sum(CAST('0x' || h[{8 * k + 1}:{8 * k + 8}] AS HUGEINT)) AS VARCHAR)" for k in range(8))
_DIGEST = lambda t, cols: f"SELECT count(*) AS rows, {_LANES} AS digest, '{t}' AS name FROM (SELECT sha256(concat_ws(chr(31), {cols})) AS h FROM {t})"

ORACLES = {
    "cdc_decisions": f"{_CDC} SELECT * FROM dec",
    "cdc_plan_counts": f"{_CDC} SELECT " + ", ".join(f"count(*) FILTER (action = '{name}') AS {name}" for name in D.ACTIONS) + " FROM dec",
    "cdc_reconcile": f"""{with_views('v_stored', 'v_incoming')}, b AS (SELECT coalesce(i.legacy_key, s.legacy_key) AS k, i.legacy_key AS e, s.legacy_key AS p FROM v_incoming i FULL JOIN v_stored s USING (legacy_key))
 SELECT concat('c', CAST(k % 3 AS VARCHAR)) AS collection, count(e) AS expected, count(*) FILTER (e IS NOT NULL AND p IS NOT NULL) AS found, count(*) FILTER (e IS NULL) AS not_in_bundle FROM b GROUP BY 1""",
    "missing_and_extra": f"""{with_views('v_stored', 'v_incoming')} SELECT legacy_key, 'missing' AS side FROM (SELECT legacy_key FROM v_incoming EXCEPT SELECT legacy_key FROM v_stored) UNION ALL SELECT legacy_key, 'extra' FROM (SELECT legacy_key FROM v_stored EXCEPT SELECT legacy_key FROM v_incoming)""",
    "unresolved_list": f"""{_CDC}, n AS (SELECT DISTINCT concat(reason, ':', CAST(key AS VARCHAR)) AS item FROM dec WHERE action = 'conflicts')
 SELECT item, row_number() OVER (ORDER BY item) AS position FROM n""",
    "variant_merge": f"""{with_views('v_variant')}, o AS (SELECT product_id AS p, product_id * 10 + pos AS row_id, CASE WHEN product_id % 2 = 0 THEN concat('k', CAST(pos AS VARCHAR)) END AS k, CASE WHEN product_id % 3 = 1 THEN concat('sku-', CAST(pos AS VARCHAR)) END AS s, concat('size ', CAST(pos AS VARCHAR)) AS l, stock FROM v_variant WHERE NOT (product_id % 7 = 0 AND pos = 1)),
 n AS (SELECT product_id AS p, pos, CASE WHEN product_id % 4 = 0 THEN concat('k', CAST(pos AS VARCHAR)) END AS k, CASE WHEN product_id % 3 = 1 THEN concat('sku-', CAST(pos AS VARCHAR)) END AS s, CASE WHEN product_id % 11 = 0 THEN 'size 0' ELSE concat('size ', CAST(pos AS VARCHAR)) END AS l FROM v_variant WHERE NOT (product_id % 5 = 0 AND pos = 2)),
 m AS (SELECT n.p, n.pos, o.row_id, o.stock FROM n JOIN o ON o.p = n.p AND CASE WHEN n.k IS NOT NULL AND o.k IS NOT NULL THEN n.k = o.k WHEN n.s IS NOT NULL AND o.s IS NOT NULL THEN n.s = o.s ELSE n.l = o.l END),
 pn AS (SELECT p, pos, count(*) c, min(row_id) AS row_id, min(stock) AS stock FROM m GROUP BY ALL), po AS (SELECT p, row_id, count(*) c FROM m GROUP BY ALL),
 t AS (SELECT p, (SELECT count(*) FROM o WHERE o.p = x.p) AS no, (SELECT count(*) FROM n WHERE n.p = x.p) AS nn, (SELECT max(c) FROM pn WHERE pn.p = x.p) AS mn, (SELECT max(c) FROM po WHERE po.p = x.p) AS mo, (SELECT count(*) FROM po WHERE po.p = x.p) AS ro FROM (SELECT DISTINCT p FROM n) x)
 SELECT n.p AS product_id, n.pos, pn.row_id, CASE WHEN pn.c IS NOT NULL THEN CAST(pn.stock AS BIGINT) ELSE 9 END AS stock, ((no > 0) <> (nn > 0)) OR coalesce(mn, 0) > 1 OR coalesce(mo, 0) > 1 OR coalesce(ro, 0) <> no AS conflict FROM n LEFT JOIN pn ON pn.p = n.p AND pn.pos = n.pos JOIN t ON t.p = n.p""",
    "foreign_collisions": f"""{with_views('v_stored', 'v_incoming')} SELECT concat('/n-', CAST(s.legacy_key AS VARCHAR)) AS claim, i.legacy_key AS wanted_by, CASE WHEN s.legacy_key % 17 > 0 THEN s.legacy_key END AS held_by
 FROM v_stored s JOIN v_incoming i ON i.legacy_key % 700 = s.legacy_key WHERE (CASE WHEN s.legacy_key % 17 > 0 THEN s.legacy_key END) IS DISTINCT FROM i.legacy_key""",
    "settings_changes": "SELECT n_name AS name, CASE n_nationkey % 3 WHEN 0 THEN 'fill' WHEN 1 THEN 'keep' ELSE 'conflict' END AS change FROM nation",
    "snapshot_changes": "SELECT o_orderkey, 'o_totalprice' AS field FROM orders WHERE o_orderkey % 10 = 0 UNION ALL SELECT o_orderkey, 'o_orderstatus' FROM orders WHERE o_orderkey % 15 = 0",
    "table_digests": _DIGEST("orders", "o_orderkey, o_custkey, o_orderstatus") + " UNION ALL " + _DIGEST("customer", "c_custkey, c_name"),
    "entity_field_rejects": """SELECT p_partkey AS key, 'name' AS field, 'required' AS code FROM part WHERE p_partkey % 19 = 0 UNION ALL SELECT p_partkey, 'slug', 'invalid-slug' FROM part WHERE p_partkey % 8 = 0
 UNION ALL SELECT p_partkey, 'price', 'invalid-money' FROM part WHERE p_partkey % 9 = 0 UNION ALL SELECT p_partkey, 'stock', 'invalid-stock' FROM part WHERE p_partkey % 7 = 0
 UNION ALL SELECT p_partkey, 'legacy_path', 'invalid-path' FROM part WHERE p_partkey % 6 = 0 UNION ALL SELECT p_partkey, 'org', 'invalid-select' FROM part WHERE p_partkey % 4 = 1
 UNION ALL SELECT p_partkey, 'next_date', 'invalid-date' FROM part WHERE p_partkey % 3 = 0""",
    "nested_entity_issues": """WITH p AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 41 > 0), v AS (SELECT k, unnest(range(1, k % 4 + 2)) AS n FROM p WHERE k % 4 < 3)
 SELECT p_partkey AS key, CAST(NULL AS VARCHAR) AS field, 'invalid-json' AS code FROM part WHERE p_partkey % 41 = 0 UNION ALL SELECT k, 'name', 'required' FROM p WHERE k % 5 = 0
 UNION ALL SELECT k, 'seo.title', 'invalid-text' FROM p WHERE k % 17 = 0 AND k % 6 > 0 UNION ALL SELECT k, 'seo.keywords', 'unsupported-field' FROM p WHERE k % 19 = 0 AND k % 6 > 0
 UNION ALL SELECT k, 'seo.image', 'media-missing' FROM p WHERE k % 40 >= 30 AND k % 6 > 0 UNION ALL SELECT k, 'features', 'invalid-rows' FROM p WHERE k % 23 = 0
 UNION ALL SELECT k, 'id', 'unsupported-field' FROM p WHERE k % 29 = 0 UNION ALL SELECT k, 'featured', 'invalid-bool' FROM p WHERE k % 31 = 0 UNION ALL SELECT k, 'variants', 'invalid-rows' FROM p WHERE k % 4 = 3
 UNION ALL SELECT k, concat('variants[', n - 1, '].label'), 'required' FROM v WHERE (k + n) % 11 = 0 UNION ALL SELECT k, concat('variants[', n - 1, '].stock'), 'invalid-stock' FROM v WHERE (k + n) % 7 = 0
 UNION ALL SELECT k, concat('variants[', n - 1, '].image'), 'invalid-media' FROM v WHERE n = 2 AND k % 2 = 0 UNION ALL SELECT k, 'variants[0].image', 'media-missing' FROM p WHERE k % 37 >= 30
 UNION ALL SELECT k, concat('variants[', n - 1, '].id'), 'unsupported-field' FROM v WHERE (k + n) % 13 = 0""",
    "entity_missing_refs": f"{with_views('v_order_item')} SELECT order_id AS src_id, pos, product_id AS dst_id FROM v_order_item WHERE product_id NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 23 <> 0)",
    "relation_issues": f"""{with_views('v_order_item')}, e AS (SELECT order_id AS src_id, pos, CASE pos WHEN 7 THEN 'category' WHEN 6 THEN 'unknown' ELSE 'images' END AS field, concat(CASE pos WHEN 5 THEN 'courses:' WHEN 7 THEN 'categories:' ELSE 'media:' END, CAST(product_id % 30 AS VARCHAR)) AS d FROM v_order_item),
 g AS (SELECT src_id, field, count(*) n, count(DISTINCT d) u FROM e WHERE field <> 'unknown' GROUP BY ALL)
 SELECT DISTINCT src_id, field, CASE WHEN field = 'unknown' THEN 'unsupported-relation' ELSE 'wrong-target' END AS code FROM e WHERE field = 'unknown' OR pos = 5
 UNION ALL SELECT src_id, field, CASE WHEN n > 1 AND field = 'category' THEN 'single-reference-expected' WHEN u < n THEN 'duplicate-reference' WHEN n > 500 THEN 'too-many-references' END AS code FROM g WHERE (n > 1 AND field = 'category') OR u < n OR n > 500""",
    "redirect_rule_issues": f"""{with_views('v_redirect')}, w AS (SELECT src, dst AS spot, [src, dst] AS seen, src = dst AS cyc FROM v_redirect UNION ALL SELECT w.src, e.dst, list_append(seen, e.dst), list_contains(seen, e.dst) FROM w JOIN v_redirect e ON e.src = w.spot WHERE NOT cyc),
 c AS (SELECT DISTINCT src FROM w WHERE cyc)
 SELECT id, 'redirect-over-content' AS code FROM v_redirect WHERE id IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT id, 'redirect-chain-does-not-end' FROM v_redirect JOIN c USING (src)""",
    "session_rule_issues": f"""{with_views('v_schedule')}, s AS (SELECT * FROM v_schedule WHERE kind = 'course') SELECT id AS key, 'capacity' AS field, 'capacity-below-one' AS code FROM s WHERE capacity < 1
 UNION ALL SELECT id, 'reserved', 'reserved-out-of-range' FROM s WHERE reserved > capacity UNION ALL SELECT id, 'ends_at', 'end-before-start' FROM s WHERE id % 9 = 0""",
    "media_attach": f"""{with_views('v_media_target')} SELECT entity_id, media_key, min(pos) AS pos FROM v_media_target WHERE media_key IN (SELECT concat('m-', CAST(p_partkey AS VARCHAR)) FROM part WHERE p_partkey % 6 <> 0) GROUP BY ALL""",
    "media_inventory": f"""{with_views('v_media_target')}, r AS (SELECT concat('img/', media_key, '.jpg') AS path, concat('https://shop.example.com/img/', media_key, CASE WHEN pos % 3 = 0 THEN '%2Ejpg' ELSE '.jpg' END) AS url, CASE WHEN pos % 2 = 0 THEN concat('alt ', CAST(entity_id % 10 AS VARCHAR)) ELSE '' END AS alt, entity_id * 10 + pos AS pos FROM v_media_target)
 SELECT path, arg_min(url, pos) AS url, coalesce(arg_min(alt, pos) FILTER (alt <> ''), '') AS alt, count(*) AS uses, count(DISTINCT url) - 1 AS other_spellings FROM r GROUP BY path""",
    "content_refs": f"""{with_views('v_media_target')}, r AS (SELECT entity_id * 10 + pos AS n, CAST(substring(media_key, 3) AS INTEGER) AS m, media_key FROM v_media_target),
 o AS (SELECT n AS ref_id, CASE WHEN n % 11 = 0 THEN 'external' WHEN n % 13 = 0 THEN 'unsafe' WHEN m % 4 = 0 THEN 'unmapped' WHEN m % 5 = 0 THEN 'not-downloaded' ELSE 'mapped' END AS outcome, media_key FROM r)
 SELECT ref_id, outcome, CASE WHEN outcome = 'mapped' THEN media_key END AS media_key FROM o""",
    "manifest_diff": f"""WITH {_FILES} SELECT path, CASE WHEN doc_id % 10 = 4 THEN 'missing-member' WHEN doc_id % 10 = 3 THEN 'unlisted-member' WHEN doc_id % 10 = 5 THEN 'size-differs' WHEN doc_id % 10 = 7 THEN 'digest-differs' ELSE 'ok' END AS verdict FROM f""",
    "file_states": f"""WITH {_FILES} SELECT path, CASE doc_id % 10 WHEN 0 THEN 'done' WHEN 1 THEN 'superseded' WHEN 2 THEN 'unrecorded' WHEN 3 THEN 'corrupt' WHEN 4 THEN 'done' WHEN 5 THEN 'done' WHEN 6 THEN 'failed' WHEN 7 THEN 'unrecorded' WHEN 8 THEN 'pending' ELSE 'unrecorded' END AS state FROM f""",
    "file_set_issues": """WITH f AS (SELECT concat('d/', CASE WHEN doc_id % 9 = 0 THEN '.env.local' WHEN doc_id % 7 = 0 THEN concat('File-', CAST(doc_id % 50 AS VARCHAR)) ELSE concat('file-', CAST(doc_id AS VARCHAR)) END) AS path FROM documents),
 c AS (SELECT lower(path) AS l FROM f GROUP BY 1 HAVING min(path) <> max(path))
 SELECT path, 'unsafe-path' AS code FROM f WHERE path = 'd/.env.local' UNION ALL SELECT path, 'name-collision' FROM f WHERE lower(path) IN (SELECT l FROM c) UNION ALL SELECT NULL, 'too-many-files' FROM (SELECT count(*) n FROM f) WHERE n > 100""",
    "file_totals": f"WITH {_FILES} SELECT count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM f",
    "table_statistics": " UNION ALL ".join(f"SELECT '{name}' AS \"table\", count(*) AS rows FROM {name}" for name in ("orders", "lineitem", "part", "customer", "pages")),
    "metric_summary": "SELECT event_type AS route, median(value) AS median, max(value) AS maximum, count(*) FILTER (value < 25) AS under, count(*) AS samples FROM events GROUP BY 1",
    "coverage_summary": """WITH c AS (SELECT event_type AS kind, CASE WHEN event_id % 10 = 0 THEN 'skipped' WHEN event_id % 7 = 0 THEN 'failed' ELSE 'passed' END AS o FROM events)
 SELECT kind, count(*) FILTER (o <> 'skipped') AS checked, count(*) FILTER (o = 'passed') AS passed, count(*) FILTER (o = 'failed') AS failed, count(*) FILTER (o = 'skipped') AS skipped FROM c GROUP BY 1""",
    "settings_consensus": """WITH o AS (SELECT concat('s-', CAST(o_custkey % 500 AS VARCHAR)) AS name, CASE WHEN o_custkey % 500 < 250 THEN 'same' ELSE o_orderstatus END AS value FROM orders)
 SELECT name, CASE WHEN min(value) = max(value) THEN min(value) END AS value, min(value) <> max(value) AS conflict, count(*) AS captures FROM o GROUP BY name""",
    "document_inventory": """WITH l AS (SELECT doc_id - doc_id % 7 AS k, count(*) AS links FROM documents WHERE doc_id % 3 <> 0 GROUP BY 1)
 SELECT concat('/docs/', CAST(k AS VARCHAR), '.PDF') AS path, links, sha256(d.text) AS sha256, d.n_chars AS size, CASE WHEN d.doc_id IS NULL THEN 'missing' ELSE 'ready' END AS status FROM l LEFT JOIN (SELECT * FROM documents WHERE doc_id % 7 = 0 AND doc_id % 4 <> 0) d ON d.doc_id = l.k""",
    "cache_reuse": """SELECT concat('m-', CAST(p_partkey AS VARCHAR)) AS media_key, CASE WHEN p_partkey % 2 = 0 AND (p_partkey % 6 <> 0 OR p_partkey % 5 = 0) THEN 'cache' WHEN p_partkey % 3 = 0 THEN 'archive' ELSE 'fetch' END AS source FROM part""",
    "media_staging": """WITH w AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 10 = 0 THEN p_partkey + 1 ELSE p_partkey END AS p FROM part), c AS (SELECT p, count(*) n FROM w GROUP BY p)
 SELECT concat('m-', CAST(k AS VARCHAR)) AS media_key, CASE WHEN n > 1 THEN 'path-conflict' WHEN k % 3 = 0 THEN 'reuse' WHEN k % 4 = 0 THEN 'known-failure' ELSE 'missing' END AS state FROM w JOIN c USING (p)""",
    "document_attachment": f"WITH {_FILES} SELECT path AS key, CASE WHEN doc_id % 6 = 0 THEN 'rejected' ELSE 'ready' END AS status FROM f",
    "home_aliases": "SELECT concat('/strona-glowna/', CAST(doc_id AS VARCHAR)) AS from_path, '/' AS to_path FROM documents WHERE doc_id % 3 = 0 AND doc_id % 9 <> 0",
    "text_limits": r"""WITH d AS (SELECT doc_id, text, regexp_extract(text, '\A([^\n]*)', 1) AS t FROM documents)
 SELECT doc_id AS key, 'field-omitted' AS code, 'title' AS field FROM d WHERE length(t) + len(regexp_extract_all(t, '[\x{10000}-\x{10FFFF}]')) > 300 OR regexp_matches(t, '[\x00-\x1f\x7f-\x{9f}]')
 UNION ALL SELECT doc_id, 'field-invalid', 'body' FROM d WHERE length(text) > 1000000 OR regexp_matches(text, '[\x00-\x1f\x7f-\x{9f}]')""",
    "formatted_prices": """WITH c AS (SELECT p_partkey AS id, CAST(round(p_retailprice * 100) AS BIGINT) AS cents FROM part) SELECT id, concat(CAST(cents // 100 AS VARCHAR), ',', lpad(CAST(cents % 100 AS VARCHAR), 2, '0'), ' zł') AS text, cents FROM c""",
}
