"""Products: prices, stock, search, lists and listing pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sitemill.functions import money as M
from sitemill.functions.documents import product_json
from sitemill.functions.paths import route_key
from sitemill.operators import catalog as C
from sitemill.operators.media import ordered_lists
from sitemill.sources.adapters import table, view, with_views


def product_prices(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "v_product").withColumn("p", M.product_price(F.col("price_cents"), F.col("sale_price_cents")))
    return rows.select("id", "p.base", "p.sale", "p.current", M.stock_state(F.col("stock")).alias("state"))


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    variants = view(spark, sf, "v_variant").withColumn("stock", F.col("stock").cast("long"))
    return C.product_facts(view(spark, sf, "v_product"), variants)


def _totals(spark: SparkSession, sf: str) -> DataFrame:
    return C.variant_totals(view(spark, sf, "v_product"), view(spark, sf, "v_variant").withColumn("stock", F.col("stock").cast("long")))


def product_price_span(spark: SparkSession, sf: str) -> DataFrame:
    return _totals(spark, sf).select("id", "low", "high")


def product_stock_state(spark: SparkSession, sf: str) -> DataFrame:
    return _totals(spark, sf).select("id", "known", "stored", M.stock_state(F.col("known")).alias("state"))


def product_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Structured data per published product; the text is checked in tests, here its offers are counted."""
    rows = C.published(_facts(spark, sf))
    url = F.concat(F.lit("https://shop.example.com/p-"), F.col("id").cast("string"), F.lit(".html"))
    doc = product_json(F.col("name"), url, F.col("price_cents"), F.col("sale_price_cents"), F.col("stock"), F.col("variants"), F.lit(""), F.col("sku"), F.col("manufacturer"))
    return rows.select("id", doc.alias("doc")).select("id", F.regexp_count("doc", F.lit('"@type":"Offer"')).alias("offers"), F.regexp_count("doc", F.lit("InStock")).alias("in_stock"), F.get_json_object("doc", "$.sku").alias("sku"))


_QUERY = "  RED   Widget "


def catalog_search(spark: SparkSession, sf: str) -> DataFrame:
    return C.search(view(spark, sf, "v_product"), _QUERY).select("id", "name")


def catalog_page(spark: SparkSession, sf: str) -> DataFrame:
    return C.scan_page(view(spark, sf, "v_product"), [F.col("name"), F.col("id")], page=3).select("id", "name")


def catalog_totals(spark: SparkSession, sf: str) -> DataFrame:
    return C.page_totals(view(spark, sf, "v_product"))


def featured_or_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return C.featured_or_fallback(view(spark, sf, "v_product")).select("id", "name", "featured")


def related_products(spark: SparkSession, sf: str) -> DataFrame:
    products = C.published(view(spark, sf, "v_product")).select("id", "name", "category_id")
    primary = products.select(F.col("id").alias("product_id"), "category_id")
    secondary = products.where("id % 3 = 0").select(F.col("id").alias("product_id"), (100 + (F.col("id") * 7) % 25).alias("category_id"))
    return C.related_products(products, primary.unionByName(secondary))


def scan_by_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Products asked for by order lines of the first line number."""
    keys = view(spark, sf, "v_order_item").where("pos = 1").select(F.col("product_id").alias("id"))
    return C.scan_by_keys(view(spark, sf, "v_product"), keys, "id").select("id", "name")


# ------------------------------------------------------------------ listing pages

def _cards(spark: SparkSession, sf: str) -> DataFrame:
    """An order is a listing page, its lines are the cards; addresses come in four spellings."""
    items = view(spark, sf, "v_order_item")
    number = F.col("product_id").cast("string")
    path = (
        F.when(F.col("pos") % 4 == 0, F.concat(F.lit("/p-"), number, F.lit(".html")))
        .when(F.col("pos") % 4 == 1, F.concat(F.lit("/x-"), number, F.lit(".html")))
        .when(F.col("pos") % 4 == 2, F.concat(F.lit("/y-"), number))
        .otherwise(F.concat(F.lit("/p-"), number, F.lit("/")))
    )
    return items.select(F.col("order_id").alias("listing_id"), "pos", route_key(path).alias("route"))


def listing_members(spark: SparkSession, sf: str) -> DataFrame:
    products = C.published(view(spark, sf, "v_product"))
    named = lambda prefix, df: df.select(F.concat(F.lit(prefix), F.col("id").cast("string")).alias("route"), F.col("id").alias("product_id"))
    routes = C.product_routes(named("p-", products), named("x-", products.where("id % 3 = 0")), named("y-", products.where("id % 5 <> 0")))
    return C.listing_members(_cards(spark, sf), routes)


def listing_category_prefix(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    listings = table(spark, sf, "part").select(
        key.alias("id"), F.concat_ws("/", F.concat(F.lit("c-"), (key % 30).cast("string")), F.concat(F.lit("s-"), (key % 7).cast("string")), F.concat(F.lit("l-"), key.cast("string"))).alias("stem"),
        F.when(key % 4 == 0, key % 30).when(key % 4 == 1, 100 + key % 30).when(key % 4 == 2, F.lit(7)).cast("long").alias("shown_id"),
    )
    nation = table(spark, sf, "nation")
    top = nation.select(F.concat(F.lit("c-"), F.col("n_nationkey").cast("string")).alias("slug"), F.col("n_nationkey").cast("long").alias("vm_id"))
    sub = nation.select(
        F.concat(F.lit("c-"), F.col("n_nationkey").cast("string"), F.lit("/s-"), F.col("n_regionkey").cast("string")).alias("slug"),
        F.when(F.col("n_nationkey") % 3 > 0, F.col("n_nationkey") + 100).cast("long").alias("vm_id"),
    )
    return C.longest_prefix(listings, top.unionByName(sub))


def listing_links(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    name = lambda n: F.concat(F.lit("list-"), n.cast("string"))
    part = table(spark, sf, "part")
    listings = part.select(name(key).alias("route"), (key % 9).alias("category"), F.when(key % 4 > 0, key % 4).alias("maker"))
    links = part.select(name(key).alias("route"), name(key + 36).alias("target"), F.lit("next").alias("label")).unionByName(
        part.select(name(key).alias("route"), name(key + 5).alias("target"), F.lit("other").alias("label"))
    )
    return C.pagination_links(links, listings)


def listing_views(spark: SparkSession, sf: str) -> DataFrame:
    """Shown members, hidden count and range text per listing page, for pages of any length."""
    items = view(spark, sf, "v_order_item")
    members = items.groupBy(F.col("order_id").alias("entity_id"), F.col("product_id").alias("media_key")).agg(F.min("pos").alias("pos"))
    lists, _ = ordered_lists(members)
    cards = items.groupBy(F.col("order_id").alias("entity_id")).agg(F.count("*").alias("n"))
    rows = lists.join(cards, "entity_id").select(
        F.col("entity_id").alias("id"), F.col("media").alias("members"), F.filter("media", lambda m: m % 11 != 0).alias("found"),
        F.lit(1).alias("first"), F.col("n").cast("int").alias("last"), (F.col("n") + F.col("entity_id") % 3).cast("int").alias("total"),
        F.concat(F.lit("/o-"), F.col("entity_id").cast("string")).alias("own_path"),
        F.array(F.struct(F.lit("next").alias("label"), F.concat(F.lit("o-"), (F.col("entity_id") + F.col("entity_id") % 2).cast("string")).alias("path"))).alias("links"),
    )
    return C.listing_view(rows).select("id", F.size("products").alias("shown"), "hidden", "range", F.size("links").alias("links"))


def populated_products(spark: SparkSession, sf: str) -> DataFrame:
    """Products with their category and the category's parent (relation depth two)."""
    categories = view(spark, sf, "v_category")
    inner = C.populate(categories, "parent_id", categories, as_name="parent")
    rows = C.populate(view(spark, sf, "v_product").select("id", "category_id"), "category_id", inner, as_name="category")
    return rows.select("id", F.col("category.name").alias("category_name"), F.col("category.parent.name").alias("parent_name"))


QUERIES = {
    query.__name__: query
    for query in (
        product_prices, product_price_span, product_stock_state, product_documents, catalog_search, catalog_page, catalog_totals, featured_or_fallback,
        related_products, scan_by_keys, listing_members, listing_category_prefix, listing_links, listing_views, populated_products,
    )
}

_P = with_views("v_product")
_PV = with_views("v_product", "v_variant")
_CUR = "CASE WHEN sale_price_cents > 0 AND sale_price_cents < price_cents THEN sale_price_cents ELSE nullif(price_cents, 0) END"

ORACLES = {
    "product_prices": f"""{_P} SELECT id, price_cents AS base, CASE WHEN sale_price_cents > 0 AND sale_price_cents < price_cents THEN sale_price_cents END AS sale, {_CUR} AS current,
 CASE WHEN stock IS NULL THEN 'unknown' WHEN stock > 0 THEN 'in' ELSE 'out' END AS state FROM v_product""",
    "product_price_span": f"""{_PV}, c AS (SELECT p.id, CASE WHEN v.price_cents >= 0 THEN nullif(v.price_cents, 0) ELSE {_CUR.replace('price_cents', 'p.price_cents').replace('sale_p.price_cents', 'p.sale_price_cents')} END AS cur FROM v_product p LEFT JOIN v_variant v ON v.product_id = p.id)
 SELECT id, min(cur) AS low, max(cur) AS high FROM c GROUP BY id""",
    "product_stock_state": f"""{_PV}, g AS (SELECT product_id, count(*) n, count(stock) k, sum(stock) s FROM v_variant GROUP BY 1),
 f AS (SELECT p.id, CASE WHEN g.n IS NULL THEN p.stock WHEN k = 0 OR (s = 0 AND k < n) THEN NULL ELSE CAST(s AS BIGINT) END AS known, CASE WHEN g.n IS NULL THEN p.stock WHEN k < n THEN NULL ELSE CAST(s AS BIGINT) END AS stored FROM v_product p LEFT JOIN g ON g.product_id = p.id)
 SELECT *, CASE WHEN known IS NULL THEN 'unknown' WHEN known > 0 THEN 'in' ELSE 'out' END AS state FROM f""",
    "product_documents": f"""{_PV}, g AS (SELECT product_id, count(*) n, count(*) FILTER (stock > 0) AS i FROM v_variant GROUP BY 1)
 SELECT p.id, CAST(coalesce(g.n, 1) AS INTEGER) AS offers, CAST(CASE WHEN g.n IS NULL THEN CASE WHEN p.stock > 0 THEN 1 ELSE 0 END ELSE g.i END AS INTEGER) AS in_stock, p.sku FROM v_product p LEFT JOIN g ON g.product_id = p.id WHERE p.published""",
    "catalog_search": f"{_P} SELECT id, name FROM v_product WHERE published AND contains(lower(concat_ws(' ', name, manufacturer, sku)), 'red widget')",
    "catalog_page": f"{_P} SELECT id, name FROM v_product WHERE published ORDER BY name, id LIMIT 24 OFFSET 48",
    "catalog_totals": f"{_P} SELECT count(*) AS total_docs, CAST(ceil(count(*) / 24.0) AS BIGINT) AS total_pages FROM v_product WHERE published",
    "featured_or_fallback": f"{_P} SELECT id, name, featured FROM v_product WHERE published AND featured ORDER BY name, id LIMIT 4",
    "related_products": f"""{_P}, pub AS (SELECT * FROM v_product WHERE published), m AS (SELECT id, category_id FROM pub UNION SELECT id, 100 + (id * 7) % 25 FROM pub WHERE id % 3 = 0),
 r AS (SELECT a.id, b.id AS related_id, row_number() OVER (PARTITION BY a.id ORDER BY b.name, b.id) AS position FROM pub a JOIN m ON m.category_id = a.category_id JOIN pub b ON b.id = m.id WHERE b.id <> a.id)
 SELECT id, CAST(position AS INTEGER) AS position, related_id FROM r WHERE position <= 4""",
    "scan_by_keys": f"{_P} SELECT id, name FROM v_product WHERE id IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 1)",
    "listing_members": f"""{with_views('v_product', 'v_order_item')}, pub AS (SELECT id FROM v_product WHERE published),
 c AS (SELECT order_id, pos, product_id AS k, CASE pos % 4 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS kind FROM v_order_item),
 j AS (SELECT order_id, pos, CASE WHEN k IN (SELECT id FROM pub) AND (kind = 0 OR (kind = 1 AND k % 3 = 0) OR (kind = 2 AND k % 5 <> 0)) THEN k END AS product_id, kind FROM c)
 SELECT order_id AS listing_id, product_id, min(pos) AS pos, count(*) AS copies, arg_min(kind, pos) AS prio FROM j WHERE product_id IS NOT NULL GROUP BY order_id, product_id
 UNION ALL SELECT order_id, NULL, pos, count(*), NULL FROM j WHERE product_id IS NULL GROUP BY order_id, pos""",
    "listing_category_prefix": """WITH l AS (SELECT p_partkey AS id, p_partkey % 30 AS c, p_partkey % 7 AS s, CASE p_partkey % 4 WHEN 0 THEN p_partkey % 30 WHEN 1 THEN 100 + p_partkey % 30 WHEN 2 THEN 7 END AS shown FROM part),
 j AS (SELECT l.*, n.n_nationkey AS nk, n.n_regionkey = l.s AS deep FROM l JOIN nation n ON n.n_nationkey = l.c),
 f AS (SELECT id, shown, CASE WHEN deep THEN concat('c-', CAST(c AS VARCHAR), '/s-', CAST(s AS VARCHAR)) ELSE concat('c-', CAST(c AS VARCHAR)) END AS category_slug, CASE WHEN deep THEN CASE WHEN nk % 3 > 0 THEN nk + 100 END ELSE nk END AS vm FROM j)
 SELECT id, category_slug, CASE WHEN vm = shown THEN 'linked' WHEN vm IS NULL OR shown IS NULL THEN 'listing-category-unverified' ELSE 'listing-category-mismatch' END AS verdict FROM f""",
    "listing_links": """WITH l AS (SELECT p_partkey AS k, p_partkey % 9 AS c, CASE WHEN p_partkey % 4 > 0 THEN p_partkey % 4 END AS m FROM part),
 e AS (SELECT p_partkey AS a, p_partkey + 36 AS b, 'next' AS label FROM part UNION ALL SELECT p_partkey, p_partkey + 5, 'other' FROM part)
 SELECT concat('list-', CAST(a AS VARCHAR)) AS route, concat('list-', CAST(b AS VARCHAR)) AS target, label, CASE WHEN x.m IS NOT NULL AND x.c = y.c AND x.m = y.m THEN 'linked' ELSE 'listing-link-other-filter' END AS verdict
 FROM e JOIN l x ON x.k = e.a JOIN l y ON y.k = e.b""",
    "listing_views": """WITH i AS (SELECT l_orderkey AS id, l_partkey AS p FROM lineitem), g AS (SELECT id, count(*) n, count(DISTINCT p) d, count(DISTINCT p) FILTER (p % 11 <> 0) AS shown FROM i GROUP BY id)
 SELECT id, CAST(shown AS INTEGER) AS shown, CAST(d - shown AS INTEGER) AS hidden, CASE WHEN id % 3 > 0 THEN concat('Wyniki 1–', CAST(n AS VARCHAR), ' z ', CAST(n + id % 3 AS VARCHAR)) END AS range, CAST(id % 2 AS INTEGER) AS links FROM g""",
    "populated_products": f"{with_views('v_product', 'v_category')} SELECT p.id, c.name AS category_name, q.name AS parent_name FROM v_product p LEFT JOIN v_category c ON c.id = p.category_id LEFT JOIN v_category q ON q.id = c.parent_id",
}
