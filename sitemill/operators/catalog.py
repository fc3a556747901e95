"""Catalogue queries: guards, search, paging, top lists, related products, price and stock."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from sitemill import constants as K
from sitemill.functions import money as M, paths as P
from sitemill.functions.text import catalog_search_text
from sitemill.operators.graph import tree_labels, tree_subtree, within_ranges
from sitemill.operators.ordered import top_k
from sitemill.session import scratch_folder


def published(df: DataFrame) -> DataFrame:
    """Null and false are hidden on every public read."""
    return df.where(F.col("published") == F.lit(True))


#: Up to this many rows a page is taken from the heads of the tasks' sorted rows; a deeper one from the ranges that hold it.
HEAD_ROWS = 10_000


@dataclass(frozen=True)
class SortedRows:
    """Rows laid out once in ranges of an order, from which any page is read."""

    folder: str
    schema: StructType
    counts: tuple[tuple[int, int], ...]
    order: tuple[Column, ...]

    def rows(self, spark: SparkSession, first: int, many: int) -> DataFrame:
        """many rows from place first (from 0) on, in order; only the ranges that hold them are read."""
        chunks, before, skipped = [], 0, None
        for chunk, held in self.counts:
            if before < first + many and before + held > first:
                chunks.append(chunk)
                skipped = before if skipped is None else skipped
            before += held
        held = spark.read.schema(self.schema).parquet(self.folder).where(F.col("chunk").isin(chunks)).drop("chunk")
        return held.orderBy(*self.order).offset(first - (skipped or 0)).limit(many)


def sorted_rows(df: DataFrame, order: Sequence[Column]) -> SortedRows:
    """Lays out the published rows in ranges by a total order, a file or more each, below the checkpoint folder; the driver gets one
    count a range."""
    folder = scratch_folder(df.sparkSession, "sorted")
    rows = published(df)
    dealt = rows.repartitionByRange(*order).withColumn("chunk", F.spark_partition_id())
    dealt.write.partitionBy("chunk").parquet(folder)
    kind = StructType([*rows.schema.fields, StructField("chunk", IntegerType())])
    counts = df.sparkSession.read.schema(kind).parquet(folder).groupBy("chunk").count().collect()
    return SortedRows(folder, kind, tuple(sorted((row["chunk"], row["count"]) for row in counts)), tuple(order))


def scan_page(df: DataFrame, order: Sequence[Column], page: int = 1, size: int = K.PAGE_SIZE) -> DataFrame:
    """One page of published rows in a total order. A deep page reads the ranges of the order that hold it (see SortedRows, which
    keeps the ranges for further pages); both ways give the same rows."""
    if size < 1 or page < 1:
        raise ValueError("page and size start at 1")
    if page * size > HEAD_ROWS:
        return sorted_rows(df, order).rows(df.sparkSession, (page - 1) * size, size)
    return published(df).orderBy(*order).offset((page - 1) * size).limit(size)


def page_totals(df: DataFrame, size: int = K.PAGE_SIZE) -> DataFrame:
    return published(df).agg(F.count("*").alias("total_docs")).withColumn("total_pages", F.ceil(F.col("total_docs") / size))


def scan_by_keys(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows whose key is asked for; Spark chooses the join, no key list is built in the driver."""
    return df.join(keys.select(column).distinct(), column, "left_semi")


def redact(df: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Only the listed columns leave."""
    return df.select(*[name for name in allowed if name in df.columns])


def search(df: DataFrame, query: str) -> DataFrame:
    """Rows whose folded search text holds the folded query; a short query does not filter."""
    q = P.search_query(F.lit(query))
    text = catalog_search_text(F.col("name"), F.col("manufacturer"), F.col("sku"))
    return published(df).where((q == "") | text.contains(catalog_search_text(q)))


def featured_or_fallback(df: DataFrame, k: int = 4) -> DataFrame:
    """Featured rows when there are any, else the first k by name. k rows of each kind suffice."""
    order = [F.col("name"), F.col("id")]
    featured = published(df).where("featured").orderBy(*order).limit(k).withColumn("prio", F.lit(0))
    plain = published(df).orderBy(*order).limit(k).withColumn("prio", F.lit(1))
    both = featured.unionByName(plain)
    best = both.agg(F.min("prio").alias("prio"))
    return both.join(best, "prio", "left_semi").drop("prio")


def top_list(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return published(df).orderBy(*order).limit(k)


def related_products(products: DataFrame, memberships: DataFrame, k: int = 4) -> DataFrame:
    """products(id, name, category_id), memberships(product_id, category_id) -> (id, position, related_id).

    The first k others of a category are among its first k + 1 members, so each category keeps
    k + 1 rows and no pairs of a category are ever formed."""
    members = memberships.join(products.select(F.col("id").alias("product_id"), "name"), "product_id").select("category_id", "product_id", "name").distinct()
    best = top_k(members, ["category_id"], [F.col("name"), F.col("product_id")], k + 1)
    lists = best.groupBy("category_id").agg(F.sort_array(F.collect_list(F.struct("name", F.col("product_id").alias("id")))).alias("best"))
    others = F.slice(F.filter("best", lambda item: item["id"] != F.col("own_id")), 1, k)
    joined = products.select(F.col("id").alias("own_id"), "category_id").join(lists, "category_id")
    return joined.select(F.col("own_id").alias("id"), F.posexplode(others).alias("pos", "item")).select(
        "id", (F.col("pos") + 1).alias("position"), F.col("item.id").alias("related_id")
    )


def subtree_products(categories: DataFrame, memberships: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(category_id, product_id) for every product in or below a category, once even with several matches; of the asked(id)
    categories only, if given. Products take their category's place in the walk of the tree and meet the ranges of categories."""
    labels = tree_labels(categories)
    wanted = labels if asked is None else labels.join(asked.select("id").distinct(), "id", "left_semi")
    placed = memberships.join(labels.where("enter is not null").select(F.col("id").alias("category_id"), "root", F.col("enter").alias("at")), "category_id").select("root", "at", "product_id").distinct()
    pairs = within_ranges(placed, wanted.where("enter is not null").select("root", F.col("enter").alias("low"), F.col("leave").alias("high"), F.col("id").alias("category_id"))).select("category_id", "product_id").distinct()
    odd = labels.where("enter is null").select("id")
    if odd.isEmpty():
        return pairs
    around = tree_subtree(categories.join(odd, "id", "left_semi")).join(wanted.select("id"), "id", "left_semi")
    return pairs.unionByName(memberships.join(around.withColumnRenamed("id", "root").withColumnRenamed("member", "category_id"), "category_id").select(F.col("root").alias("category_id"), "product_id").distinct())


_VARIANTS = "array<struct<pos:int,variant_id:string,label:string,stock:bigint,price_cents:bigint>>"
MAX_VARIANTS = 500


def product_facts(products: DataFrame, variants: DataFrame) -> DataFrame:
    """Products with their variants nested in position order.

    All variants are kept, as a product with many has offers like any other; too_many_variants marks those
    beyond the 500 that the source allows."""
    nested = variants.groupBy("product_id").agg(F.sort_array(F.collect_list(F.struct("pos", "variant_id", "label", "stock", "price_cents"))).alias("variants"))
    joined = products.join(nested.withColumnRenamed("product_id", "id"), "id", "left")
    listed = F.coalesce(F.col("variants").cast(_VARIANTS), F.array().cast(_VARIANTS))
    return joined.withColumn("variants", listed).withColumn("too_many_variants", F.size("variants") > MAX_VARIANTS)


def variant_totals(products: DataFrame, variants: DataFrame) -> DataFrame:
    """Price span and stock per product by plain aggregation, for any number of variants: (id, low, high,
    known, stored)."""
    base = products.select("id", "price_cents", "sale_price_cents", "stock")
    prices = variants.groupBy(F.col("product_id").alias("id")).agg(
        F.min(F.nullif(F.col("price_cents"), F.lit(0).cast("long"))).alias("v_low"), F.max(F.nullif(F.col("price_cents"), F.lit(0).cast("long"))).alias("v_high"),
        F.count_if(F.col("price_cents").isNull()).alias("plain"), F.count("*").alias("n"), F.count("stock").alias("known_n"), F.sum(M.stock_number(F.col("stock"))).alias("total"),
    )
    own = M.product_price(F.col("price_cents"), F.col("sale_price_cents"))["current"]
    shared = F.when(F.coalesce("plain", F.lit(1)) > 0, own)
    unclear = (F.col("known_n") == 0) | ((F.col("total") == 0) & (F.col("known_n") < F.col("n")))
    own_stock = F.when(F.col("stock").isNotNull(), M.stock_number(F.col("stock")))
    return base.join(prices, "id", "left").select(
        "id", F.least("v_low", shared).alias("low"), F.greatest("v_high", shared).alias("high"),
        F.when(F.col("n").isNull(), own_stock).when(~unclear, F.col("total")).alias("known"),
        F.when(F.col("n").isNull(), F.col("stock")).when(F.col("known_n") == F.col("n"), F.col("total")).alias("stored"),
    )


def published_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Listing links whose page is published and a listing."""
    good = published(pages).where("listing").select(F.col("path").alias("target"))
    return links.join(good, "target", "left_semi")


def populate(df: DataFrame, relation: str, target: DataFrame, key: str = "id", as_name: str | None = None) -> DataFrame:
    """Replaces one relation id by the target row (left outer, depth one; apply again for depth two)."""
    name = as_name or relation
    side = target.select(F.col(key).alias("_key"), F.struct("*").alias("_doc"))
    joined = df.join(side, F.col(relation) == F.col("_key"), "left").drop("_key")
    return (joined.drop(relation) if name == relation else joined).withColumnRenamed("_doc", name)


def populate_many(df: DataFrame, row_key: str, relation: str, target: DataFrame, key: str = "id") -> DataFrame:
    """Replaces an id list (at most 500 by contract) by target rows in list order; missing ids drop."""
    items = df.select(row_key, F.posexplode(relation).alias("_pos", "_key"))
    found = items.join(target.select(F.col(key).alias("_key"), F.struct("*").alias("_doc")), "_key")
    lists = found.groupBy(row_key).agg(F.sort_array(F.collect_list(F.struct("_pos", "_doc"))).alias("_items"))
    docs = F.transform("_items", lambda item: item["_doc"])
    return df.drop(relation).join(lists, row_key, "left").withColumn(relation, docs).drop("_items")


# ------------------------------------------------------------------ listings

def product_routes(own: DataFrame, aliases: DataFrame, redirects: DataFrame) -> DataFrame:
    """One product per route from (route, product_id) tables; the product's own address wins over an
    alias, an alias over a captured redirect, then the lowest id."""
    ranked = [df.select("route", "product_id", F.lit(rank).alias("prio")) for rank, df in enumerate((own, aliases, redirects))]
    union = ranked[0].unionByName(ranked[1]).unionByName(ranked[2])
    best = union.groupBy("route").agg(F.min(F.struct("prio", "product_id")).alias("best"))
    return best.select("route", "best.product_id", "best.prio")


def listing_members(cards: DataFrame, routes: DataFrame) -> DataFrame:
    """cards(listing_id, pos, route) -> members once in card order, and unresolved cards.
    copies counts repeated cards of a member."""
    joined = cards.join(routes.select("route", "product_id", "prio"), "route", "left")
    member = joined.where("product_id is not null").groupBy("listing_id", "product_id").agg(
        F.min("pos").alias("pos"), F.count("*").alias("copies"), F.min_by("prio", "pos").alias("prio")
    )
    missing = joined.where("product_id is null").groupBy("listing_id", "pos").agg(F.count("*").alias("copies"))
    return member.unionByName(missing.select("listing_id", F.lit(None).cast("long").alias("product_id"), "pos", "copies", F.lit(None).cast("int").alias("prio")))


def longest_prefix(listings: DataFrame, categories: DataFrame) -> DataFrame:
    """listings(id, stem, shown_id), categories(slug, vm_id) -> nearest ancestor path that is a category.
    A path has at most 12 segments, so its prefixes are few and the join stays an equi join."""
    parts = F.split("stem", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    exploded = listings.where(F.size(parts) > 1).select("id", "shown_id", F.explode(prefixes).alias("slug"))
    found = exploded.join(categories.select("slug", "vm_id"), "slug").groupBy("id", "shown_id").agg(
        F.max(F.struct(F.length("slug").alias("size"), F.col("slug"), F.col("vm_id"))).alias("best")
    )
    vm, shown = F.col("best.vm_id"), F.col("shown_id")
    verdict = (
        F.when(vm == shown, F.lit("linked"))
        .when(vm.isNull() | shown.isNull(), F.lit("listing-category-unverified"))
        .otherwise(F.lit("listing-category-mismatch"))
    )
    return found.select("id", F.col("best.slug").alias("category_slug"), verdict.alias("verdict"))


def pagination_links(links: DataFrame, listings: DataFrame) -> DataFrame:
    """links(route, target, label), listings(route, category, maker) -> links within the same filter;
    a link to another filter is reported."""
    source = links.where("target <> route").groupBy("route", "target").agg(F.min("label").alias("label"))
    own = listings.select("route", F.col("category").alias("own_category"), F.col("maker").alias("own_maker"))
    other = listings.select(F.col("route").alias("target"), F.col("category").alias("to_category"), F.col("maker").alias("to_maker"))
    joined = source.join(own, "route").join(other, "target")
    known = F.col("own_category").isNotNull() & F.col("own_maker").isNotNull()
    same = known & (F.col("own_category") == F.col("to_category")) & F.coalesce(F.col("own_maker") == F.col("to_maker"), F.lit(False))
    return joined.select("route", "target", "label", F.when(same, F.lit("linked")).otherwise(F.lit("listing-link-other-filter")).alias("verdict"))


def listing_view(listing: DataFrame) -> DataFrame:
    """listing(members array<long>, found array<long>, first, last, total, own_path, links array<struct<label,path>>):
    members in order, hidden count, range text and distinct links."""
    first, last, total = F.col("first"), F.col("last"), F.col("total")
    is_range = (first >= 1) & (first <= last) & (last <= total) & ((first > 1) | (last < total))
    text = F.format_string("Wyniki %d–%d z %d", first, last, total)
    shown = F.transform(F.col("links"), lambda l: F.struct(F.trim(l["label"]).alias("label"), P.content_href(l["path"]).alias("href")))
    usable = F.filter(shown, lambda l: l["href"].isNotNull() & (l["label"] != "") & (l["href"] != P.content_href(F.col("own_path"))))
    firsts = F.filter(usable, lambda l, i: F.array_position(F.transform(usable, lambda x: x["href"]), l["href"]) == i + 1)
    ids = F.array_distinct("members")
    products = F.filter(ids, lambda m: F.array_contains(F.col("found"), m))
    return listing.select(
        *[name for name in listing.columns if name not in ("members", "found", "links")],
        products.alias("products"), (F.size(ids) - F.size(products)).alias("hidden"),
        F.when(is_range, text).alias("range"), firsts.alias("links"),
    )


def album_slice(photos: Column, page: Column, per_page: int) -> Column:
    """struct(rows, page, pages, total) of an album; the page is clamped to the album."""
    total = F.size(F.coalesce(photos, F.array().cast("array<string>")))
    pages = F.greatest(F.lit(1), F.ceil(total / per_page)).cast("int")
    current = F.least(F.greatest(F.lit(1), page), pages)
    return F.struct(
        F.slice(F.coalesce(photos, F.array().cast("array<string>")), (current - 1) * per_page + 1, F.lit(per_page)).alias("rows"),
        current.alias("page"), pages.alias("pages"), total.alias("total"),
    )
