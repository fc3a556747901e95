"""Redirect graph, dependency order and category tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sitemill.operators import catalog as C, graph as G, pages as PG
from sitemill.sources.adapters import table, view, with_views


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "v_redirect").select("src", "dst")


def _live(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").where("c_custkey % 4 = 0").select(F.concat(F.lit("/r-"), F.col("c_custkey").cast("string")).alias("route"))


def redirect_closure(spark: SparkSession, sf: str) -> DataFrame:
    return G.redirect_closure(_edges(spark, sf), _live(spark, sf))


def redirect_cycles(spark: SparkSession, sf: str) -> DataFrame:
    return G.cycle_members(_edges(spark, sf))


def redirect_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """Targets of a shared source: sources are folded so that several rules meet."""
    edges = view(spark, sf, "v_redirect").select((F.col("id") % 200).cast("string").alias("src"), "dst")
    return G.conflicting_targets(edges)


def dependency_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Round in which a record can be written: its needs come first. The order within a round is not
    contractual."""
    nodes = view(spark, sf, "v_category")
    edges = nodes.where("parent_id is not null").select("id", F.col("parent_id").alias("needs"))
    products = view(spark, sf, "v_product").select((F.col("id") + 1000).alias("id"), F.col("category_id").alias("needs"))
    everything = nodes.select("id").unionByName(products.select("id"))
    return G.dependency_levels(everything, edges.unionByName(products))


def _needs(spark: SparkSession, sf: str) -> DataFrame:
    """Parts need the one before them in runs of up to two hundred, some a second one, and a few close a loop."""
    part, k = table(spark, sf, "part"), F.col("p_partkey")
    needs = F.array_compact(F.array(F.when(k % 200 > 0, k - 1), F.when((k % 199 == 0) & (k > 0), F.floor(k / 2)), F.when(k % 400 == 390, k + 5)))
    return part.select(k.alias("id"), F.explode(needs).alias("needs"))


def dependency_chains(spark: SparkSession, sf: str) -> DataFrame:
    return G.dependency_levels(table(spark, sf, "part").select(F.col("p_partkey").alias("id")), _needs(spark, sf))


def _folders(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as folders of a tree of a hundred levels: in runs of fifty each hangs below the one before it, and a run below
    an earlier folder."""
    c = F.col("c_custkey")
    parent = F.when(c % 50 == 0, F.floor(c / 50)).otherwise(c - 1)
    return table(spark, sf, "customer").select(c.alias("id"), F.when(c > 0, parent).alias("parent_id"), (-(c % 10)).alias("order"), F.col("c_nationkey").alias("nation"), F.round(F.col("c_acctbal") * 100).cast("long").alias("cents"))


def folder_order(spark: SparkSession, sf: str) -> DataFrame:
    """The tree as a menu lists it, siblings by their order column."""
    return G.tree_order(_folders(spark, sf), F.col("order")).select("id", "depth", "position")


def folder_totals(spark: SparkSession, sf: str) -> DataFrame:
    """The sum of the amounts in each folder and all below it, and how many there are."""
    rows = _folders(spark, sf)
    labels = G.tree_labels(rows)
    totals = G.subtree_totals(labels, rows.select("id", F.col("cents").alias("value")))
    return totals.join(labels, "id").select("id", F.col("total").alias("cents"), ((F.col("leave") - F.col("enter") + 1) / 2).cast("long").alias("folders"))


def folder_members(spark: SparkSession, sf: str) -> DataFrame:
    """All folders below those of one nation, by ranges of the labels."""
    rows = _folders(spark, sf)
    return G.members_of(G.tree_labels(rows), rows.where("nation = 3")).groupBy("id").agg(F.count("*").alias("members"), F.max("member").alias("last_member"))


def crawl_reachability(spark: SparkSession, sf: str) -> DataFrame:
    """Pages reachable over stored redirects and links from every tenth address."""
    seeds = _edges(spark, sf).where("src like '%0'").select(F.col("src").alias("node"))
    return G.reachable(_edges(spark, sf), seeds)


def category_ancestors(spark: SparkSession, sf: str) -> DataFrame:
    return G.tree_ancestors(_deep_tree(spark, sf))


def _deep_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Parts hang below categories in a binary tree, so depth grows with the table."""
    parts = table(spark, sf, "part").select(
        (F.col("p_partkey") + 1000).alias("id"),
        F.when(F.col("p_partkey") < 25, F.col("p_partkey") + 100).otherwise(F.floor(F.col("p_partkey") / 2) + 1000).alias("parent_id"),
    )
    return view(spark, sf, "v_category").select("id", "parent_id").unionByName(parts)


def category_roots(spark: SparkSession, sf: str) -> DataFrame:
    kept = view(spark, sf, "v_category").where("id <> 2")
    return G.tree_roots(kept).select("id", "name")


def category_cycle_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers point at each other so that some groups of three form a ring."""
    s = F.col("s_suppkey")
    ring = F.when(s % 3 == 2, s - 2).otherwise(s + 1)
    nodes = table(spark, sf, "supplier").select(s.alias("id"), F.when(s % 10 < 5, ring).when(s > 0, F.floor(s / 2)).alias("parent_id"))
    return G.repair_parent_cycles(nodes).select("id", "parent_id", "was_cyclic")


def category_subtree_products(spark: SparkSession, sf: str) -> DataFrame:
    products = view(spark, sf, "v_product")
    primary = products.select(F.col("id").alias("product_id"), "category_id")
    secondary = products.select(F.col("id").alias("product_id"), (100 + (F.col("id") * 7) % 25).alias("category_id"))
    found = C.subtree_products(view(spark, sf, "v_category"), primary.unionByName(secondary))
    return found.groupBy("category_id").agg(F.count("*").alias("products"))


def _observations(spark: SparkSession, sf: str) -> DataFrame:
    """Category links seen in navigation: one per line item, with a few differing names and parents."""
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    slug = F.concat(F.lit("c-"), (F.col("l_partkey") % 97).cast("string"))
    return line.select(
        slug.alias("slug"),
        F.when(F.col("l_linenumber") % 5 != 0, F.concat(F.lit("name "), (F.col("l_orderkey") % 3 + F.col("l_partkey") % 2).cast("string"))).alias("name"),
        F.concat(F.lit("/"), slug, F.when(F.col("l_linenumber") % 2 == 0, F.lit(".html")).otherwise(F.lit(""))).alias("path"),
        F.when(F.col("l_partkey") % 97 < 50, F.lit("c-0")).when(F.col("l_partkey") % 97 < 70, F.concat(F.lit("c-"), (F.col("l_orderkey") % 2).cast("string"))).alias("parent"),
        F.lit(True).alias("has_parent"),
        F.when(F.col("l_partkey") % 97 < 80, F.col("l_partkey") % 97).when(F.col("l_partkey") % 97 < 90, F.col("l_orderkey") % 2).alias("vm_id"),
        F.concat(F.lit("https://shop.example.com/u-"), F.col("l_orderkey").cast("string")).alias("url"),
    )


def category_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return PG.category_rollup(_observations(spark, sf))


QUERIES = {
    query.__name__: query
    for query in (
        redirect_closure, redirect_cycles, redirect_conflicts, dependency_levels, crawl_reachability, category_ancestors, category_roots,
        category_cycle_repair, category_subtree_products, category_rollup, dependency_chains, folder_order, folder_totals, folder_members,
    )
}

_RED = with_views("v_redirect")
_OBS = """obs AS (SELECT concat('c-', CAST(l_partkey % 97 AS VARCHAR)) AS slug,
 CASE WHEN l_linenumber % 5 <> 0 THEN concat('name ', CAST(l_orderkey % 3 + l_partkey % 2 AS VARCHAR)) END AS name,
 concat('/c-', CAST(l_partkey % 97 AS VARCHAR), CASE WHEN l_linenumber % 2 = 0 THEN '.html' ELSE '' END) AS path,
 CASE WHEN l_partkey % 97 < 50 THEN 'c-0' WHEN l_partkey % 97 < 70 THEN concat('c-', CAST(l_orderkey % 2 AS VARCHAR)) END AS parent,
 CASE WHEN l_partkey % 97 < 80 THEN l_partkey % 97 WHEN l_partkey % 97 < 90 THEN l_orderkey % 2 END AS vm_id,
 concat('https://shop.example.com/u-', CAST(l_orderkey AS VARCHAR)) AS url FROM lineitem)"""

_FOLDERS = """WITH RECURSIVE f AS (SELECT c_custkey AS id, CASE WHEN c_custkey = 0 THEN NULL WHEN c_custkey % 50 = 0 THEN c_custkey // 50 ELSE c_custkey - 1 END AS parent_id,
 -(c_custkey % 10) AS o, c_nationkey AS nation, CAST(round(c_acctbal * 100) AS BIGINT) AS cents FROM customer),
 up AS (SELECT id, id AS a FROM f UNION ALL SELECT up.id, f.parent_id FROM up JOIN f ON f.id = up.a WHERE f.parent_id IS NOT NULL)"""

ORACLES = {
    "dependency_chains": """WITH RECURSIVE w(n, lv) AS (SELECT CAST(0 AS BIGINT), CAST([] AS INTEGER[]) UNION ALL
 SELECT n + 1, list_append(lv, CASE WHEN n % 400 = 390 AND n + 5 < (SELECT count(*) FROM part) THEN NULL WHEN n % 200 > 0 AND lv[n] IS NULL THEN NULL WHEN n % 199 = 0 AND n > 0 AND lv[n // 2 + 1] IS NULL THEN NULL
  WHEN n % 200 > 0 AND n % 199 = 0 AND n > 0 THEN 1 + greatest(lv[n], lv[n // 2 + 1]) WHEN n % 200 > 0 THEN 1 + lv[n] WHEN n % 199 = 0 AND n > 0 THEN 1 + lv[n // 2 + 1] ELSE 0 END) FROM w WHERE n < (SELECT count(*) FROM part))
 SELECT p_partkey AS id, lv[p_partkey + 1] AS level FROM part, (SELECT lv FROM w ORDER BY n DESC LIMIT 1)""",
    "folder_order": f"""{_FOLDERS}, path AS (SELECT id, [(o + 100) * 100000000 + id] AS p FROM f WHERE parent_id IS NULL UNION ALL SELECT f.id, list_append(p, (f.o + 100) * 100000000 + f.id) FROM path JOIN f ON f.parent_id = path.id)
 SELECT id, CAST(len(p) - 1 AS BIGINT) AS depth, row_number() OVER (ORDER BY p) AS position FROM path""",
    "folder_totals": f"{_FOLDERS} SELECT up.a AS id, CAST(sum(f.cents) AS BIGINT) AS cents, count(*) AS folders FROM up JOIN f ON f.id = up.id GROUP BY up.a",
    "folder_members": f"{_FOLDERS} SELECT up.a AS id, count(*) AS members, max(up.id) AS last_member FROM up JOIN f ON f.id = up.a WHERE f.nation = 3 GROUP BY up.a",
    "redirect_closure": f"""{_RED}, e AS (SELECT src, dst FROM v_redirect WHERE src NOT IN (SELECT concat('/r-', CAST(c_custkey AS VARCHAR)) FROM customer WHERE c_custkey % 4 = 0)),
 w AS (SELECT src, dst AS spot, 1 AS hops, [src, dst] AS seen, src = dst AS cyc FROM e
  UNION ALL SELECT w.src, e.dst, hops + 1, list_append(seen, e.dst), list_contains(seen, e.dst) FROM w JOIN e ON e.src = w.spot WHERE NOT cyc),
 f AS (SELECT src, arg_max(spot, hops) AS final, max(hops) AS hops, bool_or(cyc) AS cycle FROM w GROUP BY src)
 SELECT src, CASE WHEN NOT cycle THEN final END AS final, CASE WHEN NOT cycle THEN hops END AS hops, cycle, NOT cycle AND hops > 20 AS too_long FROM f""",
    "redirect_cycles": f"""{_RED}, w AS (SELECT src, dst AS spot, 1 AS n, [dst] AS seen FROM v_redirect
  UNION ALL SELECT w.src, e.dst, n + 1, list_append(seen, e.dst) FROM w JOIN v_redirect e ON e.src = w.spot WHERE w.spot <> w.src AND NOT list_contains(seen, e.dst))
 SELECT DISTINCT src AS node FROM w WHERE spot = src""",
    "redirect_conflicts": f"{_RED} SELECT CAST(id % 200 AS VARCHAR) AS src, count(DISTINCT dst) AS targets FROM v_redirect GROUP BY 1 HAVING count(DISTINCT dst) > 1",
    "dependency_levels": f"""{with_views('v_category', 'v_product')}, lv AS (SELECT id, CASE WHEN parent_id IS NULL THEN 0 ELSE 1 END AS level FROM v_category)
 SELECT id, level FROM lv UNION ALL SELECT p.id + 1000, lv.level + 1 FROM v_product p JOIN lv ON lv.id = p.category_id""",
    "crawl_reachability": f"""{_RED}, seed AS (SELECT DISTINCT src AS node FROM v_redirect WHERE src LIKE '%0'),
 w AS (SELECT node, 0 AS steps, [node] AS seen FROM seed UNION ALL SELECT e.dst, steps + 1, list_append(seen, e.dst) FROM w JOIN v_redirect e ON e.src = w.node WHERE NOT list_contains(seen, e.dst))
 SELECT node, min(steps) AS steps FROM w GROUP BY node""",
    "category_ancestors": f"""{with_views('v_category')}, t AS (SELECT id, parent_id FROM v_category UNION ALL SELECT p_partkey + 1000, CASE WHEN p_partkey < 25 THEN p_partkey + 100 ELSE p_partkey // 2 + 1000 END FROM part),
 w AS (SELECT t.id, t.parent_id AS ancestor, 1 AS depth FROM t WHERE t.parent_id IN (SELECT id FROM t) UNION ALL SELECT w.id, t.parent_id, depth + 1 FROM w JOIN t ON t.id = w.ancestor WHERE t.parent_id IN (SELECT id FROM t))
 SELECT id, ancestor, depth FROM w""",
    "category_roots": f"{with_views('v_category')} SELECT id, name FROM v_category WHERE id <> 2 AND (parent_id IS NULL OR parent_id = 2)",
    "category_cycle_repair": """WITH RECURSIVE n AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 10 < 5 THEN CASE WHEN s_suppkey % 3 = 2 THEN s_suppkey - 2 ELSE s_suppkey + 1 END WHEN s_suppkey > 0 THEN s_suppkey // 2 END AS parent_id FROM supplier),
 w AS (SELECT id, parent_id AS spot, [id] AS seen FROM n WHERE parent_id IS NOT NULL UNION ALL SELECT w.id, n.parent_id, list_append(seen, w.spot) FROM w JOIN n ON n.id = w.spot WHERE n.parent_id IS NOT NULL AND w.spot <> w.id AND NOT list_contains(seen, w.spot)),
 c AS (SELECT DISTINCT id FROM w WHERE spot = id)
 SELECT n.id, CASE WHEN c.id IS NULL THEN n.parent_id END AS parent_id, c.id IS NOT NULL AS was_cyclic FROM n LEFT JOIN c USING (id)""",
    "category_subtree_products": f"""{with_views('v_category', 'v_product')}, m AS (SELECT id AS product_id, category_id FROM v_product UNION SELECT id, 100 + (id * 7) % 25 FROM v_product),
 tree AS (SELECT id AS root, id AS category_id FROM v_category UNION SELECT parent_id, id FROM v_category WHERE parent_id IS NOT NULL)
 SELECT root AS category_id, count(DISTINCT product_id) AS products FROM tree JOIN m USING (category_id) GROUP BY 1""",
    "category_rollup": f"""WITH {_OBS}, v AS (SELECT slug, name, count(*) c FROM obs WHERE name IS NOT NULL GROUP BY ALL), nm AS (SELECT slug, arg_min(name, (-c, name)) AS name, count(*) AS names FROM v GROUP BY slug),
 f AS (SELECT slug, arg_min(path, (CASE WHEN path LIKE '%.html' THEN 0 ELSE 1 END, path)) AS legacy_path, min(url) AS first_url, min(parent) pl, max(parent) ph, count(*) FILTER (parent IS NULL) AS roots, min(vm_id) il, max(vm_id) ih FROM obs GROUP BY slug)
 SELECT f.slug, nm.name, coalesce(names, 0) AS names, legacy_path, first_url, CASE WHEN pl IS NOT DISTINCT FROM ph AND (roots = 0 OR pl IS NULL) THEN pl END AS parent,
 NOT (pl IS NOT DISTINCT FROM ph AND (roots = 0 OR pl IS NULL)) AS parent_conflict, CASE WHEN il = ih THEN il END AS vm_id, coalesce(il <> ih, false) AS id_conflict FROM f LEFT JOIN nm USING (slug)""",
}
