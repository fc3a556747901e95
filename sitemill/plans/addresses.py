"""Pages: addresses, copies, claims, candidate identity, migration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sitemill.functions import paths as P
from sitemill.functions.hashing import text_digest
from sitemill.operators import pages as G, routes as R
from sitemill.sources.adapters import dealt, table, view, with_views
from sitemill.session import cut_lineage

# hosts of the page table count as own hosts
OWN = r"\A[a-z0-9.-]+\.example\.(?:com|net|org)\z"
_HOST = r"[a-z0-9.-]+\.example\.(?:com|net|org)"

_URL_SQL = rf"""
u AS (SELECT page_id, url, html, capture_state,
 regexp_extract(url,'^([a-z]+)://',1) AS scheme, regexp_extract(url,'^[a-z]+://([^/?#]*)',1) AS host,
 regexp_extract(url,'^[a-z]+://[^/?#]*([^?#]*)',1) AS rawpath, regexp_extract(url,'^[^?#]*(\?[^#]*)',1) AS query FROM v_capture),
p AS (SELECT *, CASE WHEN regexp_full_match(host,'{_HOST}') AND query = '' THEN CASE WHEN rawpath = '' THEN '/' ELSE rawpath END END AS path FROM u)"""
_ROUTE = r"regexp_replace(regexp_replace({0},'^/+|/+$','','g'),'(?i)\.html$','')"


def _capture(spark: SparkSession, sf: str) -> DataFrame:
    sha = F.when(F.col("page_id") % 17 == 0, F.lit("0" * 64)).otherwise(F.sha2(F.encode("html", "utf-8"), 256))
    return view(spark, sf, "v_capture").withColumn("sha256", sha)


def page_route_keys(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "v_capture").select("page_id", "url", P.site_path(F.col("url"), host_pattern=OWN).alias("path"))
    return rows.select("page_id", "path", P.route_key(F.col("path")).alias("route"), P.public_url(F.col("url")).alias("public_url"), G.public_scope(F.col("url"), host_pattern=OWN).alias("in_scope"))


def page_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return G.judge_pages(_capture(spark, sf), host_pattern=OWN).select("page_id", "path", F.coalesce("reject_code", F.lit("accepted")).alias("verdict"))


def page_prepare_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return G.distinct_captures(G.judge_pages(_capture(spark, sf), host_pattern=OWN)).select("path", "sha256", "page_id", "url", "captures")


def page_preferred_address(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "v_capture").select(P.site_path(F.col("url"), host_pattern=OWN).alias("path")).where("path is not null")
    return G.preferred_addresses(rows.withColumn("route", P.route_key(F.col("path"))), ["route"])


def page_claim_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "v_capture").select("page_id", P.site_path(F.col("url"), host_pattern=OWN).alias("path")).where("path is not null")
    return G.claim_conflicts(rows.select(P.route_key(F.col("path")).alias("claim"), F.col("page_id").alias("owner")))


def issue_counts(spark: SparkSession, sf: str) -> DataFrame:
    judged = G.judge_pages(_capture(spark, sf), host_pattern=OWN).where("reject_code is not null")
    return G.issue_counts(judged, "reject_code")


def preferred_captures(spark: SparkSession, sf: str) -> DataFrame:
    """The same address several times, captured or not: addresses repeat with their page number."""
    rows = view(spark, sf, "v_capture").select(
        F.concat(F.lit("https://shop.example.com/x-"), (F.col("page_id") % 40).cast("string")).alias("url"), "capture_state", F.col("page_id").alias("position")
    )
    return G.preferred_captures(rows)


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "v_candidate")
    return rows.select("collection", F.col("key_text").alias("key"), "path", text_digest(F.col("body")).alias("fingerprint"), "seo")


def candidate_identity_merge(spark: SparkSession, sf: str) -> DataFrame:
    return G.merge_candidates(_candidates(spark, sf))


def alias_redirects(spark: SparkSession, sf: str) -> DataFrame:
    return G.alias_redirects(_candidates(spark, sf))


def conflict_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """Documents claim the first words of their text; every third one needs the one at half its number."""
    docs = view(spark, sf, "v_candidate")
    claims = docs.select(F.concat_ws("|", "collection", "key_text").alias("claim"), F.col("id").alias("owner"))
    needs = docs.where("id % 3 = 0 and id > 0").select("id", F.floor(F.col("id") / 2).alias("needs_id"))
    return G.conflict_cascade(claims, needs, docs.select("id"))


# ------------------------------------------------------------------ routes and migration

def _crawl(spark: SparkSession, sf: str) -> DataFrame:
    ids = lambda name, key: dealt(table(spark, sf, name).select(key), key)
    return spark.sql(_CRAWL, customer=ids("customer", "c_custkey"), part=ids("part", "p_partkey"))


_CRAWL = """
SELECT concat('https://shop.example.com/r-',CAST(c_custkey AS VARCHAR(20))) AS url,
 CASE WHEN c_custkey % 3 = 0 THEN concat('https://shop.example.com/p-',CAST(c_custkey % 100 AS VARCHAR(20)),'.html') END AS final_url,
 CASE WHEN c_custkey % 10 = 7 THEN 'failed' ELSE 'captured' END AS capture_state, c_custkey AS position FROM {customer}
UNION ALL SELECT concat('https://shop.example.com/p-',CAST(p_partkey AS VARCHAR(20)),CASE WHEN p_partkey % 7 = 0 THEN '.html?x=1' ELSE '.html' END),
 CAST(NULL AS VARCHAR(20)), 'captured', 1000000000 + p_partkey FROM {part}"""


def _redirects(spark: SparkSession, sf: str) -> DataFrame:
    return dealt(view(spark, sf, "v_redirect"), "id").withColumn("published", F.col("id") % 6 != 0)


def _routes(spark: SparkSession, sf: str) -> DataFrame:
    return dealt(view(spark, sf, "v_route"), "id")


def route_resolution(spark: SparkSession, sf: str) -> DataFrame:
    docs = _routes(spark, sf)
    raws = table(spark, sf, "part").select(F.concat(F.lit("p-"), F.col("p_partkey").cast("string"), F.lit(".html")).alias("raw")).unionByName(
        table(spark, sf, "customer").select(F.concat(F.lit("r-"), F.col("c_custkey").cast("string")).alias("raw"))
    ).unionByName(table(spark, sf, "supplier").select(F.concat(F.lit("g-"), F.col("s_suppkey").cast("string")).alias("raw")))
    return R.resolve_addresses(raws, R.route_index(docs)).where("kind is not null").select("raw", "kind", "id")


def _migration(spark: SparkSession, sf: str) -> DataFrame:
    return R.migration_map(_crawl(spark, sf), _routes(spark, sf), _redirects(spark, sf), host_pattern=OWN)


def migration_map(spark: SparkSession, sf: str) -> DataFrame:
    rows = _migration(spark, sf)
    return rows.select(
        "old_url", "old_path", "new_path", "disposition", "current_status", "canonical_path", "resolved_kind", "record_id", "redirect_hops",
        "capture_state", "reason", F.array_join(F.sort_array("issues"), ";").alias("issues"),
    )


def migration_dispositions(spark: SparkSession, sf: str) -> DataFrame:
    return R.disposition_counts(_migration(spark, sf))


def migration_proposals(spark: SparkSession, sf: str) -> DataFrame:
    return R.migration_proposals(cut_lineage(_migration(spark, sf)), host_pattern=OWN)


def migration_decisions(spark: SparkSession, sf: str) -> DataFrame:
    issues = table(spark, sf, "customer").where("c_custkey % 4 = 0").select(
        F.concat(F.lit("https://shop.example.com/r-"), F.col("c_custkey").cast("string")).alias("url"),
        F.when(F.col("c_custkey") % 8 == 0, F.lit("missing-title")).otherwise(F.lit("shop-component-missing")).alias("code"),
    )
    return R.decision_register(_migration(spark, sf), issues)


def migration_rule_audit(spark: SparkSession, sf: str) -> DataFrame:
    rules = _redirects(spark, sf).withColumn("rule_url", F.concat(F.lit("https://shop.example.com"), "src"))
    crawl = rules.where("published").select(F.col("rule_url").alias("url"), F.lit(None).cast("string").alias("final_url"), F.lit("captured").alias("capture_state"), F.col("id").alias("position"))
    audited = R.migration_map(crawl, _routes(spark, sf), rules, host_pattern=OWN).withColumn("rule_url", F.col("old_url"))
    return R.rule_audit(rules, audited)


def sitemap_paths(spark: SparkSession, sf: str) -> DataFrame:
    return R.sitemap_paths(_routes(spark, sf))


def imported_routes(spark: SparkSession, sf: str) -> DataFrame:
    return R.imported_routes(_routes(spark, sf))


def public_redirects(spark: SparkSession, sf: str) -> DataFrame:
    live = R.live_routes(_routes(spark, sf))
    return R.public_redirects(_redirects(spark, sf), live).select("id", "src", "dst")


def captured_redirect_routes(spark: SparkSession, sf: str) -> DataFrame:
    """Redirects recorded by a crawl, one captured pair per customer; every fourth address has content."""
    rows = dealt(view(spark, sf, "v_redirect"), "id")
    host = "https://shop.example.com"
    captures = rows.select(F.concat(F.lit(host), "src").alias("url"), F.concat(F.lit(host), "dst", F.when(F.col("id") % 31 == 0, F.lit("?q=1")).otherwise(F.lit(""))).alias("final_url"))
    live = rows.where("id % 4 = 0").select(P.route_key(F.col("src")).alias("route"))
    resolved, issues = R.captured_redirects(captures, live, host_pattern=OWN)
    return resolved.select(F.col("src").alias("route"), "final", F.lit(None).cast("string").alias("code")).unionByName(
        issues.select(F.regexp_replace("source", r"\A(?:https://[^/]+)?/", "").alias("route"), F.lit(None).cast("string").alias("final"), "code")
    )


def unapproved_redirects(spark: SparkSession, sf: str) -> DataFrame:
    rules = view(spark, sf, "v_redirect").select(F.col("src").alias("from_path"), F.col("dst").alias("to_path"), "id")
    return R.unapproved_redirects(rules, rules.where("id % 10 <> 0")).select("from_path", "to_path")


def sitemap_audit(spark: SparkSession, sf: str) -> DataFrame:
    docs = _routes(spark, sf)
    paths = cut_lineage(R.sitemap_paths(docs))
    crawl = paths.select(F.concat(F.lit("https://shop.example.com"), "path").alias("url"), F.lit(None).cast("string").alias("final_url"), F.lit("captured").alias("capture_state"), F.lit(0).alias("position"))
    return R.sitemap_audit(paths, R.migration_map(crawl, docs, _redirects(spark, sf), host_pattern=OWN))


def sitemap_entries(spark: SparkSession, sf: str) -> DataFrame:
    return R.sitemap_entries(R.sitemap_paths(_routes(spark, sf)), "https://shop.example.com")


def address_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Kind, trap and measurement verdicts of the old addresses, spread over typical sections."""
    k = F.col("c_custkey")
    folder = F.element_at(F.array(*[F.lit(name) for name in _SECTIONS]), (k % len(_SECTIONS) + 1).cast("int"))
    path = F.concat(F.lit("/"), folder, F.lit("/x-"), k.cast("string"), F.lit(".html"))
    rows = table(spark, sf, "customer").select(k.alias("id"), path.alias("path"))
    return rows.select("id", P.page_kind(F.col("path")).alias("kind"), G.calendar_navigation(F.col("path")).alias("trap"), P.measurement_path(F.concat("path", F.lit("?a=b"))).alias("measured"), G.crawl_priority(F.col("path")).alias("priority"))


_SECTIONS = ["aktualnosci", "relacje-2020", "polityka-cookies", "kalendarz", "api", "sklep", "component/jevents", "kalendarz/eventdetail/12/-"]


def media_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Image addresses of the parts in the spellings that sources use."""
    k = F.col("p_partkey")
    number = k.cast("string")
    src = (
        F.when(k % 8 == 0, F.concat(F.lit("https://shop.example.com/img/"), number, F.lit(".jpg"))).when(k % 8 == 1, F.concat(F.lit("https://shop.example.com/img/"), number, F.lit(".jpg?v=1")))
        .when(k % 8 == 2, F.concat(F.lit("https://cdn.test/"), number, F.lit(".png"))).when(k % 8 == 3, F.lit("data:image/png;base64,AA")).when(k % 8 == 4, F.concat(F.lit("https://shop.example.com/templates/"), number, F.lit(".gif")))
        .when(k % 8 == 5, F.concat(F.lit("https://shop.example.com/a/../"), number, F.lit(".jpg"))).when(k % 8 == 6, F.concat(F.lit("https://shop.example.com/doc/"), number, F.lit(".pdf"))).otherwise(F.lit(""))
    )
    return table(spark, sf, "part").select(k.alias("id"), P.media_verdict(src, host_pattern=OWN).alias("m")).select("id", "m.code", "m.path")


QUERIES = {
    query.__name__: query
    for query in (
        captured_redirect_routes, unapproved_redirects, sitemap_audit, sitemap_entries, address_classes, media_verdicts, page_route_keys, page_verdicts, page_prepare_dedup, page_preferred_address, page_claim_conflicts, issue_counts, preferred_captures,
        candidate_identity_merge, alias_redirects, conflict_cascade, route_resolution, migration_map, migration_dispositions, migration_proposals,
        migration_decisions, migration_rule_audit, sitemap_paths, imported_routes, public_redirects,
    )
}

_PAGES = with_views("v_capture") + "," + _URL_SQL
_SHA = "CASE WHEN page_id % 17 = 0 THEN repeat('0',64) ELSE sha256(html) END"
_VERDICT = "CASE WHEN page_id % 17 = 0 THEN 'integrity-mismatch' WHEN path IS NULL THEN 'out-of-scope-url' ELSE 'accepted' END"
_CAND = with_views("v_candidate")
_MERGE = f"""{_CAND}, per AS (SELECT collection, key_text AS key, path, min(sha256(body)) lo, max(sha256(body)) hi, min(seo) <> max(seo) AS sc, count(*) n FROM v_candidate GROUP BY ALL),
m AS (SELECT collection, key, min(lo) <> max(hi) AS clash, bool_or(sc) AS sc, CAST(sum(n) AS BIGINT) AS candidates, arg_min(path, (length(path), path)) AS pp FROM per GROUP BY ALL),
merged AS (SELECT collection, key, candidates, CASE WHEN clash THEN 'conflicting-source-content' WHEN sc THEN 'conflicting-page-metadata' ELSE 'merged' END AS verdict,
 CASE WHEN NOT clash AND NOT sc THEN pp END AS primary_path FROM m)"""

# address resolution written out for plain ASCII addresses
_RESOLVE = f"""
idx AS (
 SELECT 'L' || legacy_path AS key, 1 AS step, kind_rank, id, kind FROM v_route WHERE published AND legacy_path IS NOT NULL
 UNION ALL SELECT 'S' || slug, 3, kind_rank, id, kind FROM v_route WHERE published AND kind IN ('product','category')
 UNION ALL SELECT 'P' || path, 3, kind_rank, id, kind FROM v_route WHERE published AND kind = 'page'),
asked AS (SELECT DISTINCT raw, {_ROUTE.format('raw')} AS stem FROM ask),
keys AS (
 SELECT raw, 'L' || unnest(['/' || raw, raw, '/' || raw || '/']) AS key FROM asked
 UNION ALL SELECT raw, 'S' || stem FROM asked
 UNION ALL SELECT raw, 'P' || unnest([stem, stem || '.html', '/' || stem, '/' || stem || '.html']) FROM asked),
hit AS (SELECT raw, arg_min(kind, (step, idx.kind_rank, id)) AS kind, arg_min(id, (step, idx.kind_rank, id)) AS id FROM keys JOIN idx USING (key) GROUP BY raw)"""
_CANON = r"""canon AS (SELECT kind, id, CASE WHEN legacy_path IS NOT NULL THEN legacy_path WHEN kind IN ('product','category') THEN '/' || slug || '.html' ELSE '/' || path || '.html' END AS canonical FROM v_route WHERE published)"""


def _map_sql(crawl: str) -> str:
    """The migration map over adapter data: addresses are plain, so only these rules can apply."""
    return f"""{with_views('v_route', 'v_redirect')}, crawl AS ({crawl}),
red AS (SELECT id, src, dst FROM v_redirect WHERE id % 6 <> 0),
base AS (SELECT url, final_url, capture_state, regexp_extract(url,'^https://[^/]*([^?]*)',1) AS path, contains(url,'?') AS q FROM crawl),
{_CANON},
ask AS (SELECT substring(path,2) AS raw FROM base UNION SELECT substring(dst,2) FROM red UNION SELECT substring(canonical,2) FROM canon),
{_RESOLVE},
walk AS (SELECT path AS start, path AS spot, 0 AS hops, [path] AS seen, false AS loop FROM base WHERE NOT q
 UNION ALL SELECT w.start, r.dst, w.hops + 1, list_append(w.seen, r.dst), list_contains(w.seen, r.dst)
 FROM walk w JOIN red r ON r.src = w.spot WHERE NOT w.loop AND NOT EXISTS (SELECT 1 FROM hit h WHERE h.raw = substring(w.spot,2))),
fin AS (SELECT start, arg_max(spot, hops) AS spot, max(hops) AS hops, bool_or(loop) AS loop FROM walk GROUP BY start),
st AS (SELECT b.url AS old_url, b.path AS old_path, b.q, b.final_url, b.capture_state, coalesce(f.hops,0) AS hops, coalesce(f.loop,false) AS loop, f.spot, h.kind, h.id,
  c.canonical, ch.kind = h.kind AND ch.id = h.id AS ok, own.src IS NOT NULL AS own, NOT b.q AND NOT coalesce(f.loop,false) AND h.kind IS NOT NULL AS reached
 FROM base b LEFT JOIN fin f ON f.start = b.path AND NOT b.q LEFT JOIN hit h ON h.raw = substring(f.spot,2)
 LEFT JOIN canon c ON c.kind = h.kind AND c.id = h.id LEFT JOIN hit ch ON ch.raw = substring(c.canonical,2) LEFT JOIN (SELECT DISTINCT src FROM red) own ON own.src = b.path),
iss AS (SELECT *, CASE WHEN q THEN [] ELSE list_filter([
  CASE WHEN capture_state <> 'captured' THEN 'source-capture-' || capture_state END, CASE WHEN loop THEN 'redirect-loop' END,
  CASE WHEN reached AND NOT coalesce(ok,false) THEN 'canonical-does-not-resolve-to-same-record' END,
  CASE WHEN reached AND hops > 1 THEN 'existing-redirect-chain-needs-flattening' END,
  CASE WHEN reached AND hops > 0 AND canonical <> spot THEN 'redirect-target-canonical-elsewhere' END,
  CASE WHEN reached AND hops = 0 AND own THEN 'stored-redirect-shadowed-by-published-content' END,
  CASE WHEN reached AND hops = 0 AND canonical <> spot THEN 'served-alias-canonical-elsewhere' END], lambda x: x IS NOT NULL) END AS issues FROM st),
mig AS (SELECT old_url, old_path, CASE WHEN reached THEN spot END AS new_path,
 CASE WHEN q THEN 'review' WHEN NOT reached THEN CASE WHEN len(issues) > 0 THEN 'review' ELSE 'unresolved404' END
  WHEN len(list_filter(issues, lambda x: x NOT IN ('served-alias-canonical-elsewhere','stored-redirect-shadowed-by-published-content'))) > 0 THEN 'review'
  WHEN hops > 0 THEN 'redirect301' ELSE 'retained200' END AS disposition,
 CASE WHEN q THEN NULL WHEN NOT reached THEN CASE WHEN loop THEN NULL ELSE 404 END WHEN hops > 0 THEN 301 ELSE 200 END AS current_status,
 CASE WHEN reached THEN canonical END AS canonical_path, CASE WHEN reached THEN kind END AS resolved_kind, CASE WHEN reached THEN id END AS record_id,
 CASE WHEN q THEN 0 ELSE hops END AS redirect_hops, final_url, capture_state,
 CASE WHEN q THEN 'source-query-needs-explicit-route-mapping' WHEN NOT reached THEN CASE WHEN hops > 0 THEN 'stored-redirect-destination-unresolved' ELSE 'no-published-destination' END
  WHEN hops > 0 THEN 'verified-permanent-route-to-published-destination' ELSE 'source-path-served-without-redirect' END AS reason, issues FROM iss)"""


_MAP = _map_sql(_CRAWL.format(customer="customer", part="part"))
_RULES = "SELECT concat('https://shop.example.com', src) AS url, CAST(NULL AS VARCHAR) AS final_url, 'captured' AS capture_state FROM v_redirect WHERE id % 6 <> 0"
_FIXED_PATHS = sorted({*R.K.SECTION_PATHS.values()})

ORACLES = {
    "page_route_keys": f"""{_PAGES} SELECT page_id, path, {_ROUTE.format('path')} AS route, scheme || '://' || host || rawpath AS public_url,
 scheme = 'https' AND query = '' AND regexp_full_match(host,'{_HOST}') AS in_scope FROM p""",
    "page_verdicts": f"{_PAGES} SELECT page_id, path, {_VERDICT} AS verdict FROM p",
    "page_prepare_dedup": f"""{_PAGES} SELECT path, {_SHA} AS sha256, arg_min(page_id, (url, page_id)) AS page_id, min(url) AS url, count(*) AS captures
 FROM p WHERE page_id % 17 <> 0 AND path IS NOT NULL GROUP BY path, {_SHA}""",
    "page_preferred_address": f"""{_PAGES} SELECT {_ROUTE.format('path')} AS route, arg_min(path, (length(path), path)) AS preferred,
 arg_min(path, (CASE WHEN lower(path) LIKE '%.html' THEN 0 ELSE 1 END, path)) AS spelling, count(DISTINCT path) AS paths, count(*) AS rows FROM p WHERE path IS NOT NULL GROUP BY 1""",
    "page_claim_conflicts": f"""{_PAGES} SELECT {_ROUTE.format('path')} AS claim, count(DISTINCT page_id) AS owners, min(page_id) AS first_owner, max(page_id) AS last_owner
 FROM p WHERE path IS NOT NULL GROUP BY 1 HAVING count(DISTINCT page_id) > 1""",
    "issue_counts": f"{_PAGES} SELECT {_VERDICT} AS code, count(*) AS n FROM p WHERE {_VERDICT} <> 'accepted' GROUP BY 1",
    "preferred_captures": f"""{with_views('v_capture')}, a AS (SELECT concat('https://shop.example.com/x-', CAST(page_id % 40 AS VARCHAR)) AS url, capture_state, page_id AS position FROM v_capture),
 r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY CASE WHEN capture_state = 'captured' THEN 0 ELSE 1 END, CASE WHEN capture_state = 'captured' THEN position ELSE -position END) AS rn, count(*) OVER (PARTITION BY url) AS rows FROM a)
 SELECT url, capture_state, position, rows FROM r WHERE rn = 1""",
    "candidate_identity_merge": f"{_MERGE} SELECT * FROM merged",
    "alias_redirects": f"""{_MERGE}, al AS (SELECT DISTINCT collection, key_text AS key, path, {_ROUTE.format('path')} AS route FROM v_candidate),
 pick AS (SELECT collection, key, route, arg_min(path, (CASE WHEN lower(path) LIKE '%.html' THEN 0 ELSE 1 END, length(path), path)) AS from_path FROM al GROUP BY ALL)
 SELECT p.collection, p.key, p.from_path, m.primary_path AS to_path FROM pick p JOIN merged m USING (collection, key)
 WHERE m.verdict = 'merged' AND m.candidates > 1 AND p.route <> {_ROUTE.format('m.primary_path')}""",
    "conflict_cascade": f"""{_CAND}, clash AS (SELECT collection, key_text FROM v_candidate GROUP BY ALL HAVING count(*) > 1),
 c AS (SELECT id FROM v_candidate JOIN clash USING (collection, key_text)),
 need AS (SELECT id, id // 2 AS needs_id FROM v_candidate WHERE id % 3 = 0 AND id > 0),
 d AS (SELECT id FROM c UNION SELECT id FROM need WHERE needs_id NOT IN (SELECT id FROM v_candidate) UNION SELECT n.id FROM need n JOIN d ON n.needs_id = d.id)
 SELECT id, CASE WHEN id IN (SELECT id FROM c) THEN 'conflict' ELSE 'dependency' END AS reason FROM d""",
    "route_resolution": f"""{with_views('v_route')}, ask AS (SELECT concat('p-', CAST(p_partkey AS VARCHAR), '.html') AS raw FROM part UNION SELECT concat('r-', CAST(c_custkey AS VARCHAR)) FROM customer UNION SELECT concat('g-', CAST(s_suppkey AS VARCHAR)) FROM supplier),
 {_RESOLVE} SELECT raw, kind, id FROM hit""",
    "migration_map": f"{_MAP} SELECT * EXCLUDE (final_url, issues), array_to_string(list_sort(issues), ';') AS issues FROM mig",
    "migration_dispositions": f"""{_MAP} SELECT d.disposition, count(mig.old_url) AS n FROM (SELECT unnest(['retained200','redirect301','unresolved404','review']) AS disposition) d LEFT JOIN mig USING (disposition) GROUP BY 1""",
    "migration_proposals": f"""{_MAP}, good AS (SELECT * FROM mig WHERE disposition IN ('retained200','redirect301') AND canonical_path = new_path)
 SELECT m.old_path AS from_path, g.new_path AS to_path, g.resolved_kind AS target_kind FROM mig m JOIN good g ON g.old_path = regexp_extract(m.final_url,'^https://[^/]*(.*)$',1)
 WHERE m.disposition = 'unresolved404' AND m.capture_state = 'captured' AND g.new_path <> m.old_path""",
    "migration_decisions": f"""{_MAP}, si AS (SELECT concat('https://shop.example.com/r-', CAST(c_custkey AS VARCHAR)) AS old_url, CASE WHEN c_custkey % 8 = 0 THEN 'missing-title' ELSE 'shop-component-missing' END AS code FROM customer WHERE c_custkey % 4 = 0)
 SELECT m.old_url, disposition, reason, coalesce(si.code, reason) AS primary_cause, CAST(CASE WHEN si.code IS NULL THEN 0 ELSE 1 END AS BIGINT) AS issue_codes,
 CASE WHEN capture_state <> 'captured' THEN 'retained-source-or-current-source-database' ELSE 'current-source-database-or-exact-retained-source-evidence' END AS required_evidence
 FROM mig m LEFT JOIN si USING (old_url) WHERE disposition IN ('unresolved404','review')""",
    "migration_rule_audit": f"""{_map_sql(_RULES)}, g AS (SELECT src, count(*) n, min(dst) <> max(dst) AS clash FROM red GROUP BY src)
 SELECT r.id, CASE WHEN g.clash THEN 'conflicting-rule-destinations' WHEN g.n > 1 THEN 'duplicate-rule-key'
 WHEN m.disposition = 'redirect301' AND m.redirect_hops = 1 AND m.new_path = r.dst AND m.new_path = m.canonical_path AND len(m.issues) = 0 THEN 'ok' ELSE 'published-rule-not-direct-canonical-301' END AS verdict
 FROM red r JOIN g USING (src) LEFT JOIN mig m ON m.old_url = concat('https://shop.example.com', r.src)""",
    "sitemap_paths": f"""{with_views('v_route')}, {_CANON}, ask AS (SELECT DISTINCT substring(canonical,2) AS raw FROM canon), {_RESOLVE},
 again AS (SELECT h.kind, h.id, c.canonical FROM hit h JOIN canon c USING (kind, id))
 SELECT a.canonical AS path FROM again a JOIN hit h ON h.raw = substring(a.canonical,2) AND h.kind = a.kind AND h.id = a.id
 UNION SELECT unnest({_FIXED_PATHS + ['/']!r})""",
    "imported_routes": f"""{with_views('v_route')} SELECT kind, id, CASE WHEN legacy_path IS NOT NULL THEN legacy_path ELSE '/' || coalesce(path, slug) || '.html' END AS path, 'check' AS status FROM v_route WHERE published""",
    "public_redirects": f"""{with_views('v_route', 'v_redirect')}, live AS (SELECT {_ROUTE.format('legacy_path')} AS r FROM v_route WHERE published AND legacy_path IS NOT NULL
 UNION SELECT slug FROM v_route WHERE published AND kind IN ('product','category') UNION SELECT {_ROUTE.format('path')} FROM v_route WHERE published AND kind = 'page')
 SELECT id, src, dst FROM v_redirect WHERE id % 6 <> 0 AND {_ROUTE.format('src')} NOT IN (SELECT r FROM live)""",
    "captured_redirect_routes": f"""{with_views('v_redirect')}, c AS (SELECT id, substring(src, 2) AS s, {_ROUTE.format('dst')} AS d FROM v_redirect), ok AS (SELECT * FROM c WHERE id % 31 <> 0),
 e AS (SELECT s, d FROM ok WHERE id % 4 <> 0), w AS (SELECT s, d AS spot, [s, d] AS seen, s = d AS cyc FROM e UNION ALL SELECT w.s, e.d, list_append(seen, e.d), list_contains(seen, e.d) FROM w JOIN e ON e.s = w.spot WHERE NOT cyc),
 f AS (SELECT s, arg_max(spot, len(seen)) AS final, bool_or(cyc) AS cyc FROM w GROUP BY s)
 SELECT s AS route, CASE WHEN NOT cyc THEN final END AS final, CASE WHEN cyc THEN 'captured-redirect-cycle' END AS code FROM f
 UNION ALL SELECT s, NULL, 'captured-redirect-rejected' FROM c WHERE id % 31 = 0 UNION ALL SELECT s, NULL, 'captured-redirect-shadowed' FROM ok WHERE id % 4 = 0""",
    "unapproved_redirects": f"{with_views('v_redirect')} SELECT src AS from_path, dst AS to_path FROM v_redirect WHERE id % 10 = 0",
    "address_classes": """WITH s AS (SELECT c_custkey AS id, ['aktualnosci','relacje-2020','polityka-cookies','kalendarz','api','sklep','component/jevents','kalendarz/eventdetail/12/-'][c_custkey % 8 + 1] AS f FROM customer)
 SELECT id, CASE WHEN f = 'polityka-cookies' THEN 'legal' WHEN f = 'aktualnosci' THEN 'news' WHEN f = 'relacje-2020' THEN 'report' ELSE 'page' END AS kind, f IN ('kalendarz', 'component/jevents') AS trap,
 CASE WHEN f <> 'api' THEN concat('/', f, '/x-', CAST(id AS VARCHAR), '.html') END AS measured, CASE WHEN f IN ('api', 'sklep', 'component/jevents') THEN 1 ELSE 0 END AS priority FROM s""",
    "media_verdicts": """SELECT p_partkey AS id, CASE p_partkey % 8 WHEN 0 THEN NULL WHEN 1 THEN 'media-query' WHEN 2 THEN 'media-external-host' WHEN 3 THEN 'media-inline-data' WHEN 4 THEN 'media-template-asset' WHEN 5 THEN 'media-traversal' WHEN 6 THEN 'media-extension' ELSE 'media-empty' END AS code,
 CASE WHEN p_partkey % 8 = 0 THEN concat('img/', CAST(p_partkey AS VARCHAR), '.jpg') END AS path FROM part""",
}
ORACLES["sitemap_entries"] = f"SELECT 'https://shop.example.com' || path AS url, '  <url><loc>https://shop.example.com' || path || '</loc></url>' AS entry FROM ({ORACLES['sitemap_paths']})"
# sections have no record of their own in the adapter tables, so the map keeps them as they are
ORACLES["sitemap_audit"] = f"""{_map_sql("SELECT 'https://shop.example.com' || path AS url, CAST(NULL AS VARCHAR) AS final_url, 'captured' AS capture_state FROM (" + ORACLES['sitemap_paths'] + f") WHERE path NOT IN ({', '.join(repr(x) for x in _FIXED_PATHS + ['/'])})")}
 SELECT old_path AS path, 'sitemap-not-public-canonical-200' AS code FROM mig WHERE NOT (disposition = 'retained200' AND new_path = canonical_path AND len(issues) = 0)"""
