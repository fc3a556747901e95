"""Address resolution, the migration map and its audits.

Resolution is one equi join: published records are indexed by every key an address can match, each
key keeps only its winner (earlier step, then kind, then lowest id), and an address is exploded into
its few candidate keys. Redirect chains are walked on the graph of distinct addresses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sitemill import constants as K
from sitemill.functions import paths as P
from sitemill.functions.binding import let
from sitemill.functions.documents import seo_url
from sitemill.functions.text import xml_escape
from sitemill.functions.unicode import nfc
from sitemill.operators.files import one_row
from sitemill.operators.graph import chain_ends, chain_walks
from sitemill.operators.pages import preferred_captures
from sitemill.session import cut_lineage

_SLUG_KINDS = ["product", "category"]
_PATH_KINDS = ["page", "trip", "album", "event"]


def routes_of(docs: DataFrame) -> DataFrame:
    """docs(kind, id, legacy_path, slug, path) -> public route keys of every record (claims)."""
    keys = F.array_compact(F.array(
        P.route_key(F.col("legacy_path")),
        F.when(F.col("kind").isin(*_SLUG_KINDS), F.col("slug")).when(F.col("kind") == "course", F.concat(F.lit(K.COURSE_PREFIX + "/"), "slug")),
        F.when(F.col("kind").isin(*_PATH_KINDS), P.route_key(F.col("path"))),
    ))
    return docs.select("kind", "id", F.explode(F.array_distinct(keys)).alias("route"))


def live_routes(docs: DataFrame) -> DataFrame:
    """Distinct routes with content, fixed sections and the home page."""
    fixed = docs.sparkSession.createDataFrame([(name,) for name in [*K.FIXED_SECTIONS, *K.APP_EXACT]], "route string")
    return routes_of(docs.where("published")).select("route").unionByName(fixed).distinct()


def record_canonicals(docs: DataFrame) -> DataFrame:
    """(kind, id, canonical) of published records."""
    built = (
        F.when(F.col("kind").isin(*_SLUG_KINDS), F.concat(F.lit("/"), "slug", F.lit(".html")))
        .when(F.col("kind") == "course", F.concat(F.lit(f"/{K.COURSE_PREFIX}/"), "slug", F.lit(".html")))
        .otherwise(P.content_href(F.col("path")))
    )
    return docs.where("published").select("kind", "id", P.public_seo_path(P.canonical_path(built, F.col("legacy_path"))).alias("canonical"))


def route_index(docs: DataFrame) -> DataFrame:
    """key -> (step, kind_rank, id, kind, legacy): the winner of every lookup key."""
    kind_rank = F.array_position(F.array(*[F.lit(kind) for kind in K.KIND_ORDER]), F.col("kind"))
    key = lambda mark, step, value: F.when(value.isNotNull() & (value != ""), F.struct(F.concat(F.lit(mark + "|"), value).alias("key"), F.lit(step).alias("step")))
    keys = F.array_compact(F.array(
        key("L", 1, F.col("legacy_path")),
        F.when(F.col("kind") == "page", key("F", 0, F.col("legacy_path"))),
        F.when(F.col("kind") == "course", key("C", 2, F.col("slug"))),
        F.when(F.col("kind").isin(*_SLUG_KINDS), key("S", 3, F.col("slug"))),
        F.when(F.col("kind").isin(*_PATH_KINDS), key("P", 3, F.col("path"))),
    ))
    rows = docs.where("published").select(F.explode(keys).alias("k"), kind_rank.alias("kind_rank"), "id", "kind", "legacy_path")
    winner = F.min(F.struct("k.step", "kind_rank", "id", "kind", "legacy_path")).alias("hit")
    return rows.groupBy(F.col("k.key").alias("key")).agg(winner)


def resolve_addresses(raws: DataFrame, index: DataFrame) -> DataFrame:
    """raws(raw): address as sent, without outer slashes -> (raw, requested, kind, id, section_legacy).
    kind is null when nothing is served there, 'fixed' for a section (section names it)."""
    parsed = raws.select("raw").distinct().withColumn("n", P.normalize_segments(F.col("raw"))).where("n is not null")
    parsed = parsed.withColumn("section", P.fixed_section(F.col("n.path")))
    legacy = P.legacy_candidates(F.col("raw"), F.col("n.requested"))
    mark = lambda name, items: F.transform(items, lambda item: F.concat(F.lit(name + "|"), item))
    course = (F.col("n.segments")[0] == K.COURSE_PREFIX) & (F.size("n.segments") == 2)
    none = F.array().cast("array<string>")
    by_section = mark("F", P.with_slash(F.concat(legacy, F.array(F.concat(F.lit("/"), "n.path"), F.concat(F.lit("/"), F.col("n.path"), F.lit(".html"))))))
    by_record = F.concat(
        mark("L", P.with_slash(legacy)),
        F.when(course, F.array(F.concat(F.lit("C|"), F.element_at("n.segments", -1)))).otherwise(none),
        F.array(F.concat(F.lit("S|"), F.col("n.path"))),
        mark("P", P.path_candidates(F.col("n.path"))),
    )
    keys = F.array_distinct(F.when(F.col("section").isNotNull(), by_section).otherwise(by_record))
    # used twice, so addresses are parsed once
    parsed = cut_lineage(parsed.select("raw", F.col("n.requested").alias("requested"), "section", keys.alias("keys")))
    exploded = parsed.select("raw", F.explode("keys").alias("key"))
    best = exploded.join(index, "key").groupBy("raw").agg(F.min("hit").alias("hit"))
    found = parsed.select("raw", "requested", "section").join(best, "raw", "left")
    is_fixed = F.col("section").isNotNull()
    return found.select(
        "raw", "requested", "section",
        F.when(is_fixed, F.lit("fixed")).otherwise(F.col("hit.kind")).alias("kind"),
        F.when(~is_fixed, F.col("hit.id")).alias("id"),
        F.when(is_fixed, F.col("hit.legacy_path")).alias("section_legacy"),
    )


def with_canonical(resolved: DataFrame, docs: DataFrame) -> DataFrame:
    """Adds canonical: the record's own address, or the section's."""
    joined = resolved.join(record_canonicals(docs), ["kind", "id"], "left")
    fixed = P.public_seo_path(P.canonical_path(P.section_path(F.col("section")), F.col("section_legacy")))
    return joined.withColumn("canonical", F.when(F.col("kind") == "fixed", fixed).otherwise(F.col("canonical")))


def _raw(path: Column) -> Column:
    return F.regexp_replace(path, r"\A/+|/+\z", "")


def confirm_canonicals(resolved: DataFrame, index: DataFrame) -> DataFrame:
    """Adds canonical_ok: the canonical address resolves to the same record or section."""
    asked = resolved.where("canonical is not null and canonical <> '/'").select(_raw(F.col("canonical")).alias("raw")).distinct()
    again = resolve_addresses(asked, index).select(
        F.col("raw").alias("_c"), F.col("kind").alias("_kind"), F.col("id").alias("_id"), F.col("section").alias("_section")
    )
    joined = resolved.withColumn("_c", _raw(F.col("canonical"))).join(again, "_c", "left")
    same = (F.col("kind") == F.col("_kind")) & F.col("id").eqNullSafe(F.col("_id")) & F.col("section").eqNullSafe(F.col("_section"))
    return joined.withColumn("canonical_ok", (F.col("canonical") == "/") | F.coalesce(same, F.lit(False))).drop("_c", "_kind", "_id", "_section")


# ------------------------------------------------------------------ redirects

def public_redirects(redirects: DataFrame, live: DataFrame) -> DataFrame:
    """Published redirects that may act: own target, not itself, nothing live at the source."""
    to = F.trim("dst")
    ok = to.rlike(r"\A/(?![/\\])") & ~to.rlike(r"[\\\x00-\x1F]") & (P.route_key(to) != P.route_key(F.col("src")))
    guarded = redirects.where("published").where(ok).withColumn("route", P.route_key(F.col("src")))
    return guarded.join(live.select("route").distinct(), "route", "left_anti").drop("route")


def redirect_lookup(addresses: DataFrame, redirects: DataFrame) -> DataFrame:
    """addresses(raw_path, path) -> (raw_path, redirect_id, to) by any of four spellings, lowest id."""
    best = redirects.where("published").groupBy(F.col("src").alias("key")).agg(F.min(F.struct("id", "dst")).alias("hit"))
    slash = lambda c: F.concat(c, F.lit("/"))
    keys = F.array_distinct(F.array(F.col("raw_path"), F.col("path"), slash(F.col("raw_path")), slash(F.col("path"))))
    exploded = addresses.select("raw_path", F.explode(keys).alias("key"))
    found = exploded.join(best, "key").groupBy("raw_path").agg(F.min("hit").alias("hit"))
    return found.select("raw_path", F.col("hit.id").alias("redirect_id"), F.col("hit.dst").alias("to"))


def captured_redirects(captures: DataFrame, live: DataFrame, hosts: Sequence[str] | None = None, host_pattern: str | None = None) -> tuple[DataFrame, DataFrame]:
    """captures(url, final_url) -> (route -> final route, issues(code, source)).

    Only plain own addresses count; several targets for one source, captured content at the source
    and loops are reported and not followed. Chains over 20 hops are followed to their end and reported."""
    moved = captures.where("final_url is not null and final_url <> url")
    pairs = moved.select(
        "url", P.plain_own_path(F.col("url"), hosts, host_pattern).alias("source"), P.plain_own_path(F.col("final_url"), hosts, host_pattern).alias("target")
    )
    pairs = cut_lineage(pairs)  # for the rejected and the rest
    rejected = pairs.where("source is null or target is null").select(F.lit("captured-redirect-rejected").alias("code"), P.public_url(F.col("url")).alias("source"))
    edges = pairs.where("source is not null and target is not null").select(
        P.route_key(F.col("source")).alias("src"), P.route_key(F.col("target")).alias("dst"), "source"
    ).where("src <> dst")
    per_source = cut_lineage(edges.groupBy("src").agg(F.min("dst").alias("dst"), F.max("dst").alias("other"), F.min("source").alias("source")))
    conflict = per_source.where("dst <> other").select(F.lit("captured-redirect-conflict").alias("code"), "source")
    single = per_source.where("dst = other").select("src", "dst", "source")
    routes = live.select(F.col("route").alias("src")).distinct()
    shadowed = single.join(routes, "src", "left_semi").select(F.lit("captured-redirect-shadowed").alias("code"), "source")
    hops = single.join(routes, "src", "left_anti")
    walked = chain_ends(hops.select("src", "dst"))
    code = F.when(F.col("cycle"), F.lit("captured-redirect-cycle")).when(F.col("hops") > K.MAX_HOPS, F.lit("captured-redirect-too-long"))
    cycles = walked.withColumn("code", code).where("code is not null").join(hops.select("src", "source"), "src").select("code", "source")
    resolved = walked.where("not cycle").select("src", "final")
    return resolved, rejected.unionByName(conflict).unionByName(shadowed).unionByName(cycles)


def redirect_rules_from_captures(captures: DataFrame, live: DataFrame, stored: DataFrame) -> DataFrame:
    """captures(source, target) safe paths, live(route), stored redirects(src, dst) -> verdict per source:
    a new rule, nothing to do, or one of the issue codes."""
    pairs = captures.withColumn("route", P.route_key(F.col("source"))).where(F.col("route") != P.route_key(F.col("target")))
    per = pairs.groupBy("source", "route").agg(F.min("target").alias("target"), F.max("target").alias("other"))
    alive = live.select("route").distinct()
    edges = stored.select(P.route_key(F.col("src")).alias("src"), P.route_key(F.col("dst")).alias("dst")).groupBy("src").agg(F.min("dst").alias("dst"))
    hops = edges.join(alive.select(F.col("route").alias("src")), "src", "left_anti")
    ends = chain_ends(hops).select("src", F.col("final").alias("end"))
    ends = ends.join(alive.select(F.col("route").alias("end"), F.lit(True).alias("_live")), "end", "left").where("_live").select("src", "end")
    mark = alive.withColumn("_t_live", F.lit(True))
    goal = per.withColumn("t_route", P.route_key(F.col("target"))).join(mark.withColumnRenamed("route", "t_route"), "t_route", "left")
    goal = goal.join(ends.select(F.col("src").alias("t_route"), F.col("end").alias("t_end")), "t_route", "left")
    goal = goal.withColumn("final", F.when(F.col("_t_live"), F.col("t_route")).otherwise(F.col("t_end")))
    goal = goal.join(alive.withColumn("_s_live", F.lit(True)), "route", "left")
    goal = goal.join(edges.select(F.col("src").alias("route"), F.col("dst").alias("s_dst")), "route", "left")
    goal = goal.join(ends.select(F.col("src").alias("route"), F.col("end").alias("s_end")), "route", "left")
    verdict = (
        F.when(F.col("target") != F.col("other"), F.lit("source-http-redirect-conflict"))
        .when(F.col("final").isNull(), F.lit("source-http-redirect-target-unresolved"))
        .when(F.col("final").isin(*K.APP_EXACT), F.lit("source-http-redirect-home-review"))
        .when(F.col("route").isin("index", "index.php") | F.split("route", "/")[0].isin(*K.APP_SEGMENTS), F.lit("source-http-redirect-app-route"))
        .when(F.col("_s_live"), F.lit("source-http-redirect-shadowed"))
        .when(F.col("s_dst").isNotNull() & ~F.col("s_end").eqNullSafe(F.col("final")), F.lit("source-http-redirect-conflict"))
        .when(F.col("s_dst").isNotNull(), F.lit("already-stored"))
        .otherwise(F.lit("new-rule"))
    )
    return goal.select("source", verdict.alias("verdict"), F.when(verdict == "new-rule", F.col("final")).alias("to_route"))


def unapproved_redirects(bundled: DataFrame, approved: DataFrame) -> DataFrame:
    """bundled and approved(from_path, to_path) -> bundled redirects that no approved rule names exactly."""
    return bundled.join(approved.select("from_path", "to_path").distinct(), ["from_path", "to_path"], "left_anti")


# ------------------------------------------------------------------ migration map

_BENIGN = ["served-alias-canonical-elsewhere", "stored-redirect-shadowed-by-published-content"]
# --- fixed values: account and private areas of the source, and its stored documents
_ACCOUNT = r"(?i)\A/(?:account(?:\.html)?|logowanie|component/(?:user|users))(?:/|\z)"
_PRIVATE = r"(?i)\A/(?:api|admin|administrator|koszyk|checkout|cart|newsletter|zgloszenie|platnosc-testowa|_next)(?:/|\.|\z)"
_DOCUMENT_URL = r"\A(?:https?://[^/?#]+)?/api/documents/file/[a-f0-9]{64}(?:-[0-9]+)?\.pdf\z"


def _classified_nodes(paths: DataFrame, docs: DataFrame, redirects: DataFrame, documents: DataFrame | None) -> DataFrame:
    """paths(raw_path) -> what the site does at each distinct address, and its next address."""
    index = cut_lineage(route_index(docs))
    # used three times, so addresses are decoded once
    nodes = cut_lineage(paths.select("raw_path").distinct().withColumn("path", P.decoded_request(F.col("raw_path"))))
    # used twice (as it is, and to look its canonical addresses up again), so it is computed once
    resolved = cut_lineage(with_canonical(resolve_addresses(nodes.select(_raw(F.col("raw_path")).alias("raw")), index), docs))
    resolved = confirm_canonicals(resolved, index)
    keyed = nodes.withColumn("raw", _raw(F.col("raw_path"))).join(resolved.drop("requested", "section_legacy"), "raw", "left").drop("raw")
    keyed = keyed.join(redirect_lookup(nodes.where("path is not null"), redirects), "raw_path", "left")
    if documents is None:
        keyed = keyed.withColumn("document_id", F.lit(None).cast("long"))
    else:
        usable = documents.where(F.col("url").rlike(_DOCUMENT_URL)).groupBy(nfc(F.col("legacy_path")).alias("path")).agg(F.max("id").alias("document_id"))
        keyed = keyed.join(usable, "path", "left")
    role = (
        F.when(F.col("path").isNull(), F.lit("unsafe"))
        .when(F.col("path") == "/", F.lit("home"))
        .when(F.col("path") == "/index.php", F.lit("index"))
        .when(F.col("document_id").isNotNull(), F.lit("document"))
        .when(P.is_app_route(F.regexp_replace(F.substr("path", F.lit(2)), r"(?i)\.html\z", "")), F.lit("application"))
        .when(F.col("kind").isNotNull(), F.lit("live"))
        .when(F.col("to").isNull(), F.lit("none"))
        .when(P.public_seo_path(F.col("to")).isNull(), F.lit("unsafe-target"))
        .otherwise(F.lit("redirect"))
    )
    following = F.when(F.col("role") == "index", F.lit("/")).when(F.col("role") == "redirect", F.col("to"))
    return cut_lineage(keyed.withColumn("role", role).withColumn("next", following))


def migration_map(crawl: DataFrame, docs: DataFrame, redirects: DataFrame, documents: DataFrame | None = None,
                  hosts: Sequence[str] | None = None, host_pattern: str | None = None) -> DataFrame:
    """crawl(url, final_url, capture_state, position), docs(kind, id, legacy_path, slug, path,
    published), redirects(id, published, src, dst), documents(id, legacy_path, url) -> one row per old
    address: what it becomes, why, and what needs review."""
    rows = preferred_captures(crawl).drop("rows", "position")
    url = P.url_parts(F.col("url"))
    raw_path = let(url, lambda u: F.when(
        (u["scheme"] == "https") & (u["port"] == "") & ~u["has_user"] & (u["fragment"] == "") & P._is_own_host(u["host"], hosts, host_pattern),
        F.struct(F.coalesce(F.nullif(u["path"], F.lit("")), F.lit("/")).alias("path"), (u["query"] != "").alias("query")),
    ))
    rows = rows.withColumn("u", raw_path).withColumn("raw_path", F.col("u.path")).withColumn("old_path", P.decoded_request(F.col("u.path")))
    early = (
        F.when(F.col("old_path").isNull(), F.lit("outside-safe-source-url-scope"))
        .when(F.col("u.query"), F.lit("source-query-needs-explicit-route-mapping"))
        .when(F.col("old_path").rlike(_ACCOUNT), F.lit("legacy-account-needs-source-database"))
        .when(F.col("old_path").rlike(_PRIVATE), F.lit("private-or-application-route-needs-review"))
    )
    rows = cut_lineage(rows.withColumn("early", early).drop("u"))  # the nodes and the map's rows

    starts = rows.where("early is null").select("raw_path")
    targets = redirects.where("published").select(F.col("dst").alias("raw_path"))
    home = crawl.sparkSession.range(1).select(F.lit("/").alias("raw_path"))
    nodes = _classified_nodes(starts.unionByName(targets).unionByName(home), docs, redirects, documents)

    chains = chain_walks(nodes.where("next is not null").select(F.col("raw_path").alias("src"), F.col("next").alias("dst")))
    walked = chains.select(
        F.col("src").alias("raw_path"), F.when(F.col("loop"), F.lit("redirect-loop")).alias("broken"),
        (~F.col("loop") & (F.col("hops") > K.MAX_HOPS)).alias("too_long"), F.col("hops").cast("int").alias("hops"), "end",
    )
    own = nodes.select("raw_path", F.col("redirect_id").alias("own_redirect"))
    ends = nodes.select(
        F.col("raw_path").alias("end"), F.col("path").alias("end_path"), "role", "kind",
        F.coalesce("document_id", "id").alias("record_id"), "canonical", "canonical_ok",
    )
    state = rows.join(walked, "raw_path", "left").withColumn("hops", F.coalesce("hops", F.lit(0))).withColumn("end", F.coalesce("end", "raw_path"))
    state = state.join(own, "raw_path", "left").join(ends, "end", "left")

    reached = F.col("early").isNull() & F.col("broken").isNull() & F.col("role").isin("home", "document", "live")
    special = F.col("role").isin("home", "document")
    canonical = F.when(reached, F.when(special, F.col("end_path")).otherwise(F.col("canonical")))
    state = state.withColumn("reached", reached).withColumn("canonical_path", canonical)
    is_live = F.col("reached") & (F.col("role") == "live")
    elsewhere = F.col("reached") & ~F.coalesce(F.col("canonical_path") == F.col("end_path"), F.lit(False))
    moved = F.col("hops") > 0
    issue = lambda condition, code: F.when(condition, F.lit(code) if isinstance(code, str) else code)
    safe = F.col("early").isNull()
    issues = F.array_compact(F.array(
        issue((safe | F.col("early").startswith("legacy-account") | F.col("early").startswith("private-or")) & ~F.col("capture_state").isin("captured", "document"), F.concat(F.lit("source-capture-"), F.col("capture_state"))),
        issue(safe, F.col("broken")),
        issue(safe & F.col("too_long"), "redirect-chain-too-long"),
        issue(safe & F.col("broken").isNull() & F.col("role").isin("unsafe", "unsafe-target"), "unsafe-redirect-target"),
        issue(safe & F.col("broken").isNull() & (F.col("role") == "application"), "application-route-destination"),
        issue(is_live & F.col("canonical_path").isNull(), "invalid-public-canonical"),
        issue(is_live & F.col("canonical_path").isNotNull() & ~F.col("canonical_ok"), "canonical-does-not-resolve-to-same-record"),
        issue(F.col("reached") & (F.col("hops") > 1), "existing-redirect-chain-needs-flattening"),
        issue(elsewhere & moved, "redirect-target-canonical-elsewhere"),
        issue(F.col("reached") & ~moved & F.col("own_redirect").isNotNull(), "stored-redirect-shadowed-by-published-content"),
        issue(elsewhere & ~moved, "served-alias-canonical-elsewhere"),
    ))
    state = state.withColumn("issues", issues)
    hard = F.exists("issues", lambda i: ~i.isin(*_BENIGN))
    beyond_capture = F.exists("issues", lambda i: ~i.startswith("source-capture-"))
    disposition = (
        F.when(F.col("early").isNotNull(), F.lit("review"))
        .when(~F.col("reached"), F.when(F.size("issues") > 0, F.lit("review")).otherwise(F.lit("unresolved404")))
        .when(hard, F.lit("review"))
        .when(moved, F.lit("redirect301"))
        .otherwise(F.lit("retained200"))
    )
    status = (
        F.when(F.col("early") == "legacy-account-needs-source-database", F.lit(404))
        .when(F.col("early").isNotNull(), F.lit(None).cast("int"))
        .when(~F.col("reached"), F.when(~beyond_capture, F.lit(404)))
        .when(moved, F.lit(301))
        .otherwise(F.lit(200))
    )
    reason = (
        F.when(F.col("early").isNotNull(), F.col("early"))
        .when(~F.col("reached"), F.when(moved, F.lit("stored-redirect-destination-unresolved")).otherwise(F.lit("no-published-destination")))
        .when(moved, F.lit("verified-permanent-route-to-published-destination"))
        .when(F.col("role") == "document", F.lit("source-pdf-kept-at-original-path"))
        .otherwise(F.lit("source-path-served-without-redirect"))
    )
    result = state.select(
        F.col("url").alias("old_url"), "old_path", F.when(F.col("reached"), F.col("end_path")).alias("new_path"), disposition.alias("disposition"),
        status.alias("current_status"), "canonical_path",
        F.when(F.col("reached"), F.when(special, F.col("role")).otherwise(F.col("kind"))).alias("resolved_kind"),
        F.when(F.col("reached"), F.col("record_id")).alias("record_id"),
        F.when(safe, F.col("hops")).otherwise(F.lit(0)).alias("redirect_hops"), F.col("final_url").alias("captured_final_url"), "capture_state", reason.alias("reason"), "issues",
    )
    return _mark_conflicting_rules(result)


def _mark_conflicting_rules(rows: DataFrame) -> DataFrame:
    """Spellings of one old path that would redirect to different places all go to review."""
    rows = cut_lineage(rows)  # asked for the clashes and joined with them
    clash = rows.where("disposition = 'redirect301'").groupBy("old_path").agg((F.min("new_path") != F.max("new_path")).alias("clash")).where("clash")
    joined = rows.join(clash, "old_path", "left")
    hit = F.col("clash").isNotNull() & (F.col("disposition") == "redirect301")
    return joined.withColumn("issues", F.when(hit, F.concat("issues", F.array(F.lit("conflicting-normalized-redirect-rules")))).otherwise(F.col("issues"))).withColumn(
        "disposition", F.when(hit, F.lit("review")).otherwise(F.col("disposition"))
    ).select(*rows.columns)


def disposition_counts(rows: DataFrame) -> DataFrame:
    """Counts per disposition; the ones without rows stay with zero."""
    wanted = rows.sparkSession.createDataFrame([(name,) for name in K.DISPOSITIONS], "disposition string")
    counted = rows.groupBy("disposition").agg(F.count("*").alias("n"))
    return wanted.join(counted, "disposition", "left").select("disposition", F.coalesce("n", F.lit(0)).alias("n"))


def redirect_rules(rows: DataFrame) -> DataFrame:
    """Unique (from_path, to_path) rules of the map."""
    return rows.where("disposition = 'redirect301'").select(F.col("old_path").alias("from_path"), F.col("new_path").alias("to_path"), F.lit(301).alias("status")).distinct()


def migration_proposals(rows: DataFrame, known: DataFrame | None = None, hosts: Sequence[str] | None = None, host_pattern: str | None = None) -> DataFrame:
    """Unresolved captured addresses whose exact captured target is a published canonical address."""
    pool = rows if known is None else rows.unionByName(known)
    good = pool.where("old_path is not null and disposition in ('retained200', 'redirect301') and canonical_path = new_path")
    targets = good.groupBy(F.col("old_path").alias("final_path")).agg(F.max(F.struct("new_path", "resolved_kind")).alias("t"))
    final = let(P.url_parts(F.col("captured_final_url")), lambda u: F.when(
        (u["scheme"] == "https") & (u["port"] == "") & ~u["has_user"] & (u["query"] == "") & (u["fragment"] == "") & P._is_own_host(u["host"], hosts, host_pattern), u["path"]
    ))
    open_rows = rows.where("disposition = 'unresolved404' and capture_state = 'captured' and old_path is not null").withColumn("final_path", P.decoded_request(final))
    joined = open_rows.join(targets, "final_path").where("t.new_path <> old_path").where(P.public_seo_path(F.col("t.new_path")).isNotNull())
    return joined.select(F.col("old_path").alias("from_path"), F.col("t.new_path").alias("to_path"), F.col("t.resolved_kind").alias("target_kind"))


def rule_audit(redirects: DataFrame, audited: DataFrame) -> DataFrame:
    """redirects(id, published, src, dst), audited: migration rows of their sources with rule_url ->
    verdict per published rule: ok or a blocking code."""
    rules = redirects.where("published").withColumn("key", F.when(F.col("src") == "/index.php", F.col("src")).otherwise(P.public_seo_path(F.col("src")))).withColumn("to", P.public_seo_path(F.col("dst")))
    safe = rules.where("key is not null and to is not null")
    groups = safe.groupBy("key").agg(F.count("*").alias("n"), (F.min("to") != F.max("to")).alias("clash"))
    rows = audited.select(F.col("rule_url"), "disposition", "redirect_hops", "new_path", "canonical_path", "issues")
    joined = rules.join(groups, "key", "left").join(rows, "rule_url", "left")
    direct = (
        (F.col("disposition") == "redirect301") & (F.col("redirect_hops") == 1) & (F.col("new_path") == F.col("to"))
        & (F.col("new_path") == F.col("canonical_path")) & (F.size("issues") == 0)
    )
    verdict = (
        F.when(F.col("key").isNull() | F.col("to").isNull(), F.lit("unsafe-published-rule"))
        .when(F.col("clash"), F.lit("conflicting-rule-destinations"))
        .when(F.col("n") > 1, F.lit("duplicate-rule-key"))
        .when(~F.coalesce(direct, F.lit(False)), F.lit("published-rule-not-direct-canonical-301"))
        .otherwise(F.lit("ok"))
    )
    return joined.select("id", verdict.alias("verdict"))


def decision_register(rows: DataFrame, issues: DataFrame) -> DataFrame:
    """Open rows with their primary cause (most specific known code of the address) and the evidence
    they need. issues(url, code)."""
    order = F.array(*[F.lit(code) for code in K.DECISION_CAUSES])
    rank = F.array_position(order, F.col("code"))
    causes = issues.where(F.col("code").rlike(r"\A[a-z0-9-]{1,100}\z")).groupBy(F.col("url").alias("old_url")).agg(
        F.min(F.when(rank > 0, rank)).alias("cause"), F.count_distinct("code").alias("issue_codes")
    )
    joined = rows.where("disposition in ('unresolved404', 'review')").join(causes, "old_url", "left")
    evidence = (
        F.when(F.col("reason").contains("account"), F.lit("current-source-database-and-account-continuity-decision"))
        .when(F.col("capture_state") != "captured", F.lit("retained-source-or-current-source-database"))
        .otherwise(F.lit("current-source-database-or-exact-retained-source-evidence"))
    )
    return joined.select(
        "old_url", "disposition", "reason", F.coalesce(F.try_element_at(order, F.col("cause").cast("int")), F.col("reason")).alias("primary_cause"),
        F.coalesce("issue_codes", F.lit(0)).alias("issue_codes"), evidence.alias("required_evidence"),
    )


def coverage(crawl: DataFrame, rows: DataFrame, audit: DataFrame, sitemap_issues: DataFrame) -> DataFrame:
    """One row of totals and gates for the whole migration."""
    row = one_row({
        "input_rows": crawl, "unique_urls": rows, **{name: rows.where(F.col("disposition") == name) for name in K.DISPOSITIONS},
        "published_rules": audit, "verified_rules": audit.where("verdict = 'ok'"), "sitemap_issues": sitemap_issues,
    })
    blocking = (F.col("published_rules") - F.col("verified_rules") + F.col("sitemap_issues")) > 0
    return row.withColumn("duplicate_urls", F.col("input_rows") - F.col("unique_urls")).withColumn("preview_ready", ~blocking)


# ------------------------------------------------------------------ sitemap

def sitemap_paths(docs: DataFrame) -> DataFrame:
    """One canonical path per reachable record, kept only when it resolves back to the record."""
    spark = docs.sparkSession
    index = cut_lineage(route_index(docs))
    sections = [*K.SECTION_PATHS.values(), *[f"/{name}.html" for name in K.FIXED_SECTIONS]]
    fixed = spark.createDataFrame([(path,) for path in sections], "canonical string")
    candidates = record_canonicals(docs).select("canonical").unionByName(fixed).where("canonical is not null and canonical <> '/'").distinct()
    resolved = cut_lineage(with_canonical(resolve_addresses(candidates.select(_raw(F.col("canonical")).alias("raw")), index).where("kind is not null"), docs))
    confirmed = confirm_canonicals(resolved, index).where("canonical_ok and canonical is not null")
    home = spark.range(1).select(F.lit("/").alias("path"))
    return confirmed.select(F.col("canonical").alias("path")).unionByName(home).distinct()


def sitemap_audit(paths: DataFrame, rows: DataFrame) -> DataFrame:
    """Sitemap paths that the map does not keep as canonical addresses."""
    good = rows.where("disposition = 'retained200' and new_path = canonical_path and size(issues) = 0").select(F.col("old_path").alias("path")).distinct()
    return paths.join(good, "path", "left_anti").select("path", F.lit("sitemap-not-public-canonical-200").alias("code"))


def sitemap_entries(paths: DataFrame, origin: str) -> DataFrame:
    """(url, entry): escaped XML elements of distinct absolute addresses."""
    urls = paths.select(seo_url(F.col("path"), origin).alias("url")).where("url is not null").distinct()
    return urls.withColumn("entry", F.concat(F.lit("  <url><loc>"), xml_escape(F.col("url")), F.lit("</loc></url>")))


def imported_routes(docs: DataFrame) -> DataFrame:
    """One address per published record to check; private areas are marked as skipped."""
    path = F.coalesce(F.nullif(F.col("legacy_path"), F.lit("")), P.content_href(F.coalesce("path", "slug")))
    private = path.rlike(r"(?i)\A/(?:component|administrator|account)(?:/|\z)")
    return docs.where("published").select("kind", "id", path.alias("path"), F.when(private, F.lit("skipped")).otherwise(F.lit("check")).alias("status"))
