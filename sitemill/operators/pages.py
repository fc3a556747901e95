"""Captured pages: acceptance, copies, addresses, claims and candidate identity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sitemill import constants as K
from sitemill.functions import paths as P
from sitemill.functions.unicode import nfc, text_problem
from sitemill.operators.graph import cascade_drop
from sitemill.session import cut_lineage

# charsets whose bytes Spark can reproduce, with the characters each one can hold
_CHARSETS = {"utf-8": None, "utf8": None, "iso-8859-1": r"[^\x00-\xFF]", "latin-1": r"[^\x00-\xFF]", "us-ascii": r"[^\x00-\x7F]", "ascii": r"[^\x00-\x7F]"}
_SPARK_NAMES = {"utf8": "utf-8", "latin-1": "iso-8859-1", "ascii": "us-ascii"}


def content_digest(html: Column, charset: Column | None = None) -> Column:
    """sha256 of the page in its own charset; null when it cannot be written in it."""
    if charset is None:
        return F.sha2(F.encode(html, "utf-8"), 256)
    name = F.lower(F.coalesce(charset, F.lit("utf-8")))
    digest = None
    for label, beyond in _CHARSETS.items():
        fits = (name == label) if beyond is None else (name == label) & ~html.rlike(beyond)
        value = F.sha2(F.encode(html, _SPARK_NAMES.get(label, label)), 256)
        digest = F.when(fits, value) if digest is None else digest.when(fits, value)
    return digest


def public_scope(url: Column, hosts: Sequence[str] | None = None, host_pattern: str | None = None) -> Column:
    """https, own host, default port, no query or credentials."""
    parts = P.url_parts(url)
    ok = (parts["scheme"] == "https") & parts["port"].isin("", "443") & (parts["query"] == "") & ~parts["has_user"]
    return F.coalesce(ok & P._is_own_host(parts["host"], hosts, host_pattern), F.lit(False))


def calendar_navigation(path: Column) -> Column:
    """Day, month and year navigation forms an endless graph; concrete event details stay."""
    low = F.lower(path)
    detail = low.rlike(r"\A/kalendarz/eventdetail/[0-9]+/-/[^/]+\.html\z")
    return low.startswith("/component/jevents/") | (low.startswith("/kalendarz/") & ~detail)


def judge_pages(pages: DataFrame, hosts: Sequence[str] | None = None, host_pattern: str | None = None) -> DataFrame:
    """pages(url, html, sha256[, charset]) -> adds path and reject_code (null means accepted)."""
    charset = F.col("charset") if "charset" in pages.columns else None
    digest = content_digest(F.col("html"), charset)
    valid = F.col("url").isNotNull() & F.col("html").isNotNull() & F.coalesce(F.col("sha256").rlike(r"\A[a-f0-9]{64}\z"), F.lit(False))
    path = P.site_path(F.col("url"), hosts, host_pattern)
    code = (
        F.when(~valid, F.lit("invalid-page-record"))
        .when(digest.isNull() | (digest != F.col("sha256")), F.lit("integrity-mismatch"))
        .when(F.col("path").isNull(), F.lit("out-of-scope-url"))
    )
    return pages.withColumn("path", path).withColumn("reject_code", code)


def distinct_captures(judged: DataFrame) -> DataFrame:
    """One row per (path, sha256): the lowest address stands for all copies. The page text is not
    shuffled, and copies are merged before the shuffle."""
    return (
        judged.where("reject_code is null")
        .groupBy("path", "sha256")
        .agg(F.min_by("page_id", F.struct("url", "page_id")).alias("page_id"), F.min("url").alias("url"), F.count("*").alias("captures"))
    )


def preferred_addresses(pages: DataFrame, group: Sequence[str]) -> DataFrame:
    """pages(group..., path[, hint]) -> preferred path per group: the hint when it is the only one
    among the group's paths, else the shortest, then lexical. Also the preferred spelling."""
    hint = F.col("hint") if "hint" in pages.columns else F.lit(None).cast("string")
    per_path = pages.withColumn("_hint", hint).groupBy(*group, "path").agg(
        F.min("_hint").alias("_low"), F.max("_hint").alias("_high"), F.count("*").alias("_rows")
    )
    spelling = F.struct((~F.lower(F.col("path")).endswith(".html")).alias("plain"), F.col("path").alias("path"))
    grouped = per_path.groupBy(*group).agg(
        F.min(F.struct(F.length("path").alias("size"), F.col("path").alias("path")))["path"].alias("shortest"),
        F.min(spelling)["path"].alias("spelling"),
        F.count("*").alias("paths"),
        F.sum("_rows").alias("rows"),
        F.min("_low").alias("_low"),
        F.max("_high").alias("_high"),
    )
    if "hint" not in pages.columns:
        return grouped.select(*group, F.col("shortest").alias("preferred"), "spelling", "paths", "rows")
    # only a hint that is itself one of the group's paths counts, and only when it is the single one
    among = per_path.select(*group, F.col("path").alias("_hint")).join(
        pages.where("hint is not null").select(*group, F.col("hint").alias("_hint")).distinct(), [*group, "_hint"], "left_semi"
    )
    single = among.groupBy(*group).agg(F.min("_hint").alias("_only"), F.count("*").alias("_hints")).where("_hints = 1")
    joined = grouped.join(single.select(*group, "_only"), list(group), "left")
    return joined.select(*group, F.coalesce("_only", "shortest").alias("preferred"), "spelling", "paths", "rows")


def claim_conflicts(claims: DataFrame) -> DataFrame:
    """claims(claim, owner) -> claims held by more than one owner. Min and max owner decide, so no
    set of owners is built; owners counts rows of distinct owners."""
    distinct = claims.select("claim", "owner").distinct()
    return distinct.groupBy("claim").agg(F.count("*").alias("owners"), F.min("owner").alias("first_owner"), F.max("owner").alias("last_owner")).where(
        "owners > 1"
    )


def conflict_cascade(claims: DataFrame, needs: DataFrame, ids: DataFrame) -> DataFrame:
    """claims(claim, owner), needs(id, needs_id), ids(id) -> dropped ids with a reason.

    Every claimant of a contested claim is dropped, then every record that needs a dropped or
    missing one, until nothing changes. Drops never create new conflicts, so conflicts are found
    once and only the newest drops are followed."""
    contested = claims.groupBy("claim").agg((F.min("owner") != F.max("owner")).alias("clash")).where("clash").select("claim")
    conflict = claims.join(contested, "claim", "left_semi").select(F.col("owner").alias("id")).distinct()
    missing = needs.join(ids.select(F.col("id").alias("needs_id")), "needs_id", "left_anti").select("id").distinct()
    dropped = cascade_drop(conflict.unionByName(missing), needs)
    return dropped.join(conflict.withColumn("_hit", F.lit(True)), "id", "left").select(
        "id", F.when(F.col("_hit"), F.lit("conflict")).otherwise(F.lit("dependency")).alias("reason")
    )


def merge_candidates(candidates: DataFrame) -> DataFrame:
    """candidates(collection, key, path, fingerprint, seo) -> one verdict per identity.

    Equal content merges; different content, or different metadata of one address, drops the whole
    group. Two map-side combined aggregations: a group of copies never meets in one task."""
    per_path = candidates.groupBy("collection", "key", "path").agg(
        F.min("fingerprint").alias("fp_low"), F.max("fingerprint").alias("fp_high"),
        (F.min("seo") != F.max("seo")).alias("seo_clash"), F.count("*").alias("rows"),
    )
    merged = per_path.groupBy("collection", "key").agg(
        (F.min("fp_low") != F.max("fp_high")).alias("clash"),
        F.max("seo_clash").alias("seo_clash"),
        F.sum("rows").alias("candidates"),
        F.min(F.struct(F.length("path").alias("size"), F.col("path").alias("path")))["path"].alias("primary_path"),
    )
    verdict = (
        F.when(F.col("clash"), F.lit("conflicting-source-content"))
        .when(F.col("seo_clash"), F.lit("conflicting-page-metadata"))
        .otherwise(F.lit("merged"))
    )
    return merged.select("collection", "key", "candidates", verdict.alias("verdict"), F.when(verdict == "merged", F.col("primary_path")).alias("primary_path"))


def alias_redirects(candidates: DataFrame) -> DataFrame:
    """One redirect per other address of a merged identity: (collection, key, from_path, to_path).
    Other spellings of one address share it; '.html' is kept first, then the shortest."""
    merged = merge_candidates(candidates).where("verdict = 'merged' and candidates > 1").select("collection", "key", "primary_path")
    routed = candidates.select("collection", "key", "path").withColumn("route", P.route_key(nfc(F.col("path"))))
    order = F.struct((~F.lower(F.col("path")).endswith(".html")).alias("plain"), F.length("path").alias("size"), F.col("path").alias("path"))
    aliases = routed.groupBy("collection", "key", "route").agg(F.min(order)["path"].alias("from_path"))
    joined = aliases.join(merged, ["collection", "key"]).where(F.col("route") != P.route_key(nfc(F.col("primary_path"))))
    return joined.select("collection", "key", "from_path", F.col("primary_path").alias("to_path"))


def frontier(links: DataFrame, seen: DataFrame, limit: int | None = None) -> DataFrame:
    """links(route), seen(route) -> unseen routes with how often they are linked. With a limit the
    routes beyond it are marked, none is lost: over_limit rows are the sample and the flag."""
    found = links.groupBy("route").agg(F.count("*").alias("links"))
    fresh = found.join(seen.select("route").distinct(), "route", "left_anti")
    if limit is None:
        return fresh
    first = fresh.orderBy("route").limit(limit).withColumn("over_limit", F.lit(False))
    rest = fresh.join(first.select("route"), "route", "left_anti").withColumn("over_limit", F.lit(True))
    return first.unionByName(rest)


# --- fixed values: how addresses of content sections begin
_CONTENT_FIRST = ["galeri", "kursy", "wypraw", "relacj", "aktualn", "kalendarz", "kontakt", "centrum", "regul", "polity", "serwis"]


def crawl_priority(path: Column) -> Column:
    """0 for content sections, 1 for the rest."""
    first = F.split(F.regexp_replace(F.lower(path), r"\A/+", ""), "/")[0]
    return F.when(first.rlike(r"\A(?:" + "|".join(_CONTENT_FIRST) + ")"), F.lit(0)).otherwise(F.lit(1))


def preferred_captures(addresses: DataFrame) -> DataFrame:
    """addresses(url, capture_state, position, ...) -> one row per exact address: the first captured
    row wins, without one the last row does."""
    captured = F.col("capture_state") == "captured"
    rank = F.struct((~captured).alias("other"), F.when(captured, F.col("position")).otherwise(-F.col("position")).alias("place"))
    rest = [name for name in addresses.columns if name != "url"]
    best = addresses.groupBy("url").agg(F.min_by(F.struct(*rest), rank).alias("row"), F.count("*").alias("rows"))
    return best.select("url", "row.*", "rows")


def issue_report(issues: DataFrame) -> DataFrame:
    """issues(code, url, key, detail) -> a set."""
    return issues.withColumn("detail", F.coalesce("detail", F.lit(""))).select("code", "url", "key", "detail").distinct()


def issue_order() -> list[Column]:
    """Deterministic report order; nulls sort as empty."""
    return [F.coalesce(F.col(name), F.lit("")) for name in ("code", "url", "key", "detail")]


def issue_counts(issues: DataFrame, code: str = "code") -> DataFrame:
    return issues.groupBy(F.col(code).alias("code")).agg(F.count("*").alias("n"))


def numbered_list(items: DataFrame, column: str) -> DataFrame:
    """All distinct items in order: (item, position). Positions are counted per range of the sorted items; only one
    row a range meets in one task."""
    ordered = items.select(F.col(column).alias("item")).distinct().orderBy("item").withColumn("_part", F.spark_partition_id())
    ordered = cut_lineage(ordered)
    sizes = ordered.groupBy("_part").agg(F.count("*").alias("_n"))
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy("_part").orderBy("item"))
    return ordered.join(sizes, "_part").select("item", (inside + F.col("_before")).alias("position"))


# ------------------------------------------------------------------ category observations

def category_rollup(seen: DataFrame) -> DataFrame:
    """seen(slug, name, path, parent, vm_id, url) -> one row per slug: winning name (most seen, ties
    by name), preferred path, the single parent and source id when all observations agree."""
    names = seen.where("name is not null").groupBy("slug", "name").agg(F.count("*").alias("votes"))
    voted = names.groupBy("slug").agg(
        F.min(F.struct((-F.col("votes")).alias("rank"), F.col("name").alias("name")))["name"].alias("name"), F.count("*").alias("names")
    )
    spelling = F.struct((~F.lower(F.col("path")).endswith(".html")).alias("plain"), F.col("path").alias("path"))
    facts = seen.groupBy("slug").agg(
        F.min(spelling)["path"].alias("legacy_path"),
        F.min("parent").alias("p_low"), F.max("parent").alias("p_high"), F.count_if(F.col("has_parent") & F.col("parent").isNull()).alias("p_roots"),
        F.min("vm_id").alias("id_low"), F.max("vm_id").alias("id_high"), F.min("url").alias("first_url"),
    )
    one_parent = F.col("p_low").eqNullSafe(F.col("p_high")) & ((F.col("p_roots") == 0) | F.col("p_low").isNull())
    return facts.join(voted, "slug", "left").select(
        "slug", "name", F.coalesce("names", F.lit(0)).alias("names"), "legacy_path", "first_url",
        F.when(one_parent, F.col("p_low")).alias("parent"), (~one_parent).alias("parent_conflict"),
        F.when(F.col("id_low") == F.col("id_high"), F.col("id_low")).alias("vm_id"), F.coalesce(F.col("id_low") != F.col("id_high"), F.lit(False)).alias("id_conflict"),
    )


# ------------------------------------------------------------------ limits on candidate text

def text_limit_issues(records: DataFrame, limits: dict[str, int], optional: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(records within limits, issues). A required text over its limit drops the row, an optional one
    becomes null; nothing is ever cut."""
    checks = F.array_compact(
        F.array(*[
            F.when(text_problem(F.col(name), size).isNotNull(), F.struct(
                F.lit("field-omitted" if name in optional else "field-invalid").alias("code"), F.lit(name).alias("field"),
                text_problem(F.col(name), size).alias("detail")))
            for name, size in limits.items()
        ])
    )
    marked = records.withColumn("_issues", checks)
    issues = marked.select("key", F.explode("_issues").alias("i")).select("key", "i.*")
    kept = marked.where(~F.exists("_issues", lambda i: i["code"] == "field-invalid"))
    for name in optional:
        kept = kept.withColumn(name, F.when(text_problem(F.col(name), limits[name]).isNull(), F.col(name)))
    return kept.drop("_issues"), issues
