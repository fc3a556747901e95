"""Change detection between an incoming batch and stored records, and its reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sitemill.functions.unicode import nfc

# --- fixed values: plan counters, zero ones included
ACTIONS = ["created", "updated", "unchanged", "preserved", "conflicts"]


def decide(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """incoming(key, source_hash), stored(key, stored_source_hash, stored_content_hash, content_hash)
    -> (key, action, reason). A record edited by staff (its content no longer matches the hash kept
    at the last write) is never overwritten."""
    joined = incoming.join(stored.withColumn("_old", F.lit(True)), "key", "left")
    traced = F.col("stored_source_hash").isNotNull() & F.col("stored_content_hash").isNotNull()
    edited = F.col("content_hash") != F.col("stored_content_hash")
    same = F.col("stored_source_hash") == F.col("source_hash")
    action = (
        F.when(F.col("_old").isNull(), F.lit("created"))
        .when(~traced, F.lit("conflicts"))
        .when(edited & same, F.lit("preserved"))
        .when(edited, F.lit("conflicts"))
        .when(same, F.lit("unchanged"))
        .otherwise(F.lit("updated"))
    )
    return joined.withColumn("action", action).withColumn("reason", F.when(F.col("action") == "conflicts", F.lit("manual-edit"))).drop("_old")


def capacity_guard(decisions: DataFrame) -> DataFrame:
    """A new capacity below the reserved seats turns an update into a conflict."""
    below = (F.col("action") == "updated") & F.coalesce(F.col("reserved") > F.col("capacity"), F.lit(False))
    return decisions.withColumn("reason", F.when(below, F.lit("capacity-below-reserved")).otherwise(F.col("reason"))).withColumn(
        "action", F.when(below, F.lit("conflicts")).otherwise(F.col("action"))
    )


def plan_counts(decisions: DataFrame) -> DataFrame:
    """One row of counters, zeros kept."""
    return decisions.agg(*[F.count_if(F.col("action") == name).alias(name) for name in ACTIONS])


def reconcile(expected: DataFrame, present: DataFrame, group: str = "collection") -> DataFrame:
    """expected and present(collection, key) -> expected, found and not_in_bundle per collection."""
    mark = lambda df, name: df.select(group, "key").distinct().withColumn(name, F.lit(True))
    both = mark(expected, "_e").join(mark(present, "_p"), [group, "key"], "full")
    return both.groupBy(group).agg(
        F.count("_e").alias("expected"), F.count_if(F.col("_e") & F.col("_p")).alias("found"), F.count_if(F.col("_e").isNull()).alias("not_in_bundle")
    )


def missing_and_extra(expected: DataFrame, present: DataFrame, key: str = "key") -> DataFrame:
    """(key, side): keys on one side only."""
    left = expected.select(key).distinct().withColumn("_e", F.lit(True))
    right = present.select(key).distinct().withColumn("_p", F.lit(True))
    side = F.when(F.col("_p").isNull(), F.lit("missing")).when(F.col("_e").isNull(), F.lit("extra"))
    return left.join(right, key, "full").select(key, side.alias("side")).where("side is not null")


def run_status(verification: Column, unresolved: Column) -> Column:
    return F.when((verification == "verified") & (unresolved == 0), F.lit("complete")).otherwise(F.lit("needs-review"))


def source_verification(kind: Column, complete: Column, declared: Column, trusted: Column) -> Column:
    """Five outcomes; only a database dump with a digest the caller trusts is verified."""
    return (
        F.when(kind != "joomla-dump", F.lit("not-a-database-dump"))
        .when(~complete, F.lit("declared-incomplete"))
        .when(trusted.isNull(), F.lit("manifest-not-verified"))
        .when(trusted.rlike(r"\A[a-f0-9]{64}\z") & (trusted == declared), F.lit("verified"))
        .otherwise(F.lit("manifest-mismatch"))
    )


def settings_changes(incoming: DataFrame, current: DataFrame) -> DataFrame:
    """(name, value) tables -> fill, keep or conflict per incoming field; empty ones are filled."""
    joined = incoming.join(current.select("name", F.col("value").alias("existing")), "name", "left")
    empty = F.coalesce(F.col("existing"), F.lit("")) == ""
    return joined.withColumn("change", F.when(empty, F.lit("fill")).when(F.col("existing") == F.col("value"), F.lit("keep")).otherwise(F.lit("conflict")))


def merge_variants(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """existing(product_id, row_id, legacy_key, sku, label, stock), incoming(product_id, pos,
    legacy_key, sku, label, stock) -> incoming rows with the live row id and stock, and per product
    a topology flag.

    The source key decides when both sides have one, else the sku when both have one, else the label.
    Each form is an equi join; a pair must agree in the first form both sides can use. A row with two
    partners, or an existing row without one, is a topology conflict for the whole product."""
    fold = lambda name: F.lower(F.trim(nfc(F.col(name))))
    old = existing.select("product_id", F.col("row_id"), F.col("legacy_key").alias("o_key"), fold("sku").alias("o_sku"), fold("label").alias("o_label"), F.col("stock").alias("o_stock"))
    new = incoming.select("product_id", "pos", F.col("legacy_key").alias("n_key"), fold("sku").alias("n_sku"), fold("label").alias("n_label"), F.col("stock").alias("n_stock"))
    by_key = new.join(old, (new.product_id == old.product_id) & (F.col("n_key") == F.col("o_key"))).select(new.product_id, "pos", "row_id", "o_stock")
    by_sku = new.join(old, (new.product_id == old.product_id) & (F.col("n_sku") == F.col("o_sku"))).where("n_key is null or o_key is null").select(new.product_id, "pos", "row_id", "o_stock")
    by_label = new.join(old, (new.product_id == old.product_id) & (F.col("n_label") == F.col("o_label"))).where(
        "(n_key is null or o_key is null) and (n_sku is null or o_sku is null)"
    ).select(new.product_id, "pos", "row_id", "o_stock")
    pairs = by_key.unionByName(by_sku).unionByName(by_label).distinct()
    per_new = pairs.groupBy("product_id", "pos").agg(F.count("*").alias("partners"), F.min("row_id").alias("row_id"), F.min("o_stock").alias("o_stock"))
    per_old = pairs.groupBy("product_id", "row_id").agg(F.count("*").alias("claims"))
    rows = new.select("product_id", "pos", "n_stock").join(per_new, ["product_id", "pos"], "left")
    sides = existing.groupBy("product_id").agg(F.count("*").alias("n_old")).join(incoming.groupBy("product_id").agg(F.count("*").alias("n_new")), "product_id", "full")
    doubles = rows.groupBy("product_id").agg(F.max(F.coalesce("partners", F.lit(0))).alias("most"))
    claims = per_old.groupBy("product_id").agg(F.count("*").alias("matched_old"), F.max("claims").alias("most_claims"))
    topology = sides.join(doubles, "product_id", "left").join(claims, "product_id", "left")
    n = lambda name: F.coalesce(F.col(name), F.lit(0))
    conflict = ((n("n_old") > 0) != (n("n_new") > 0)) | (n("most") > 1) | (n("most_claims") > 1) | (n("matched_old") != n("n_old"))
    flags = topology.select("product_id", conflict.alias("conflict"))
    return rows.join(flags, "product_id").select(
        "product_id", "pos", "row_id", F.when(F.col("partners").isNotNull(), F.col("o_stock")).otherwise(F.col("n_stock")).alias("stock"), "conflict"
    )


def content_projection(df: DataFrame, managed: Sequence[str], added: Sequence[str] = ()) -> Column:
    """Hash over the import-managed columns only. Columns added later are left out while empty, so an
    older record still matches its stored hash."""
    parts = []
    for name in managed:
        text = F.to_json(F.struct(F.col(name).alias(name)), {"ignoreNullFields": "false"})
        if name in added:
            kind = dict(df.dtypes)[name]
            empty = F.col(name).isNull()
            if kind == "boolean":
                empty = empty | ~F.col(name)
            elif kind.startswith("array"):
                empty = empty | (F.size(name) == 0)
            text = F.when(~empty, text)
        parts.append(text)
    return F.sha2(F.concat_ws("\n", *parts), 256)


def foreign_collisions(claims: DataFrame, held: DataFrame) -> DataFrame:
    """claims(claim, owner) of the batch, held(claim, owner) of stored records (owner null for staff
    records) -> claims a record of another owner holds."""
    wanted = claims.select("claim", F.col("owner").alias("wanted_by")).distinct()
    return held.join(wanted, "claim").where(~F.col("owner").eqNullSafe(F.col("wanted_by"))).select("claim", "wanted_by", F.col("owner").alias("held_by"))


def settings_consensus(observed: DataFrame) -> DataFrame:
    """observed(name, value) -> the value every capture agrees on, or a conflict."""
    grouped = observed.groupBy("name").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("captures"))
    same = F.col("low") == F.col("high")
    return grouped.select("name", F.when(same, F.col("low")).alias("value"), (~same).alias("conflict"), "captures")


def run_key(version: int, digests: DataFrame) -> DataFrame:
    """digests(name, rows, digest) -> one row with the key of a run: equal input and importer version give
    an equal key, whatever the order of the rows."""
    parts = F.array_sort(F.collect_list(F.concat_ws(":", "name", F.col("rows").cast("string"), "digest")))
    return digests.agg(F.concat(F.lit(f"v{version}-"), F.sha2(F.array_join(parts, "|"), 256)).alias("run_key"))


def snapshot_changes(old: DataFrame, new: DataFrame, key: str, frozen: Sequence[str]) -> DataFrame:
    """Frozen columns that differ between two versions of a record: (key, field)."""
    before = old.select(key, *[F.col(name).alias(f"_o_{name}") for name in frozen])
    changed = F.array_compact(F.array(*[F.when(~F.col(name).eqNullSafe(F.col(f"_o_{name}")), F.lit(name)) for name in frozen]))
    return new.join(before, key).select(key, F.explode(changed).alias("field"))


def table_digest(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(rows, digest) that do not depend on row order: row hashes are added, never sorted or collected."""
    from sitemill.functions.hashing import digest_lanes

    lanes = digest_lanes(*[F.col(name) for name in columns])
    total = F.concat_ws(":", *[F.coalesce(F.sum(lane), F.lit(0)).cast("string") for lane in lanes])
    return df.agg(F.count("*").alias("rows"), total.alias("digest"))


def attempt_history(runs: DataFrame) -> DataFrame:
    """runs(run_key, attempt, status, ...) -> every attempt with its position before the newest one; the
    newest row of a run is the one with age 0. Rows stay long, however often a run was tried."""
    newest = runs.groupBy("run_key").agg(F.max("attempt").alias("_newest"))
    return runs.join(newest, "run_key").withColumn("age", F.col("_newest") - F.col("attempt")).drop("_newest")
