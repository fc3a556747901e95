"""File inventories, manifests and snapshot states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sitemill.operators.ordered import range_chunks


def skip_reason(path: Column) -> Column:
    """Secret files never enter an inventory: any segment that begins '.env', shell histories."""
    parts = F.split(path, "/")
    return F.when(F.exists(parts, lambda part: part.startswith(".env")), F.lit("secret-path")).when(
        F.element_at(parts, -1).isin(".bash_history", ".zsh_history", ".sh_history", ".history"), F.lit("shell-history")
    )


def snapshot_priority(path: Column) -> Column:
    """Dumps 0, full product photos 1, images 2, the rest 3, caches and thumbnails 5."""
    low = F.lower(path)
    resized = low.rlike("/(?:resized|thumbs|thumbnails)/")
    return (
        F.when(low.rlike(r"\.(?:sql|sql\.gz|jpa|jps)\z"), F.lit(0))
        .when(low.contains("/shop_image/product/") & ~low.contains("/resized/"), F.lit(1))
        .when(low.contains("/images/") & ~resized, F.lit(2))
        .when(low.rlike("/(?:cache|tmp|logs)/") | resized, F.lit(5))
        .otherwise(F.lit(3))
    )


def size_totals(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def manifest_diff(manifest: DataFrame, members: DataFrame) -> DataFrame:
    """manifest and members(path, size, sha256) -> (path, verdict): ok, size-differs, digest-differs,
    missing-member or unlisted-member."""
    listed = manifest.select("path", F.col("size").alias("m_size"), F.col("sha256").alias("m_sha"))
    both = listed.join(members.select("path", F.col("size").alias("a_size"), F.col("sha256").alias("a_sha")), "path", "full")
    verdict = (
        F.when(F.col("a_sha").isNull(), F.lit("missing-member"))
        .when(F.col("m_sha").isNull(), F.lit("unlisted-member"))
        .when(F.col("m_size") != F.col("a_size"), F.lit("size-differs"))
        .when(F.col("m_sha") != F.col("a_sha"), F.lit("digest-differs"))
        .otherwise(F.lit("ok"))
    )
    return both.select("path", verdict.alias("verdict"))


def snapshot_states(inventory: DataFrame, records: DataFrame, objects: DataFrame) -> DataFrame:
    """inventory(path, size), records(path, inventory_bytes, sha256, complete), objects(path, sha256) ->
    state per inventoried file: done, superseded, corrupt, unrecorded, failed or pending."""
    joined = (
        inventory.select("path", "size")
        .join(records.select("path", "inventory_bytes", F.col("sha256").alias("r_sha"), "complete"), "path", "left")
        .join(objects.select("path", F.col("sha256").alias("o_sha")), "path", "left")
    )
    complete = F.coalesce("complete", F.lit(False))
    valid = F.coalesce(F.col("r_sha") == F.col("o_sha"), F.lit(False))
    state = (
        F.when(F.col("o_sha").isNull() & F.col("complete").isNotNull() & ~complete, F.lit("failed"))
        .when(F.col("o_sha").isNull(), F.lit("pending"))
        .when(~complete, F.lit("unrecorded"))
        .when(valid & (F.col("inventory_bytes") == F.col("size")), F.lit("done"))
        .when(valid, F.lit("superseded"))
        .otherwise(F.lit("corrupt"))
    )
    return joined.select("path", state.alias("state"))


def document_inventory(links: DataFrame, files: DataFrame) -> DataFrame:
    """links(path) on own hosts, files(path, sha256, size) -> PDF addresses with digest and status."""
    wanted = links.where(F.lower("path").endswith(".pdf")).groupBy("path").agg(F.count("*").alias("links"))
    joined = wanted.join(files.select("path", "sha256", "size"), "path", "left")
    return joined.withColumn("status", F.when(F.col("sha256").isNull(), F.lit("missing")).otherwise(F.lit("ready")))


def table_statistics(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table: (table, rows)."""
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows") for name, df in tables.items()]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def metric_summary(samples: DataFrame, threshold: float) -> DataFrame:
    """samples(route, value) -> exact median, maximum and samples under a threshold per route.

    Equal values are counted first, and the counted values are laid out in ranges that the data's own quantiles bound. Sums per
    range say which range holds the middle, and only that one is opened, so a dense stretch of values is divided like any
    other and no route is gathered."""
    counted = range_chunks(samples.groupBy("route", "value").agg(F.count("*").alias("n")), [F.col("route"), F.col("value")])
    totals = counted.groupBy("route").agg(
        F.max("value").alias("maximum"), F.coalesce(F.sum(F.when(F.col("value") < threshold, F.col("n"))), F.lit(0)).alias("under"), F.sum("n").alias("samples")
    )
    earlier = W.partitionBy("route").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    ranges = counted.groupBy("route", "chunk").agg(F.sum("n").alias("held")).withColumn("before", F.coalesce(F.sum("held").over(earlier), F.lit(0)))
    first, second = F.floor((F.col("samples") + 1) / 2), F.floor((F.col("samples") + 2) / 2)
    holds = lambda place: (F.col("before") < place) & (place <= F.col("before") + F.col("held"))
    opened = ranges.join(totals, "route").where(holds(first) | holds(second)).select("route", "chunk", "before", "samples")
    inside = W.partitionBy("route", "chunk").orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    placed = counted.join(opened, ["route", "chunk"]).withColumn("upto", F.col("before") + F.sum("n").over(inside))
    middle = placed.groupBy("route").agg(
        ((F.min(F.when(F.col("upto") >= first, F.col("value"))) + F.min(F.when(F.col("upto") >= second, F.col("value")))) / 2).alias("median")
    )
    return totals.join(middle, "route").select("route", "median", "maximum", "under", "samples")


def coverage_summary(checks: DataFrame) -> DataFrame:
    """checks(kind, outcome) -> checked, passed, failed and skipped per kind."""
    is_ = lambda name: F.count_if(F.col("outcome") == name).alias(name)
    return checks.groupBy("kind").agg(F.count_if(F.col("outcome") != "skipped").alias("checked"), is_("passed"), is_("failed"), is_("skipped"))


def one_row(counts: dict[str, DataFrame]) -> DataFrame:
    """One row with the row count of each table as a column. The counts are stacked and folded, so no
    tables are multiplied."""
    stacked = table_statistics(counts)
    return stacked.agg(*[F.max(F.when(F.col("table") == name, F.col("rows"))).alias(name) for name in counts])
