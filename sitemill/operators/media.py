"""Media and documents: inventories, attachment, references in HTML, cache reuse."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def attach_media(targets: DataFrame, available: DataFrame) -> DataFrame:
    """targets(entity_id, pos, media_key), available(media_key) -> (entity_id, media_key, pos): each
    available medium once per entity, at its first source position. Rows stay long; lists
    are built on request (see ordered_lists)."""
    usable = targets.join(available.select("media_key").distinct(), "media_key", "left_semi")
    return usable.groupBy("entity_id", "media_key").agg(F.min("pos").alias("pos"))


def ordered_lists(attached: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(entity_id, media list in order) for entities within the limit (all, if there is none), and
    (entity_id, n) of those over it; sizes are known before any list is built."""
    sizes = attached.groupBy("entity_id").agg(F.count("*").alias("n"))
    if limit is None:
        limit = (1 << 31) - 1  # the longest list that Spark can hold
    over = sizes.where(F.col("n") > limit)
    fitting = attached.join(sizes.where(F.col("n") <= limit).select("entity_id"), "entity_id", "left_semi")
    lists = fitting.groupBy("entity_id").agg(F.sort_array(F.collect_list(F.struct("pos", "media_key"))).alias("_items"))
    return lists.select("entity_id", F.transform("_items", lambda item: item["media_key"]).alias("media")), over


def media_inventory(references: DataFrame) -> DataFrame:
    """references(path, url, alt, pos) -> one row per path: the first address, the first non-empty alt
    and how many other spellings exist."""
    merged = references.groupBy("path").agg(
        F.min_by("url", "pos").alias("url"),
        F.min_by("alt", F.when(F.coalesce(F.col("alt"), F.lit("")) != "", F.col("pos"))).alias("alt"),
        F.count("*").alias("uses"),
    )
    spellings = references.select("path", "url").distinct().groupBy("path").agg((F.count("*") - 1).alias("other_spellings"))
    return merged.join(spellings, "path").withColumn("alt", F.coalesce("alt", F.lit("")))


def reference_outcomes(references: DataFrame, media: DataFrame, stored: DataFrame) -> DataFrame:
    """references(ref_id, kind, path), media(path, media_key), stored(media_key) -> outcome per HTML
    reference: external, unsafe, unmapped, not-downloaded or mapped."""
    by_path = media.groupBy("path").agg(F.min("media_key").alias("media_key"))
    joined = references.join(by_path, "path", "left").join(stored.select("media_key", F.lit(True).alias("_have")).distinct(), "media_key", "left")
    outcome = (
        F.when(F.col("kind") == "external", F.lit("external"))
        .when((F.col("kind") == "unsafe") | F.col("path").isNull(), F.lit("unsafe"))
        .when(F.col("media_key").isNull(), F.lit("unmapped"))
        .when(F.col("_have").isNull(), F.lit("not-downloaded"))
        .otherwise(F.lit("mapped"))
    )
    return joined.select("ref_id", "path", outcome.alias("outcome"), F.when(outcome == "mapped", F.col("media_key")).alias("media_key"))


def attach_documents(descriptors: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """descriptors(key, sha256, size), files(sha256, size) -> (ready, rejected): size and digest agree."""
    good = files.select("sha256", "size").distinct()
    return descriptors.join(good, ["sha256", "size"], "left_semi"), descriptors.join(good, ["sha256", "size"], "left_anti")


def reuse_cache(wanted: DataFrame, cache: DataFrame, archive: DataFrame) -> DataFrame:
    """wanted(media_key, sha256), cache and archive(media_key, sha256) -> source per medium: the cache,
    else the archive, else fetch; a copy counts only when its digest matches (or none is expected)."""
    side = lambda df, name: df.groupBy("media_key", F.col("sha256").alias("_d")).agg(F.lit(True).alias(name))
    fits = F.col("sha256").isNull() | (F.col("sha256") == F.col("_d"))
    pick = lambda df, name: wanted.join(side(df, name), "media_key").where(fits).groupBy("media_key").agg(F.lit(True).alias(name))
    joined = wanted.join(pick(cache, "_c"), "media_key", "left").join(pick(archive, "_a"), "media_key", "left")
    source = F.when(F.col("_c"), F.lit("cache")).when(F.col("_a"), F.lit("archive")).otherwise(F.lit("fetch"))
    return joined.select("media_key", source.alias("source"))


def staging_plan(wanted: DataFrame, staged: DataFrame, failures: DataFrame) -> DataFrame:
    """wanted(media_key, path), staged(media_key), failures(media_key) -> reuse, known-failure, missing,
    or path-conflict when two keys want one path."""
    clash = wanted.groupBy("path").agg((F.min("media_key") != F.max("media_key")).alias("clash"))
    flag = lambda df, name: df.select("media_key").distinct().withColumn(name, F.lit(True))
    joined = wanted.join(clash, "path").join(flag(staged, "_s"), "media_key", "left").join(flag(failures, "_f"), "media_key", "left")
    state = F.when(F.col("clash"), F.lit("path-conflict")).when(F.col("_s"), F.lit("reuse")).when(F.col("_f"), F.lit("known-failure")).otherwise(F.lit("missing"))
    return joined.select("media_key", "path", state.alias("state"))


def home_aliases(mains: DataFrame, live: DataFrame, home: str = "/") -> DataFrame:
    """mains(path, main_hash), live(route) -> addresses whose whole main content equals the home page,
    only when the home page has one content and nothing lives at the address."""
    from sitemill.functions.paths import route_key

    per_path = mains.groupBy("path").agg(F.min("main_hash").alias("low"), F.max("main_hash").alias("high")).where("low = high")
    page = per_path.where(F.col("path") == home).select(F.col("low").alias("home_hash"))
    # equi join on the hash; the home side is a single row
    same = per_path.where(F.col("path") != home).join(page, F.col("low") == F.col("home_hash"), "left_semi")
    routed = same.withColumn("route", route_key(F.col("path"))).join(live.select("route").distinct(), "route", "left_anti")
    return routed.select(F.col("path").alias("from_path"), F.lit(home).alias("to_path"), F.col("low").alias("main_hash"))
