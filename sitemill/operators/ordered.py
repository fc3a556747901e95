"""First, top-k, running and previous values per key that do not need a whole key in one task.

A plain window puts every row of a key into one task. Where a key may hold a large share of all
rows these helpers work in two levels: rows are ordered inside (key, chunk), where the chunk is
a coarse part of the ordering column such as its day, and one small row per (key, chunk) carries
the state from chunk to chunk. Only the small rows meet in one task per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sitemill.session import cut_lineage


def range_chunks(df: DataFrame, order: Sequence[Column], name: str = "chunk") -> DataFrame:
    """df with a chunk number that grows with the order and holds about equally many rows each, from the data's own
    quantiles: hot and dense ranges are divided like any other (rows alike in the whole order share a chunk). Written
    to the checkpoint folder, as the numbers depend on one sampling."""
    dealt = df.repartitionByRange(*order).withColumn(name, F.spark_partition_id())
    return cut_lineage(dealt)


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, position: str | None = None) -> DataFrame:
    """First k rows per key. Spark limits each task's rows per key before the shuffle
    (WindowGroupLimit), so a hot key sends at most k rows from a task."""
    ranked = df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= k)
    return ranked.withColumnRenamed("_rank", position) if position else ranked.drop("_rank")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_k(df, keys, order, 1)


def _carry(df: DataFrame, keys: Sequence[str], chunk: str, value: Column) -> DataFrame:
    totals = df.groupBy(*keys, chunk).agg(F.sum(value).alias("_total"))
    earlier = W.partitionBy(*keys).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
    return totals.select(*keys, chunk, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_carry"))


def running_sum(df: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[Column], value: Column, name: str) -> DataFrame:
    """Sum of value over the key's rows up to and including this one."""
    inside = W.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = df.withColumn("_inside", F.sum(value).over(inside))
    joined = rows.join(_carry(df, keys, chunk, value), [*keys, chunk])
    return joined.withColumn(name, F.col("_inside") + F.col("_carry")).drop("_inside", "_carry")


def position_in_key(df: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[Column], name: str) -> DataFrame:
    """1-based position of the row within its key."""
    return running_sum(df, keys, chunk, order, F.lit(1).cast("long"), name)


def previous_value(df: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[Column], value: Column, name: str) -> DataFrame:
    """Value of the preceding row of the key, null for the first one. value must not be null."""
    inside = W.partitionBy(*keys, chunk).orderBy(*order)
    rows = df.withColumn("_previous", F.lag(value).over(inside))
    last = df.groupBy(*keys, chunk).agg(F.max_by(value, F.struct(*order)).alias("_last"))
    carry = last.select(*keys, chunk, F.lag("_last").over(W.partitionBy(*keys).orderBy(chunk)).alias("_carry"))
    joined = rows.join(carry, [*keys, chunk])
    return joined.withColumn(name, F.coalesce("_previous", "_carry")).drop("_previous", "_carry")


def next_marked(df: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[Column], marked: Column, value: Column, name: str) -> DataFrame:
    """Value of the nearest later row of the key for which marked holds; null when there is none."""
    found = F.when(marked, value)
    # in descending order the next marked row is the last one before: a frame that only grows
    inside = W.partitionBy(*keys, chunk).orderBy(*[column.desc() for column in order]).rowsBetween(W.unboundedPreceding, -1)
    rows = df.withColumn("_near", F.last(found, ignorenulls=True).over(inside))
    heads = df.groupBy(*keys, chunk).agg(F.min_by(found, F.when(marked, F.struct(*order))).alias("_head"))
    later = W.partitionBy(*keys).orderBy(F.col(chunk).desc()).rowsBetween(W.unboundedPreceding, -1)
    carry = heads.select(*keys, chunk, F.last("_head", ignorenulls=True).over(later).alias("_far"))
    return rows.join(carry, [*keys, chunk]).withColumn(name, F.coalesce("_near", "_far")).drop("_near", "_far")
