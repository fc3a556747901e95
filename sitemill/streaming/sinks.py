"""Streaming sinks: exactly-once appends, audit trail and periodic maintenance."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from sitemill.session import cut_lineage


def append_once(path: str, key: str, buckets: int = 256) -> Callable[[DataFrame, int], None]:
    """foreachBatch function that writes each batch to its own folder, so a replayed batch overwrites itself, and leaves out keys
    that earlier batches wrote.

    The keys lie beside the data in buckets of their hash (folder _keys, which readers of the data pass over); a batch opens
    the buckets that its own keys fall into, and never the data. For streams see write_once, whose cost does not depend
    on what was written before at all."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        index = f"{path}/_keys"
        unique = batch.dropDuplicates([key]).withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        unique = cut_lineage(unique)  # the batch is asked for twice
        folder = spark._jvm.org.apache.hadoop.fs.Path(index)
        fresh = unique
        if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            wanted = [row[0] for row in unique.select("_bucket").distinct().collect()]  # at most one row a bucket
            kind = f"`{key}` {dict(batch.dtypes)[key]}, _batch long, _bucket int"
            written = spark.read.schema(kind).option("basePath", index).parquet(index).where(F.col("_bucket").isin(wanted) & (F.col("_batch") < number))
            fresh = unique.join(written.select(key), key, "left_anti")
        fresh = cut_lineage(fresh)
        # the keys first: a batch that fails between the two is replayed and overwrites both
        fresh.select(key, "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{index}/_batch={number}")
        fresh.drop("_bucket").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def write_once(stream: DataFrame, path: str, key: str, checkpoint: str, trigger: dict | None = None, forget: str | None = None) -> StreamingQuery:
    """Appends each key of a stream once. Which keys were seen is the query's state, a look-up per key in the state store, so
    a batch costs what its own rows cost however much was written; a replayed batch sees the state as it was before it and
    overwrites its folder. forget: a watermark delay on column at after which keys leave the state."""
    if forget:
        once = stream.withWatermark("at", forget).dropDuplicatesWithinWatermark([key])
    else:
        once = stream.dropDuplicates([key])
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return once.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 minute"})).start()


def audit_trail(verdicts: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Appends every state change with its before and after values."""
    changes = verdicts.where(~F.col("before").eqNullSafe(F.col("after")))
    return changes.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"processingTime": "1 minute"})).start()


def maintenance(ticks: DataFrame, expire: Callable[[DataFrame], None], checkpoint: str, interval: str = "1 minute") -> StreamingQuery:
    """Runs an expiry job (see expired_orders and expired_seats) on every trigger."""
    return ticks.writeStream.foreachBatch(lambda batch, number: expire(batch)).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()
