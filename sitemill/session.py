"""Session settings and lineage cuts shared by every job.

No job carries a broadcast hint: Spark broadcasts a side only when its size is known to be below
spark.sql.autoBroadcastJoinThreshold, at planning or (AQE) at run time, and shuffles it otherwise."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the jobs rely on. Shuffle partitions are left to the cluster: AQE merges
# small ones and splits skewed ones, so no number is hard-wired to a data size.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # address work is heavy per byte: small shuffles keep their parallelism instead of one task
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64kb",
}

# Sizes of a task's share, unless the session has its own. They count packed bytes: narrow rows of keys take 30 times as many
# in the hash table of an aggregate, so that Spark's own 64 and 128 MB are gigabytes of memory in one task.
TASK_SIZES = {
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16mb",
    "spark.sql.files.maxPartitionBytes": "32mb",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    for key, value in TASK_SIZES.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the cluster's shared checkpoint folder; a local folder only in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="sitemill-checkpoint-")
    context.setCheckpointDir(folder)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """The address of a new folder below the checkpoint folder, for tables that a job reads again."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """df written to a new folder below the checkpoint folder and read again: the data survives the loss of an executor, and the
    planner knows its size.

    checkpoint() would keep the size that was estimated for its plan, and a join is estimated as the product of its sides: a
    loop that joins what it has cut squares the number each round, so that soon it has millions of digits."""
    spark, schema, path = df.sparkSession, df.schema, scratch_folder(df.sparkSession, "cut")
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)
