"""SparkSession construction and the few session-level helpers the jobs need."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on.  UTC is semantic (all instants are UTC and
# `timestamp_ntz` columns are read as UTC wall time); the rest are defaults a
# cluster launcher may override.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.optimizer.dynamicPartitionPruning.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    # A checkpoint that no frame refers to any more is deleted.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


# Cluster-mode sizing (not applied to local sessions).  Large shuffles (the
# stored-table anti-join, the document join of the views, the fallback range
# join) start from many partitions of ~256 MB; AQE coalesces the small,
# question-sized shuffles and splits skewed ones.
CLUSTER_DEFAULTS = {
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16m",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
}


def get_spark(master: str | None = None, app: str = "sigsight",
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in SESSION_DEFAULTS.items():
        builder = builder.config(k, v)
    if master and not master.startswith("local"):
        for k, v in CLUSTER_DEFAULTS.items():
            builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the launcher sets it to shared storage and we only read it.
    Only a local-mode session without the setting (tests, laptops) gets a
    private temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or \
        spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if configured:
        spark.sparkContext.setCheckpointDir(configured)
        return configured
    master = spark.sparkContext.master or ""
    if not master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="sigsight-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one job's tables, under the shared checkpoint folder; ``remove_folder`` deletes it."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's file system, wherever it is."""
    fs, at = _files(spark, path)
    fs.delete(at, True)


def folder_exists(spark: SparkSession, path: str) -> bool:
    fs, at = _files(spark, path)
    return fs.exists(at)


def publish_folder(spark: SparkSession, staged: str, published: str) -> bool:
    """Rename a finished folder to its final place; False, and the staged one goes, if that place is taken."""
    fs, at = _files(spark, published)
    fs.mkdirs(at.getParent())
    if fs.exists(at) or not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(staged), at):
        remove_folder(spark, staged)
        return False
    return True


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss; never localCheckpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more, such as those before a checkpoint.

    Its cleaner does so when the driver has collected its garbage, which a driver with little of it rarely does.
    The second time finds what Spark still held when the first began.
    """
    for pause in (0.3, 0):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(pause)
