"""Session, checkpoint and small-table helpers shared by every module."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

def build_session(master: str | None = None, app: str = "contactlift", shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Session for tests and the bench. On a cluster pass nothing and let spark-submit decide."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # checkpoints of DataFrames that are no longer referenced are deleted (long sessions)
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        # spark.sql.codegen.maxFields stays at its default: the packs' 270-column rows cannot be
        # split into small enough methods, and per-operator codegen measured as fast
    )
    if master:  # otherwise spark-submit decides the master and the driver's memory
        builder = builder.master(master).config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _is_local(spark: SparkSession) -> bool:
    try:
        master = spark.sparkContext.master  # the executors of local-cluster[...] are processes of their own
        return master.startswith("local") and not master.startswith("local-cluster")
    except Exception:  # Spark Connect has no SparkContext
        return False


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster's setting always wins. Only a local session with no setting gets a fresh
    scratch folder (tests); a cluster session without one is an error, because a
    machine-local folder does not survive the loss of an executor.
    """
    sc = None
    try:
        sc = spark.sparkContext
        current = sc.getCheckpointDir()
        if current:
            return current
    except Exception:
        pass
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not _is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder before running contactlift jobs")
        conf = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", conf)
    if sc is not None:
        sc.setCheckpointDir(conf)
        return sc.getCheckpointDir() or conf
    return conf


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for written intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/contactlift-{name}-{uuid.uuid4().hex[:12]}"


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` into the shared checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def sized(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back, so the planner knows its bytes.

    Small derived tables (bucket offsets, stratum bounds) go through this: Spark broadcasts them below
    ``spark.sql.autoBroadcastJoinThreshold`` and keeps a shuffle join above, one rule for every size.
    """
    path = scratch_path(df.sparkSession, "sized")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
