"""Session helpers.

The library never creates a session behind the caller's back; these
helpers are for tests, the bench and the command line.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "lcspark") -> SparkSession:
    master = master or os.environ.get("LCSPARK_MASTER", "local[8]")
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("LCSPARK_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def program_session(app_name: str) -> SparkSession:
    """The session of a submitted program: master, cores and memory are the
    submit command's (local only if it names none); set here is only what
    the operators rely on."""
    spark = (SparkSession.builder.appName(app_name)
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.ansi.enabled", "true")
             .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
             .getOrCreate())
    ensure_checkpoint_dir(spark)
    return spark


def size_session(spark: SparkSession, input_bytes: int) -> None:
    """Apply ``scale_conf`` for an input of that size to the session's SQL
    settings (the static ones are the submit command's)."""
    for key, value in scale_conf(input_bytes, spark.sparkContext.defaultParallelism).items():
        if key.startswith("spark.sql."):
            spark.conf.set(key, value)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder the cluster names in
    ``spark.checkpoint.dir`` (or the one already set on the context).  Only
    a local-mode session (tests, the bench) may fall back to a fresh local
    scratch folder; on a cluster a machine-local folder would not be
    shared, so the setting is required."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        spark.sparkContext.setCheckpointDir(configured)
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster "
                           "(lcspark writes checkpoints and stage tables there)")
    local = tempfile.mkdtemp(prefix="lcspark-ckpt-")
    spark.sparkContext.setCheckpointDir(local)
    return local


def scale_conf(input_bytes: int, total_cores: int, target_partition_bytes: int = 256 << 20) -> dict:
    """Settings for a cluster run, sized from the input: enough initial
    shuffle partitions that each holds about ``target_partition_bytes``
    (AQE then coalesces small ones and splits skewed join partitions),
    scan splits of 256 MB, and windows that spill long objects early."""
    parts = max(2 * total_cores, -(-int(input_bytes) // int(target_partition_bytes)))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(256 << 20),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.windowExec.buffer.spill.threshold": str(1 << 16),
        "spark.sql.session.timeZone": "UTC",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
