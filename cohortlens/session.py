"""Spark session helpers.

The library never changes settings on a session it did not build, with
one exception: when ``spark.checkpoint.dir`` is unset (local runs and
tests), a checkpoint folder is chosen so ``DataFrame.checkpoint`` works.
On a cluster that setting names the shared, reliable folder and is used
as-is.
"""

from __future__ import annotations

import math
import os
import tempfile

from pyspark.sql import SparkSession

_LOCAL_CKPT_ENV = "COHORTLENS_LOCAL_CHECKPOINT_DIR"


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "cohortlens",
                  extra: dict | None = None) -> SparkSession:
    """Session for local runs and tests (AQE on, UI off, UTC)."""
    b = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, choosing a local one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        sc.setCheckpointDir(conf)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; on a cluster it must name a shared, reliable folder")
    # unset and local mode: tests and single-machine runs only
    path = os.environ.get(_LOCAL_CKPT_ENV) or tempfile.mkdtemp(prefix="cohortlens-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def scale_settings(largest_shuffle_bytes: int, cores: int, target_partition_bytes: int = 192 << 20) -> dict[str, str]:
    """Starting Spark settings for a cluster run of the suite.

    The largest shuffle is the session recalculation's join over the event
    table (about the events' size in bytes).  Shuffle partitions are sized
    so one partition is ~``target_partition_bytes`` there (and never fewer
    than 3 waves of ``cores``); AQE coalesces the smaller shuffles of the
    other reports and splits skewed partitions at runtime.  Scan splits use
    the same target."""
    partitions = max(3 * cores, math.ceil(largest_shuffle_bytes / target_partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
