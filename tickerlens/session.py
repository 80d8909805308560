"""Session helpers.

The library never builds its own cluster settings inside operators; these
helpers exist for tests, the bench and command-line use.  On a cluster the
session comes from ``spark-submit`` and only ``checkpoint_dir`` is consulted.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "tickerlens") -> SparkSession:
    """Local session with the settings the library assumes (UTC, AQE on)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = (
        builder
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # call-site capture for error messages costs two JVM round trips per
        # Column operation while a plan is built; plans here are built from
        # library code, so the capture is off
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", os.environ.get("TICKERLENS_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster's setting always wins.  Only when it is unset and the master
    is ``local[...]`` (tests, the bench) is a fresh scratch folder created and
    registered; on a cluster an unset folder is an error.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    master = sc.master or ""
    if not master.startswith("local"):
        # a machine-local folder is not readable after an executor is lost
        raise RuntimeError(
            "spark.checkpoint.dir is not set: on a cluster it must name a shared "
            "folder (e.g. on the cluster file system) before tickerlens cuts lineage")
    local = tempfile.mkdtemp(prefix="tickerlens-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"
