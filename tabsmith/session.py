"""Session helpers: local session for tests/bench and the shared scratch folder.

Scratch data (materialised sorted frames, splits, model files written by jobs)
always lives under ``spark.checkpoint.dir`` — the shared folder a cluster
names.  Only when that setting is unset (local tests) do we create one.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cpus: int | str = 8, shuffle_partitions: int | None = None,
                  app: str = "tabsmith") -> SparkSession:
    """A local[N] session configured like the cluster profile (AQE on, UTC, no UI)."""
    cpus = str(cpus)
    parts = shuffle_partitions or (int(cpus) if cpus.isdigit() else 8)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.default.parallelism", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.autoBroadcastJoinThreshold", str(10 * 1024 * 1024))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; create a local one only if unset."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    try:
        configured = configured or spark.conf.get("spark.checkpoint.dir", None)
    except Exception:  # noqa: BLE001 - conf lookup on some connect sessions
        pass
    if not configured:
        current = sc.getCheckpointDir()
        if current:
            return current
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        # Unset: a local test or bench session.
        configured = tempfile.mkdtemp(prefix="tabsmith-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", configured)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder (for written tables)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tabsmith/{name}-{uuid.uuid4().hex[:12]}"
