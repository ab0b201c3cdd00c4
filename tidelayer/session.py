"""Session helpers: a local session for tests and benches, and the shared folder jobs write to."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(app: str = "tidelayer", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests, benches and notebooks. On a cluster use the session you are given."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="tidelayer-warehouse-"))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (`spark.checkpoint.dir`).

    Every file a job leaves for a later stage (stream sinks, checkpoints, rewritten tables) goes
    below it, so a lost executor never takes such files away. Only a local master may fall back to
    a folder of its own.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", context.master):  # local-cluster has executors of its own
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="tidelayer-shared-"))
    return context.getCheckpointDir()


def run_dir(spark: SparkSession, name: str) -> str:
    """A folder of its own for one run, below the shared folder."""
    return os.path.join(shared_dir(spark), "tidelayer", f"{name}-{uuid.uuid4().hex}")
