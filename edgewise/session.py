"""Session helpers: local sessions for tests/bench and the checkpoint folder.

Iterative operators cut lineage with reliable ``DataFrame.checkpoint``.  On a
cluster the folder must be shared storage, so it is read from the session
(``spark.checkpoint.dir`` or ``SparkContext.setCheckpointDir``).  Only a local
session without one gets a private scratch folder.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL_CONF = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # delete checkpoint files once nothing references them
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cores: str = "*", shuffle_partitions: int = 8,
                  driver_memory: str = "8g", app: str = "edgewise") -> SparkSession:
    """A local session configured the way tests and the bench expect."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = dict(_LOCAL_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = driver_memory
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the setting that results depend on (time stamps are in UTC) to any session."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    Uses the session's own setting; a local session without one gets a fresh
    scratch folder.  A cluster session without one is an error, because a
    machine-local folder would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        sc.setCheckpointDir(conf)
        return sc.getCheckpointDir()
    master = sc.master or ""
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(
            "set spark.checkpoint.dir to a shared folder (HDFS/S3/ABFS); "
            "iterative operators checkpoint there")
    folder = tempfile.mkdtemp(prefix="edgewise-ckpt-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the checkpoint folder for written tables."""
    base = checkpoint_dir(spark)
    return base.rstrip("/") + f"/{name}-{uuid.uuid4().hex[:12]}"


def local_path(path: str) -> str:
    """Strip a ``file:`` scheme, for helpers that need a plain path."""
    if path.startswith("file:"):
        path = path[5:]
        while path.startswith("//"):
            path = path[1:]
    return os.path.abspath(path)
