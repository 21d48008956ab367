"""Spark session helpers.

The library never creates machine-local scratch space on a cluster: lineage
is cut only through ``spark.checkpoint.dir`` (a shared folder the cluster
names). Tests and local runs pass their own folder, which is used only when
the session has none.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

# Defaults for a local run. Values set on the builder win over submit options:
# on a cluster use the session at hand, or name other values in `extra_conf`.
LOCAL_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # image rows are large: keep Arrow batches to the Python workers small
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
    "spark.driver.memory": "16g",
}


def get_session(
    master: str | None = None,
    shuffle_partitions: int | None = None,
    app_name: str = "gridweave",
    extra_conf: dict[str, str] | None = None,
) -> SparkSession:
    """Build (or reuse) a session with the library's defaults."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(LOCAL_CONF)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Return the shared checkpoint folder of the session.

    The cluster's ``spark.checkpoint.dir`` wins. Only when it is unset (tests,
    a laptop) is ``fallback`` installed; with neither, this raises rather than
    silently using a machine-local folder.
    """
    sc = spark.sparkContext
    configured = (
        sc.getCheckpointDir()
        or sc.getConf().get("spark.checkpoint.dir", None)
        or spark.conf.get("spark.checkpoint.dir", None)
    )
    if configured:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(configured)
        return configured
    fallback = fallback or os.environ.get("GRIDWEAVE_CHECKPOINT_DIR")
    if not fallback:
        raise RuntimeError("spark.checkpoint.dir is not set; pass a shared folder as fallback")
    sc.setCheckpointDir(fallback)
    return fallback


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The session's shared checkpoint folder, or None when none is configured."""
    sc = spark.sparkContext
    return sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new folder name below the shared checkpoint folder.

    Only a local session that names none (tests, a laptop) gets a folder of
    its own; on a cluster this raises.
    """
    fallback = tempfile.mkdtemp(prefix="gridweave-") if spark.sparkContext.master.startswith("local[") and not checkpoint_dir(spark) else None
    return f"{ensure_checkpoint_dir(spark, fallback).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Compute a stage output once and cut its lineage.

    With a shared ``spark.checkpoint.dir`` this is a reliable checkpoint (it
    survives the loss of any executor). Without one it is a disk-backed
    persist, which Spark recomputes from lineage if an executor is lost;
    never a machine-local folder.
    """
    spark = df.sparkSession
    d = checkpoint_dir(spark)
    if d:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(d)
        return df.checkpoint(eager=True)
    return df.persist(StorageLevel.MEMORY_AND_DISK)
