"""Session defaults and the one place that knows how to cut lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app: str = "vigilake", master: str | None = None, **conf: str) -> SparkSession:
    """A UTC session with adaptive execution on; every other choice stays with the cluster."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Point the context at the shared folder the session names.

    A folder on this machine is used only in local mode, where the driver and
    the executors are one process; anywhere else an unset folder is an error,
    because a lost executor could not read its files back.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get(CHECKPOINT_CONF, "")
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder all executors can read")
        folder = tempfile.mkdtemp(prefix="vigilake-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise an iterative job's state reliably before the next round reads it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
