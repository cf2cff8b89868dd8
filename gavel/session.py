"""Session factory and the few session-dependent helpers the library needs."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app_name: str = "gavel", master: str | None = None, **conf: str) -> SparkSession:
    """Build (or fetch) a session with the settings the operators assume."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's ``spark.checkpoint.dir``.

    Only on one machine (a local master, as in tests) a temporary folder is made where none is named.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    fallback = os.environ.get("GAVEL_LOCAL_DIR")
    if not fallback:
        fallback = tempfile.mkdtemp(prefix="spark-gavel-")
        os.environ["GAVEL_LOCAL_DIR"] = fallback
    return fallback


def run_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below :func:`shared_dir` for one run."""
    return f"{shared_dir(spark)}/{purpose}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, purpose: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back (survives executor loss)."""
    spark = df.sparkSession
    path = run_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
