"""Session helpers: one place for the knobs every job relies on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int = 8, app: str = "auralith") -> SparkSession:
    """Local/test session. On a cluster, use the cluster's own builder; these settings are the ones we rely on."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("AURALITH_DRIVER_MEMORY", "16g"))
    )
    if master:
        builder = builder.master(master)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's ``spark.checkpoint.dir``. Where it is unset, a local master (tests, laptops) gets a scratch
    folder; on a cluster that is an error, because executors do not share the driver's disk."""
    current = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="auralith-ckpt-")
    spark.sparkContext.setCheckpointDir(path)
    try:  # make it visible to later readers of the conf; some deployments reject runtime core-conf changes
        spark.conf.set("spark.checkpoint.dir", path)
    except Exception:  # noqa: BLE001
        pass
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet below the shared checkpoint dir and read it from there (survives executor loss)."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/auralith-cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
