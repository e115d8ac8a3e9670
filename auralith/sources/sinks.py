"""Sinks (K1-K7). Writes are idempotent per partition (dynamic partition overwrite), so a retried job or task
replaces its own output instead of appending duplicates; nothing is ever written to a path that is being read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _replacing_partitions(df: DataFrame, columns: list[str], root: str) -> None:
    """Overwrite only the partitions that ``df`` holds rows of: an option of this write, not a setting of the session."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*columns).parquet(root)


def write_config(df: DataFrame, root: str, config: str, split: str = "train") -> None:
    """K1: store a table as ``config=<name>/split=<split>`` under ``root``, replacing only that partition."""
    _replacing_partitions(df.withColumns({"config": F.lit(config), "split": F.lit(split)}), ["config", "split"], root)


def write_chunks(df: DataFrame, root: str, config: str, chunk_col: str = "chunk_id") -> None:
    """K7: one partition per chunk (``config.chunk`` naming of the reference becomes a partition column)."""
    _replacing_partitions(df.withColumn("config", F.lit(config)), ["config", chunk_col], root)


def save_table(df: DataFrame, path: str) -> None:
    """K2."""
    df.write.mode("overwrite").parquet(path)


def write_transcripts_csv(df: DataFrame, path: str, id_col: str = "file_id", text_col: str = "whisper_transcript") -> None:
    """K3: CSV of (file_id, transcript); array transcripts are written as JSON text."""
    t = df.schema[text_col].dataType.typeName()
    text = F.to_json(text_col) if t == "array" else F.col(text_col)
    df.select(F.col(id_col).alias("file_id"), text.alias(text_col)).write.mode("overwrite").option("header", "true").csv(path)


def write_predictions(df: DataFrame, root: str, run_params: dict[str, str]) -> str:
    """K4: prediction rows under a directory keyed by *all* run parameters (no two flag variants share a cache)."""
    key = "/".join(f"{k}={v}" for k, v in sorted(run_params.items()))
    path = f"{root.rstrip('/')}/{key}"
    df.select("id", "reference_norm", "prediction_norm", "reference_raw", "prediction_raw").write.mode("overwrite").parquet(path)
    return path


def append_metrics(df: DataFrame, path: str) -> None:
    """K5: append metric rows (JSON lines) with a run timestamp that orders them (prepend order is a sort key)."""
    df.withColumn("run_ts", F.current_timestamp()).write.mode("append").json(path)


def compact_log(spark: SparkSession, df: DataFrame, root: str) -> str:
    """Write the compacted log to a fresh directory and return it (the caller swaps the pointer); the input
    path is never overwritten while it is being read."""
    path = f"{root.rstrip('/')}/compacted-{uuid.uuid4().hex[:12]}"
    df.write.mode("errorifexists").json(path)
    return path


def upsert_report(existing: DataFrame, candidates: DataFrame, key: str, compute) -> DataFrame:
    """K6: compute the report only for keys not yet present, and return existing + new rows."""
    todo = candidates.join(existing.select(key), key, "left_anti")
    return existing.unionByName(compute(todo), allowMissingColumns=True)
