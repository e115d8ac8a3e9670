"""Intermediate tables in the shared folder that ``spark.checkpoint.dir`` names.

A stored table cuts lineage: later jobs read files that every executor sees, so a lost executor costs a re-read and
never a recomputation with another outcome.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from auralith.session import ensure_checkpoint_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/auralith-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet and return a reader of the files."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
