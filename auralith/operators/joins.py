"""Join operators: manifest join (J1), strict lookup (J2), split membership (J5), completeness audit (J6) and
last-wins manifest de-duplication (A15).

No side is broadcast on faith: the planner and AQE's runtime sizes pick the strategy of every join (broadcast below
the session's byte threshold, shuffle hash or sort-merge with skew splitting above it).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dedup_last(df: DataFrame, key: str, order: str, value_cols: list[str]) -> DataFrame:
    """A15 (dict overwrite): one row per ``key`` carrying the values of the row with the largest ``order``.
    ``max_by`` is a partial (map-side) aggregate, so a hot key is combined before the shuffle."""
    packed = F.struct(*[F.col(c) for c in value_cols])
    return df.groupBy(key).agg(F.max_by(packed, F.col(order)).alias("_v")).select(key, "_v.*")


def manifest_join(members: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Inner equi-join; members without a transcript and transcripts without a member are dropped."""
    return members.join(manifest, key, "inner")


def orphans(members: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Keys present on one side only, tagged with the side they are on (one scan and one shuffle of each side). A null
    key matches nothing, so it is reported once for each side that has it."""
    both = members.select(key, F.lit(True).alias("_m")).unionByName(manifest.select(key, F.lit(False).alias("_m")))
    sides = both.groupBy(key).agg(F.bool_or("_m").alias("_any"), F.bool_and("_m").alias("_all"))
    alone = F.col(key).isNull()
    member = F.when(F.col("_any") & (F.col("_all") | alone), F.lit("member_without_transcript"))
    transcript = F.when(~F.col("_all") & (~F.col("_any") | alone), F.lit("transcript_without_member"))
    return sides.select(key, F.explode(F.array_compact(F.array(member, transcript))).alias("side"))


def strict_lookup(df: DataFrame, dim: DataFrame, key: str, dim_cols: list[str], what: str = "lookup") -> DataFrame:
    """Left join that fails the task on a missing key (the reference raises ``KeyError``)."""
    found = dim.select(key, F.lit(True).alias("_found"), *dim_cols)
    j = df.join(found, key, "left")
    guard = F.col("_found").isNotNull()
    out = j
    for c in dim_cols:
        out = out.withColumn(c, F.when(guard, F.col(c)).otherwise(
            F.raise_error(F.concat(F.lit(f"{what}: missing key "), F.col(key).cast("string")))))
    return out.drop("_found")


def checked_join(left: DataFrame, right: DataFrame, key: str, what: str = "join") -> DataFrame:
    """Inner join of which neither side may be empty, nor the result: a corpus that matches nothing is an error."""
    out = left.join(right, key, "inner")
    for side, df in (("left", left), ("right", right), ("joined", out)):
        if not df.select(key).head(1):
            raise ValueError(f"{what}: no {side} rows")
    return out


def quarantine(df: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """J2 alternative: the rows a strict lookup would fail on, instead of failing."""
    return df.join(dim.select(key), key, "left_anti")


def in_split(df: DataFrame, split_ids: DataFrame, key: str) -> DataFrame:
    """Semi-join on split membership."""
    return df.join(split_ids.select(key), key, "left_semi")


def member_key(path: Column) -> Column:
    """Member name with leading ``.``/``/`` stripped, directory and extension removed."""
    base = F.substring_index(F.regexp_replace(path, "^[./]+", ""), "/", -1)
    return F.regexp_replace(base, "\\.[^.]*$", "")
