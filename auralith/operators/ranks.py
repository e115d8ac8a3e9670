"""Exact order statistics of groups of any size by rank selection.

The built-in ``median`` buffers all distinct values of a group in one task. For a group of more than ``hot_rows`` rows the two
middle values are found by counts alone: the range that holds the wanted rank is cut into ``BINS`` equal parts, each part's
count, least and greatest value are partial aggregates, and the part with the rank is the next range, until it holds
one value or at most ``hot_rows`` rows. What a task holds is bounded by ``BINS`` counters per hot group, then by ``hot_rows`` values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auralith.operators.scans import same
from auralith.session import cut_lineage

BINS = 1024


def _bin(x: Column, low: Column, high: Column) -> Column:
    """Part of [low, high] (finite) that x lies in; values that are not finite have parts of their own, in Spark's order."""
    width = high - low
    share = F.when(width == float("inf"), (x / 2 - low / 2) / (high / 2 - low / 2)).otherwise((x - low) / width)
    inside = F.when(low == high, 0).otherwise(F.least(F.floor(share * BINS), F.lit(BINS - 1)))
    return F.when(F.isnan(x), BINS + 1).when(x == float("inf"), BINS).when(x == float("-inf"), -1).otherwise(inside).cast("int")


def medians(df: DataFrame, keys: list[str], value: Column, name: str = "median", hot_rows: int = 1 << 20) -> DataFrame:
    """(keys, ``name``): the exact median of ``value`` (double; nulls left out) of each group, null for a group without values. Equal
    to ``F.median`` to the last bit."""
    rows = df.select(*keys, value.cast("double").alias("x"))
    sizes = rows.groupBy(*keys).agg(F.count("x").alias("n"))
    hot = sizes.filter(F.col("n") > hot_rows)
    if not hot.head(1):
        return rows.groupBy(*keys).agg(F.median("x").alias(name))
    hot = cut_lineage(hot)
    ordinary = same(rows, hot.select(*keys), keys, "left_anti").groupBy(*keys).agg(F.median("x").alias(name))
    values = cut_lineage(same(rows.filter("x is not null"), hot.select(*keys), keys, "left_semi"))
    ranks = F.array(F.expr("(n - 1) div 2"), F.expr("n div 2"))
    open_ranges = hot.select(*keys, F.posexplode(ranks).alias("side", "rank"), F.lit(float("-inf")).alias("least"), F.lit(float("nan")).alias("most"))
    found = None
    while open_ranges.head(1):
        finite = F.when(~F.isnan("x") & (F.abs("x") != float("inf")), F.col("x"))
        inside = same(values, open_ranges, keys).filter((F.col("x") >= F.col("least")) & (F.col("x") <= F.col("most")))
        place = [*keys, "side"]
        limits = inside.groupBy(*place).agg(F.min(finite).alias("low"), F.max(finite).alias("high"))
        ranges = same(open_ranges, limits, place)
        binned = same(values, ranges, keys).filter((F.col("x") >= F.col("least")) & (F.col("x") <= F.col("most")))
        binned = binned.withColumn("bin", _bin(F.col("x"), F.col("low"), F.col("high")))
        counts = binned.groupBy(*place, "rank", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("least"), F.max("x").alias("most"))
        upto = F.sum("n").over(Window.partitionBy(*place).orderBy("bin"))  # BINS rows and a few
        chosen = counts.withColumn("upto", upto).filter((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("n") <= F.col("rank")))
        chosen = cut_lineage(chosen.select(*place, (F.col("rank") - (F.col("upto") - F.col("n"))).alias("rank"), "least", "most", "n"))
        settled = chosen.filter((F.col("least") == F.col("most")) | (F.col("n") <= hot_rows))
        found = settled if found is None else found.unionByName(settled)
        open_ranges = chosen.filter((F.col("least") != F.col("most")) & (F.col("n") > hot_rows)).drop("n")
    single = found.filter(F.col("least") == F.col("most")).select(*keys, "side", F.col("least").alias("x"))
    few = found.filter(F.col("least") != F.col("most")).drop("n")
    few = same(values, few, keys).filter((F.col("x") >= F.col("least")) & (F.col("x") <= F.col("most")))
    few = few.groupBy(*keys, "side", "rank").agg(F.sort_array(F.collect_list("x")).alias("sorted"))  # hot_rows values at most
    middles = single.unionByName(few.select(*keys, "side", F.get("sorted", F.col("rank").cast("int")).alias("x")))
    middle = F.max(F.when(F.col("side") == 0, F.col("x"))), F.max(F.when(F.col("side") == 1, F.col("x")))
    return ordinary.unionByName(middles.groupBy(*keys).agg(F.when(middle[0] == middle[1], middle[0]).otherwise(0.5 * middle[0] + 0.5 * middle[1]).alias(name)))
