"""Order-dependent operators without a single-task global window.

``dense_index`` gives every row its 0-based position in a total order (the ``row_idx`` contract that replaces the
reference's implicit row order). A plain ``row_number().over(Window.orderBy(...))`` moves every row into one task;
here the table is range-partitioned on the order keys, rows are numbered inside each partition after a local sort,
and a per-partition offset (one row per partition, so its size is bounded by the partition count) is added.
The numbered rows (callers pass keys, not payloads) are written to the shared checkpoint directory first so the numbering cannot change when a lost
executor's tasks are recomputed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auralith.session import cut_lineage


def seeded_key(*parts: Column) -> Column:
    """Reproducible pseudo-random sort key (O4/O8): ``md5`` of the ``:``-joined parts (same in every engine)."""
    return F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))


def unit_draw(*parts: Column) -> Column:
    """Deterministic uniform draw in [0, 1) from the first 32 bits of the md5 of the parts."""
    return F.conv(F.substring(seeded_key(*parts), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def dense_index(df: DataFrame, order: list[Column | str], name: str = "row_idx", partitions: int | None = None,
                checkpoint: bool = True, drop: tuple[str, ...] = ()) -> DataFrame:
    """Add ``name`` = 0-based rank of each row in ``order`` (ties must not exist: include a unique key)."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
    ranged = ranged.drop(*drop)  # columns that only order need not be written
    local = ranged.withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id())
    if checkpoint:
        local = cut_lineage(local)
    counts = local.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_pid", (F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))).alias("_off")
    ).fillna(0, subset=["_off"])
    # one row per partition: broadcasting it is bounded by the partition count, not by the data
    out = local.join(F.broadcast(offsets), "_pid")
    idx = F.col("_off") + (F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33))
    return out.withColumn(name, idx.cast("long")).drop("_pid", "_mid", "_off")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-repartition on a unique key before CPU-heavy per-row work (edit distance, scoring, features).

    Input splits follow file layout, so one large file or one huge document can put most of the quadratic work in a
    single task; hashing the unique row key spreads it evenly, is deterministic on retry (no round-robin sort), and
    uses an explicit partition count so AQE does not coalesce the small-but-expensive partitions back together."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def compute_once(df: DataFrame, **cols: Column) -> DataFrame:
    """Add expensive columns so that they are evaluated exactly once per row, where they appear in the plan.

    Filters on an ordinary computed column are pushed below projections and exchanges with the expression inlined,
    so a normaliser or an edit distance would run before a repartition (in the few input tasks) and again after it.
    Columns produced by a generator cannot be inlined into a pushed-down filter, so emitting them through
    ``inline(array(struct(...)))`` (one output row per input row) pins the evaluation here."""
    packed = F.array(F.struct(*[c.alias(name) for name, c in cols.items()]))
    return df.select("*", F.inline(packed))


def balance(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-repartition only when the input has fewer partitions than the cluster can run at once (for example a
    single-row-group file); a large scan already arrives in many splits and is left as it is (no extra shuffle)."""
    sc = df.sparkSession.sparkContext
    if df.rdd.getNumPartitions() >= sc.defaultParallelism:
        return df
    return df.repartition(sc.defaultParallelism, *keys)


def chunk_ids(row_idx: Column, n_rows: Column | int, num_chunks: int) -> Column:
    """``size // num_chunks`` rows per chunk, remainder spills into extra chunks; fewer rows than chunks is an
    error (step 0), as in the reference."""
    step = F.floor(F.lit(n_rows) / F.lit(num_chunks)) if isinstance(n_rows, int) else F.floor(n_rows / F.lit(num_chunks))
    return F.when(step > 0, F.floor(row_idx / step)).otherwise(
        F.raise_error(F.lit(f"chunking: fewer rows than {num_chunks} chunks"))
    ).cast("long")


def top_n_threshold(df: DataFrame, col: str, n: int):
    """Value of the n-th largest ``col`` (None when fewer rows): a bounded top-k, merged from per-partition tops."""
    rows = df.select(col).orderBy(F.col(col).desc()).limit(n).collect()
    return rows[-1][0] if len(rows) == n else None
