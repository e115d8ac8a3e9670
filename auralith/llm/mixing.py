"""Mixing sources to target weights by systematic sampling (operator 5).

Sources in code point order (null last) weigh ``weights`` in turn and share the total size by weight; no target exceeds
``most`` times its source's size, and what is above is reshared by weight until none is (solved at once by sorting
the sources by cap over weight). Every document of a source then expects ``target / source_size`` copies. In each
source the documents are ordered by size and id, the expected copies are prefix-summed, one random offset in [0, 1)
(drawn from the seed and the source's name) is added, and a document is emitted once per integer boundary crossed.
Because the order is by size, the words taken differ from the target by about one document at most.

Order inside a source comes from a range partitioning over (source, size, id) plus one start position per partition
and source, so a source that holds a third of all rows is spread over many tasks. The only single-task step is over
one row per source.

Defined cases: a null text has size 0; a source of total size 0 has target 0 and no copies; null is a source of its
own; repeated rows are separate documents; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auralith.llm.columns import Carried
from auralith.llm.store import shuffle_partitions, stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
SENT_ROWS = 200_000  # rows of per-partition facts (about 20 MB) up to which they are broadcast; beyond, a shuffle join


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def offset(seed: str, source: Column) -> Column:
    """One draw in [0, 1) per source: the first 32 bits of an md5."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), source))
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """``sizes``: one row per source (key, source, source_size). Adds ``target``: one row per source in one task."""
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weighed = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int")))
    weighed = weighed.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    below = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    level = ((F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(below), F.lit(0.0)))
             / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(below), F.lit(0.0))))
    levelled = weighed.withColumn("level", level)
    fits = F.max(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("level"))).over(everything)
    return levelled.select("key", "source_size", F.least(F.col("cap"), F.col("w") * fits).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix",
        weights: tuple[int, ...] = WEIGHTS, most: float = 3.0, columns: list[str] | None = None) -> DataFrame:
    """``docs`` (or its ``columns``, so that texts need not travel) with ``size``, ``source_size``, ``target`` (of its source), ``copies`` and ``taken`` (size times copies)."""
    carried = Carried(docs)
    source = carried.col(source_col).cast("string")
    rows = carried.rows.withColumns({
        "__size": word_count(carried.col(text_col)), "__source": source, "__nameless": source.isNull(),
        "__key": F.coalesce(F.concat(F.lit("="), source), F.lit("null")), "__row": F.xxhash64(*carried.names)})
    order = ["__nameless", "__source", "__size", carried.name(id_col), "__row"]
    kept = docs.columns if columns is None else columns
    rows = rows.drop(*[carried.name(c) for c in docs.columns if c not in kept and c != id_col])
    placed = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    placed = stored(placed.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()})
                    .drop("__nameless", "__row"), "mix")
    runs = stored(placed.groupBy("__part", "__key").agg(F.min("__at").alias("first"), F.count(F.lit(1)).alias("n"),
                                                        F.first("__source").alias("source"), F.sum("__size").alias("size")), "runs")
    before = F.sum("n").over(Window.partitionBy("__key").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = runs.select("__part", "__key", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("__shift"))
    sizes = runs.groupBy(F.col("__key").alias("key")).agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, most).select(F.col("key").alias("__key"), F.col("source_size").alias("__source_size"),
                                                          F.col("target").alias("__target"))
    facts = stored(starts.join(targets, "__key"), "facts")  # one row per partition and source in it
    out = placed.join(F.broadcast(facts) if facts.count() <= SENT_ROWS else facts, ["__part", "__key"])
    expected = F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(F.lit(0.0))
    index = F.col("__at") + F.col("__shift")
    draw = offset(seed, F.col("__key"))
    copies = F.least(F.floor(draw + (index + 1) * expected) - F.floor(draw + index * expected), F.lit(int(most)))
    out = out.withColumn("__copies", copies.cast("int")).withColumn("__taken", F.col("__size") * F.col("__copies"))
    return carried.only(kept).back(out, "size", "source_size", "target", "copies", "taken")


def emitted(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: ``columns`` of every document, once per copy."""
    copies = F.explode(F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies"))))
    return mixed.select(*columns, copies.alias("__copy")).drop("__copy")


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [1.0::DOUBLE, 2.0, 3.0][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::DOUBLE AS w,
             3.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0.0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0.0)) AS level FROM w
      WINDOW b AS (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap, w * max(CASE WHEN level <= cap / w THEN level END) OVER ()) AS target,
             ('0x' || substr(md5('mix:' || coalesce('=' || source, 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM l),
i AS (SELECT d.*, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS e,
             (row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) - 1)::DOUBLE AS k
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * least((floor(u + (k + 1) * e) - floor(u + k * e))::BIGINT, 3))::BIGINT AS taken FROM i
"""
