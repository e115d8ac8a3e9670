"""The corpus pipeline: five stages from raw documents to packed training sequences.

Each stage takes ``(spark, docs, sf_dir)``, works on every row its predecessor kept, and returns a DataFrame; ``run`` writes it
as Parquet below the session's ``spark.checkpoint.dir`` and reads it again for the next stage. All stages but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auralith.llm import minhash_forest, mixing, packing, substring_dedup, toxicity
from auralith.llm.queries import tokenizer_path
from auralith.llm.store import stored
from auralith.plans.tables import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier does not call toxic."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).filter("predicted = 0").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies (five-word shingles, similarity 0.8 or more). Rows
    of a null id, or of an id that several rows have, are documents of their own: they are linked by a key of id and
    text and come before the others of their group; of rows with the same id and text one stays, but all that
    have no word."""
    repeated = docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").select(F.col("doc_id").alias("again"), F.lit(True).alias("shared"))
    if not repeated.head(1):
        return minhash_forest.near_duplicates(docs, percent=80).filter("kept").select(*docs.columns)
    key = -F.shiftrightunsigned(F.xxhash64("doc_id", F.col("doc_id").isNull(), "text"), 1) - 1
    named = docs.join(repeated, F.col("doc_id").eqNullSafe(F.col("again")), "left").drop("again")
    named = stored(named.withColumn("link", F.when(F.col("shared"), key).otherwise(F.col("doc_id"))), "near-duplicates")
    kept = minhash_forest.near_duplicates(named, id_col="link", percent=80).filter("kept")
    once = kept.filter("shared and n_shingles > 0").dropDuplicates(["link"])
    return kept.filter("shared is null or n_shingles = 0").unionByName(once).select(*docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that an earlier document, or an earlier place, already has."""
    cut = substring_dedup.remove_repeats(docs, window=50, first_level=25).withColumn("text", F.col("kept_text"))
    changed = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", changed).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.emitted(mixing.mix(docs), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document: its place in a sequence of at most 4096 tokens, and its token ids."""
    return packing.pack(packing.pieces(docs, tokenizer_path(), with_ids=True))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("source_mix", mix),
    ("packing", pack),
]

ORACLE_SQL = None  # learned, hashed and packed stages: tested against brute force in tests/llm


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
