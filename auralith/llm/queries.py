"""The registered queries of the training-data operators: each reads its whole driver table, calls its operator and
derives the digest columns that the query returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from pyspark.sql import functions as F

from auralith.llm import brown_lm, conversation_repair, doc_sketch, embed_dedup, hard_negatives, language_id, minhash_forest, mixing, packing, substring_dedup, topk, toxicity, warc
from auralith.plans.tables import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.remove_repeats(docs, window=20).select("doc_id", "n_words", "n_removed", "kept_sha256")


def held_out(modulus: int, remainder: int) -> Column:
    """Whether a document stays out of learning: crc32 of its id as text; a null id stays in."""
    return F.coalesce(toxicity.fold(F.col("doc_id"), modulus) == remainder, F.lit(False))


def op2_brown_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = brown_lm.score(docs, brown_lm.fit(docs.filter(~held_out(7, 2))))
    return scored.select("doc_id", held_out(7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(packing.pieces(docs, tokenizer_path(), end_id=1, capacity=4096), capacity=4096)


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), topk.scaled(F.col("embedding"), 1024).alias("v"))
    return topk.top_k(vectors.filter("id % 100 = 0"), vectors, k=10)


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs, columns=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return embed_dedup.near_duplicates(vectors, threshold=0.93).select("vec_id", "n_links", "component_id", "kept")


def op7_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, index = warc.archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    records = warc.read_archive(spark, folder, index, with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash_forest.near_duplicates(docs, percent=85, columns=["doc_id"]).select("doc_id", "n_shingles", "component_id", "kept")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out(5, 0))
    return toxicity.score(docs, model, columns=["doc_id"]).select("doc_id", held_out(5, 0).alias("held_out"), "score", "predicted")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = language_id.fit(docs.filter(~held_out(4, 2)))
    found = language_id.predict(docs, profiles, columns=["doc_id"])
    return found.select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select(F.col("vec_id").alias("id"), label.alias("label"), hard_negatives.scaled(F.col("embedding"), 256).alias("v"))
    return hard_negatives.mine(rows, F.col("id") % 100 == 0)


def op12_document_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = doc_sketch.compare_next(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = [doc_sketch.fingerprint(F.col(c)).alias(n) for c, n in (("sketch", "fingerprint"), ("edited_sketch", "edited_fingerprint"))]
    return docs.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), *kept, "near_edited", "near_next")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversation_repair.report(conversation_repair.damaged(rows), every=rows)


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_brown_lm_scoring": op2_brown_lm_scoring,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_topk_search": op4_topk_search,
    "op5_source_mixing": op5_source_mixing,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_warc_bundles": op7_warc_bundles,
    "op8_minhash_forest": op8_minhash_forest,
    "op9_toxicity": op9_toxicity,
    "op10_language_id": op10_language_id,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_document_sketch": op12_document_sketch,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE_SQL: dict[str, str] = {
    "op4_topk_search": topk.SQL,
    "op5_source_mixing": mixing.SQL,
    "op6_embedding_dedup": embed_dedup.SQL,
    "op7_warc_bundles": warc.SQL,
    "op11_hard_negatives": hard_negatives.SQL,
    "op12_document_sketch": doc_sketch.SQL,
    "op13_conversation_repair": conversation_repair.SQL,
}
