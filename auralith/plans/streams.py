"""Streaming queries (run to completion with ``availableNow``; batch and stream give the same table):
R1 incremental ingest + WER filter over document files, R2 stream-stream join of labels and documents, J3/J4 buffered join
of the two sides of conversations, R3 incremental metric table over the event log."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auralith.plans import evaluation, leaderboard
from auralith.plans.tables import table
from auralith.session import ensure_checkpoint_dir
from auralith.streaming import buffered as B
from auralith.streaming import ingest as R

EPOCH_2024 = 1704067200


def incremental_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = R.file_stream(spark, sf_dir, "documents.parquet")
    return R.incremental_apply(spark, docs, evaluation.wer_keep_from, "incremental_ingest")


def stream_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrival = F.timestamp_seconds(F.lit(EPOCH_2024) + F.col("doc_id"))
    docs = R.file_stream(spark, sf_dir, "documents.parquet").select("doc_id", "lang", "source", arrival.alias("d_time"))
    labs = R.file_stream(spark, sf_dir, "labels.parquet").select("doc_id", "quality", "toxic", arrival.alias("l_time"))
    j = R.stream_join(spark, docs, labs, "doc_id", "d_time", "l_time", "10 minutes", "1 minute", "stream_join")
    return j.select("doc_id", "lang", "source", "quality", "toxic")


def stream_buffered_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles (left) and text lengths (right) of the turns of conversations arrive in files of their own, the turns of one
    conversation in different files; one text in eleven never comes. A conversation is joined once all its turns are there on
    both sides; the rows of the others are reported as pending."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/conversations-{uuid.uuid4().hex[:12]}"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.char_length("text").alias("n_chars"))
    sizes = rows.groupBy("conv_id").agg(F.countDistinct("turn").alias("turns"))
    rows.join(sizes, "conv_id").select("conv_id", "turn", "turns", "role").repartition(3, "turn").write.parquet(f"{base}/roles")
    rows.filter((F.col("conv_id") * 7 + F.col("turn")) % 11 != 0).join(sizes, "conv_id").drop("role").repartition(3, F.xxhash64("turn")).write.parquet(f"{base}/texts")
    sides = [B.side(R.file_stream(spark, f"{base}/{folder}", "*.parquet", 2), name, F.col("conv_id"), F.col("turn"), [value], F.col("turns"))
             for folder, name, value in (("roles", "left", "role"), ("texts", "right", "n_chars"))]
    sink, checkpoint = B.buffered_join(spark, *sides, "stream_buffered_join")
    out = sink.unionByName(B.pending(spark, checkpoint))
    return out.select(F.col("group").cast("long").alias("conv_id"), F.col("key").cast("long").alias("turn"), "status",
                      F.get_json_object("left", "$.role").alias("role"), F.get_json_object("right", "$.n_chars").cast("long").alias("n_chars"))


def stream_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = R.file_stream(spark, sf_dir, "events.parquet")
    log = leaderboard.metric_log_from(ev)
    aggs = [F.count(F.lit(1)).alias("n_runs"), F.sum(F.round(F.col("cer_raw") * 100).cast("long")).alias("cer_raw_cents")]
    return R.incremental_aggregate(spark, log, ["model", "dataset"], aggs, "stream_metrics")


SQL = {
    "incremental_ingest": evaluation.SQL["wer_filter_keep"],
    "stream_join": "SELECT doc_id, lang, source, quality, toxic FROM documents JOIN labels USING (doc_id)",
    "stream_buffered_join": """WITH c AS (SELECT conv_id, turn, role, length(text)::BIGINT AS n_chars, (conv_id * 7 + turn) % 11 <> 0 AS comes FROM conversations),
g AS (SELECT conv_id, bool_and(comes) AS complete FROM c GROUP BY conv_id),
j AS (SELECT * FROM c JOIN g USING (conv_id))
SELECT conv_id, turn, 'joined' AS status, role, n_chars FROM j WHERE complete
UNION ALL SELECT conv_id, turn, 'pending', role, NULL FROM j WHERE NOT complete
UNION ALL SELECT conv_id, turn, 'pending', NULL, n_chars FROM j WHERE NOT complete AND comes""",
    "stream_metrics": f"""SELECT event_type AS model,
  CASE WHEN user_id % 3 = 0 THEN '{leaderboard.DATASETS[0]}' WHEN user_id % 3 = 1 THEN '{leaderboard.DATASETS[1]}' ELSE '{leaderboard.DATASETS[2]}' END AS dataset,
  count(*) AS n_runs, sum(round(value * 100)::BIGINT)::BIGINT AS cer_raw_cents FROM events GROUP BY ALL""",
}
