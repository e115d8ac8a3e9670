"""Profile and array queries: corpus profile (A3/A4/L9), second-based slices (L10), chunk explode (M4), spaced
index maps (L11), punctuation repair (T19) and the parameter-share report (P13).

``embeddings.embedding`` (64 floats) stands in for a waveform sampled at 16 Hz; ``label`` names the dataset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auralith.functions import labels as L
from auralith.functions import text as T
from auralith.functions.text import pandas_round
from auralith.operators import profile as PR
from auralith.operators import segments as G
from auralith.operators import vocabulary as V
from auralith.plans import derived as D
from auralith.plans.tables import table

RATE = 16
CHUNK_S = 1.5


def corpus_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4 per dataset (= embedding label) over rows that have both a waveform and a transcript (vec_id = doc_id)."""
    emb = table(spark, sf_dir, "embeddings")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    rows = emb.join(docs, "vec_id")
    return PR.profile(rows, "label", "embedding", RATE, "text", V.Vocabulary(V.letter_vocabulary(spark)).ids)


def slice_by_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    start = (F.col("vec_id") % 3) * F.lit(0.5)
    end = start + F.lit(1.5) + (F.col("vec_id") % 4) * F.lit(0.7)
    return emb.select("vec_id", G.slice_seconds(F.col("embedding"), RATE, start, end).alias("segment"))


def chunk_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    return G.chunk_explode(emb.select("vec_id", "embedding"), "embedding", RATE, CHUNK_S).select("vec_id", "chunk_idx", "chunk")


def spaced_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L11 on every waveform: k = 2 + vec_id % 6 evenly spaced samples, and the layer-map variant's index list."""
    emb = table(spark, sf_dir, "embeddings")
    n = F.size("embedding")
    k = F.lit(2) + (F.col("vec_id") % 6).cast("int")
    idx = L.spaced_index(n, k)
    layers = L.spaced_index(n, k, F.floor(n / k).cast("int") - 1)
    return emb.select(
        "vec_id", idx.alias("idx"), layers.alias("layer_idx"),
        F.transform(idx, lambda i: F.element_at(F.col("embedding"), i + 1)).alias("picked"),
    )


def punct_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T19 over every document line, with full stops turned into ``。`` as the punctuation model would."""
    utts = D.utterances(table(spark, sf_dir, "documents"))
    punctuated = F.replace(F.col("reference_raw"), F.lit("."), F.lit("。"))
    return utts.select("doc_id", "line_no", T.punct_repair(F.col("reference_raw"), punctuated).alias("text"))


def model_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P13 report shape over lineitem per supplier: full = total quantity, part = returned quantity, rest, share %
    rounded to one digit, and thousands-formatted counts."""
    li = table(spark, sf_dir, "lineitem")
    agg = li.groupBy("l_suppkey").agg(
        F.sum(F.col("l_quantity").cast("long")).alias("full"),
        F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity").cast("long")).otherwise(F.lit(0))).alias("part"),
    )
    return agg.select(
        "l_suppkey", "full", "part", (F.col("full") - F.col("part")).alias("rest"),
        pandas_round(F.col("part") / F.col("full") * 100, 1).alias("share_pct"),
        F.format_number(F.col("full"), 0).alias("full_fmt"),
        F.format_number(F.col("full") - F.col("part"), 0).alias("rest_fmt"),
    )


def _r6(x: str) -> str:
    return f"round_even(({x}) * 1000000, 0) / 1000000"


SQL = {
    "corpus_profile": f"""WITH r AS (SELECT e.label, len(e.embedding) / {RATE}.0 AS duration, list_max(e.embedding)::DOUBLE AS amax,
       list_min(e.embedding)::DOUBLE AS amin, list_reduce(list_transform(e.embedding, lambda v: v::DOUBLE), lambda a, b: a + b, 0.0::DOUBLE) / len(e.embedding) AS amean,
       length(d.text) AS n_chars, len({V.letter_ids_sql('d.text')}) AS n_tokens
     FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id)
SELECT label, count(*) AS total_data_size,
  {_r6('sum(duration)')} AS total_audio_duration, sum(n_chars)::BIGINT AS total_characters,
  {_r6('avg(duration)')} AS duration_mean, max(duration) AS duration_max, min(duration) AS duration_min,
  {_r6('avg(amax)')} AS amplitude_max_mean, max(amax) AS amplitude_max_max, min(amax) AS amplitude_max_min,
  {_r6('avg(amin)')} AS amplitude_min_mean, max(amin) AS amplitude_min_max, min(amin) AS amplitude_min_min,
  {_r6('avg(amean)')} AS amplitude_mean_mean, max(amean) AS amplitude_mean_max, min(amean) AS amplitude_mean_min,
  {_r6('avg(n_chars)')} AS character_length_mean, max(n_chars) AS character_length_max, min(n_chars) AS character_length_min,
  {_r6('avg(n_tokens)')} AS token_length_mean, max(n_tokens) AS token_length_max, min(n_tokens) AS token_length_min
FROM r GROUP BY label""",
    "slice_by_seconds": f"""WITH s AS (SELECT vec_id, embedding, (vec_id % 3) * 0.5::DOUBLE AS st,
       (vec_id % 3) * 0.5::DOUBLE + 1.5::DOUBLE + (vec_id % 4) * 0.7::DOUBLE AS en FROM embeddings),
b AS (SELECT vec_id, embedding, floor(st * {RATE})::INTEGER AS a, least(floor(en * {RATE})::INTEGER, len(embedding)) AS z FROM s)
SELECT vec_id, list_slice(embedding, a + 1, greatest(z, a)) AS segment FROM b""",
    "chunk_explode": f"""WITH c AS (SELECT vec_id, embedding, unnest(range(0, len(embedding), {int(round(CHUNK_S * RATE))})) AS frm,
       unnest(range(len(range(0, len(embedding), {int(round(CHUNK_S * RATE))})))) AS chunk_idx FROM embeddings)
SELECT vec_id, chunk_idx, list_slice(embedding, frm + 1, frm + {int(round(CHUNK_S * RATE))}) AS chunk FROM c""",
    "spaced_index": """WITH k AS (SELECT vec_id, embedding, len(embedding) AS n, 2 + vec_id % 6 AS k FROM embeddings),
i AS (SELECT vec_id, embedding,
   list_transform(range(0, k), lambda j: CASE WHEN j = k - 1 THEN n - 1 ELSE floor(j::DOUBLE * ((n - 1)::DOUBLE / greatest(k - 1, 1)::DOUBLE))::INTEGER END) AS idx,
   list_transform(range(0, k), lambda j: CASE WHEN j = k - 1 THEN n - 1 ELSE floor(j::DOUBLE * ((n - 1 - (n // k - 1))::DOUBLE / greatest(k - 1, 1)::DOUBLE) + (n // k - 1)::DOUBLE)::INTEGER END) AS layer_idx
 FROM k)
SELECT vec_id, idx::INTEGER[] AS idx, layer_idx::INTEGER[] AS layer_idx, list_transform(idx, lambda j: embedding[j + 1]) AS picked FROM i""",
    "punct_repair": f"""WITH u AS ({D.SQL_UTTERANCES}),
p AS (SELECT doc_id, line_no, reference_raw AS raw, replace(reference_raw, '.', '。') AS s FROM u),
q AS (SELECT *, replace(s, '。', '') AS bare, length(s) - length(replace(s, '。', '')) AS n_marks,
             length(s) - strpos(reverse(s), '。') AS last_idx FROM p)
SELECT doc_id, line_no, CASE WHEN contains(s, 'unk') THEN raw
  WHEN n_marks > 1 THEN substr(bare, 1, least(last_idx, length(bare))) || '。' || substr(bare, least(last_idx, length(bare)) + 1)
  ELSE s END AS text FROM q""",
    "model_ratio": """WITH a AS (SELECT l_suppkey, sum(l_quantity::BIGINT)::BIGINT AS "full",
       sum(CASE WHEN l_returnflag = 'R' THEN l_quantity::BIGINT ELSE 0 END)::BIGINT AS part FROM lineitem GROUP BY l_suppkey)
SELECT l_suppkey, "full", part, "full" - part AS rest, round_even(part / "full" * 100 * 10, 0) / 10 AS share_pct,
       format('{:,}', "full") AS full_fmt, format('{:,}', "full" - part) AS rest_fmt FROM a""",
}
