"""Audit, routing and slicing queries: missing chunk ids from table names (T21/U4/O2), per-recording segment cuts
(J4), the strict duration window on prefix-cut waveforms (F2/O9), per-column spec normalisation (P9) and member /
catalog routing (F11/F10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auralith.functions import text as T
from auralith.functions.text import chunk_id_from_name
from auralith.operators import segments as G
from auralith.operators import shaping as SH
from auralith.plans import sqlkit as S
from auralith.plans.tables import table

N_CHUNKS = 82
RATE = 16


def missing_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status-log audit: every order names a finished table ``corpus.all_<k>.wer_10`` with k = 2 * (o_orderkey % 37) + 1, so that
    chunks stay missing at every size; report the expected chunk ids 1..82 that have no table, in order."""
    names = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("corpus.all_"), (F.col("o_orderkey") % 37 * 2 + 1).cast("string"), F.lit(".wer_10")).alias("name"))
    present = names.select(chunk_id_from_name(F.col("name")).alias("chunk_id")).distinct()
    expected = spark.range(1, N_CHUNKS + 1).select(F.col("id").cast("int").alias("chunk_id"))
    return expected.join(present, "chunk_id", "left_anti").orderBy("chunk_id")


def segment_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation turn is a segment of the recording ``vec_id = conv_id`` (0.5 s per turn, 1 s long)."""
    segs = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("vec_id"), "turn", (F.col("turn") * 0.5).alias("start"), (F.col("turn") * 0.5 + 1.0).alias("end"))
    audio = table(spark, sf_dir, "embeddings")
    return G.segment_audio(segs, audio, "vec_id", "embedding", RATE).select("vec_id", "turn", "segment")


MIN_S, MAX_S = 0.5, 3.0


def duration_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2 + O9: each waveform cut to its first ``8 * (vec_id % 9)`` samples, then kept when
    ``int(min * rate) < n < int(max * rate)`` (both bounds strict)."""
    emb = table(spark, sf_dir, "embeddings")
    cut = F.slice(F.col("embedding"), 1, (F.col("vec_id") % 9 * 8).cast("int"))  # O9 with a per-row length
    n = F.size(cut).cast("long")
    lo, hi = int(MIN_S * RATE), int(MAX_S * RATE)
    return emb.select("vec_id", n.alias("input_length")).where((F.col("input_length") > lo) & (F.col("input_length") < hi))


def multi_column_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One column spec ``text,role`` with per-column languages applies the same normaliser to each listed
    column (the spec zip keeps the shortest list)."""
    specs = SH.column_specs("text,role,extra", "en,en")
    conv = table(spark, sf_dir, "conversations")
    out = SH.apply_per_column(conv, [c for c, _ in specs], T.basic_normalize, prefix="norm_")
    return out.select("conv_id", "turn", *[f"norm_{c}" for c, _ in specs])


def member_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F11 + F10: archive member names derived from documents routed by suffix/prefix, and catalog names derived
    from page URLs filtered by ``contains``/``endswith``/``not contains``; counts per route."""
    docs = table(spark, sf_dir, "documents")
    suffix = F.element_at(F.array(F.lit(".flac"), F.lit(".trans.txt"), F.lit(".stm"), F.lit(".sph")), (F.col("doc_id") % 4 + 1).cast("int"))
    name = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("clips/"), F.col("doc_id").cast("string"), F.lit(".mp3"))).otherwise(
        F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), suffix))
    members = docs.select(SH.member_kind(name).alias("route")).groupBy("route").agg(F.count(F.lit(1)).alias("n"))
    urls = table(spark, sf_dir, "pages").select(F.col("url"))
    cat = urls.where(SH.catalog_filter(F.col("url"), contains=".example.", not_contains="ref=")).select(
        F.when(SH.catalog_filter(F.col("url"), endswith="#top"), F.lit("catalog_top")).otherwise(F.lit("catalog")).alias("route"))
    return members.unionByName(cat.groupBy("route").agg(F.count(F.lit(1)).alias("n")))


SQL = {
    "duration_filter": f"""SELECT vec_id, len(list_slice(embedding, 1, (vec_id % 9 * 8)::INTEGER)) AS input_length FROM embeddings
WHERE len(list_slice(embedding, 1, (vec_id % 9 * 8)::INTEGER)) > {int(MIN_S * RATE)}
  AND len(list_slice(embedding, 1, (vec_id % 9 * 8)::INTEGER)) < {int(MAX_S * RATE)}""",
    "multi_column_clean": f"""SELECT conv_id, turn, {S.basic_normalize('text')} AS norm_text, {S.basic_normalize('role')} AS norm_role
FROM conversations""",
    "member_routing": """WITH m AS (SELECT CASE WHEN doc_id % 5 = 0 THEN 'clips/' || doc_id || '.mp3'
                     ELSE source || '/' || doc_id || ['.flac', '.trans.txt', '.stm', '.sph'][doc_id % 4 + 1] END AS name FROM documents),
r AS (SELECT CASE WHEN ends_with(name, '.flac') THEN 'audio' WHEN ends_with(name, '.trans.txt') THEN 'transcript'
                  WHEN ends_with(name, '.sph') THEN 'audio' WHEN ends_with(name, '.stm') THEN 'segments'
                  WHEN starts_with(name, 'clips/') THEN 'clip' ELSE 'other' END AS route FROM m),
c AS (SELECT CASE WHEN ends_with(url, '#top') THEN 'catalog_top' ELSE 'catalog' END AS route FROM pages
      WHERE contains(url, '.example.') AND NOT contains(url, 'ref='))
SELECT route, count(*) AS n FROM r GROUP BY route UNION ALL SELECT route, count(*) FROM c GROUP BY route""",
    "missing_chunks": f"""WITH p AS (SELECT DISTINCT regexp_extract('corpus.all_' || (o_orderkey % 37 * 2 + 1) || '.wer_10',
                                    '\\.all_(\\d+)\\.wer_', 1)::INTEGER AS chunk_id FROM orders)
SELECT range::INTEGER AS chunk_id FROM range(1, {N_CHUNKS + 1}) WHERE range NOT IN (SELECT chunk_id FROM p) ORDER BY 1""",
    "segment_audio": f"""WITH s AS (SELECT c.conv_id AS vec_id, c.turn, e.embedding, floor(c.turn * 0.5 * {RATE})::INTEGER AS a,
       least(floor((c.turn * 0.5 + 1.0) * {RATE})::INTEGER, len(e.embedding)) AS z
     FROM conversations c JOIN embeddings e ON e.vec_id = c.conv_id)
SELECT vec_id, turn, list_slice(embedding, a + 1, greatest(z, a)) AS segment FROM s""",
}
