"""Reports that are kept up to date by content (K6, S14) and a predictor learned from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auralith.operators import learned as LN
from auralith.plans.tables import table
from auralith.session import ensure_checkpoint_dir
from auralith.sources.reuse import ResultStore

KEY = ["lang", "source"]


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def corpus_report(docs: DataFrame) -> DataFrame:
    """One row per language and source, over whole texts."""
    return docs.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_docs"), F.count("text").alias("n_texts"), F.sum(F.length("text").cast("long")).alias("n_chars"),
        F.sum(F.size(F.split("text", " ")).cast("long")).alias("n_words"), F.max(F.length("text")).cast("long").alias("longest"))


def report_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6 + S14: the report of all documents is stored, then refreshed after the texts of some keys (by the md5 of the key)
    have changed; ``refreshed_at`` says which version computed a row: 2 for the changed keys, 1 for all others."""
    docs = table(spark, sf_dir, "documents")
    name = F.concat_ws("/", *[F.coalesce(F.col(k), F.lit("")) for k in KEY])
    draft = docs.withColumn("text", F.when(F.substring(F.md5(name), 1, 1) < "6", F.concat("text", F.lit(" draft"))).otherwise(F.col("text")))
    store = ResultStore(spark, _scratch(spark, "report"), KEY)
    store.refresh(draft, corpus_report)
    store.refresh(docs, corpus_report)
    return store.read()


def learned_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1 + X6: the label of every vector by a classifier learned from all labelled vectors, whose weights are stored and
    loaded once per worker; the margin is that of the best label over the second."""
    emb = table(spark, sf_dir, "embeddings")
    path = LN.fit_centroids(emb, "embedding", "label", _scratch(spark, "weights"))
    out = LN.predict_labels(emb, "embedding", path)
    return out.select("vec_id", "label", "predicted", F.round("margin", 4).alias("margin"))


SQL = {
    "report_refresh": """SELECT lang, source, count(*) AS n_docs, count(text) AS n_texts, sum(length(text))::BIGINT AS n_chars,
  sum(len(string_split(text, ' ')))::BIGINT AS n_words, max(length(text))::BIGINT AS longest,
  (CASE WHEN substr(md5(coalesce(lang, '') || '/' || coalesce(source, '')), 1, 1) < '6' AND count(text) > 0 THEN 2 ELSE 1 END)::BIGINT AS refreshed_at
FROM documents GROUP BY lang, source""",
    # the weights written out: a label's mean vector c scores x with c . x - c . c / 2
    "learned_labels": """WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS d FROM embeddings),
w AS (SELECT label AS k, d, avg(x) AS c FROM e WHERE label IS NOT NULL GROUP BY label, d),
s AS (SELECT vec_id, any_value(e.label) AS label, k, sum(c * x) - sum(c * c) / 2 AS score FROM e JOIN w USING (d) GROUP BY vec_id, k),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, k) AS n FROM s)
SELECT vec_id, max(label) AS label, (max(k) FILTER (WHERE n = 1))::BIGINT AS predicted,
  round(max(score) FILTER (WHERE n = 1) - max(score) FILTER (WHERE n = 2), 4) AS margin FROM r WHERE n <= 2 GROUP BY vec_id""",
}
