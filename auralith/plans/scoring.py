"""Scoring queries: pseudo-labels from a pluggable predictor (M1; ids and needed columns travel through the Arrow
pass, so nothing is joined back), the two-stage cascade (M2) and log-mel features (M3). The test predictors are
deterministic, so M1/M2 have exact SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auralith.operators import scoring as SC
from auralith.operators.ordering import balance
from auralith.plans import derived as D
from auralith.plans.tables import table

RATE, N_FFT, HOP, N_MELS = 16, 16, 8, 4


def pseudo_label_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    utts = D.utterances(table(spark, sf_dir, "documents"))
    keys = ["doc_id", "line_no"]
    labelled = SC.score_heads(utts, keys, {"whisper_transcript": (["reference_raw"], SC.corrupting_predictor)}, carry=["lang"])
    return labelled.select("doc_id", "line_no", "lang", "whisper_transcript")


def cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    utts = D.utterances(table(spark, sf_dir, "documents"))
    return SC.cascade(utts, ["doc_id", "line_no"], ["reference_raw"], SC.corrupting_predictor, SC.reversing_translator)


def logmel(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = balance(table(spark, sf_dir, "embeddings"), "vec_id")
    return SC.log_mel(emb, ["vec_id"], "embedding", RATE, N_FFT, HOP, N_MELS)


def logmel_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3 in long form: one row per vector, frame and mel band, to four decimals."""
    out = logmel(spark, sf_dir).select("vec_id", F.posexplode("input_features").alias("frame", "bands"))
    out = out.select("vec_id", "frame", F.posexplode("bands").alias("mel", "value"))
    return out.select("vec_id", "frame", "mel", F.round(F.col("value").cast("double"), 4).alias("value"))


def _logmel_sql() -> str:
    """The transform written out: windowed cosine and sine sums per frequency, triangular bands, clamped logarithm."""
    bands = [[float(x) for x in row] for row in SC.mel_filterbank(N_FFT, N_MELS, float(RATE))]
    part = "list_sum(list_transform(range({n}), lambda i: s[f * {hop} + i + 1] * (0.5 - 0.5 * cos(2 * pi() * i / {n})) * {fn}(2 * pi() * k * i / {n})))"
    re, im = (part.format(n=N_FFT, hop=HOP, fn=fn) for fn in ("cos", "sin"))
    return f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS s FROM embeddings WHERE len(embedding) >= {N_FFT}),
fr AS (SELECT vec_id, s, unnest(range(1 + (len(s) - {N_FFT}) // {HOP})) AS f FROM e),
fk AS (SELECT vec_id, f, s, unnest(range({N_FFT // 2 + 1})) AS k FROM fr),
pw AS (SELECT vec_id, f, k, {re} AS a, {im} AS b FROM fk),
ml AS (SELECT vec_id, f, m, greatest(sum((a * a + b * b) * ({bands}::DOUBLE[][])[m + 1][k + 1]), 1e-10) AS p
       FROM pw CROSS JOIN (SELECT unnest(range({N_MELS})) AS m) GROUP BY vec_id, f, m),
lg AS (SELECT *, max(log10(p)) OVER (PARTITION BY vec_id) AS top FROM ml)
SELECT vec_id, f::INT AS frame, m::INT AS mel, round(((greatest(log10(p), top - 8.0) + 4.0) / 4.0)::FLOAT::DOUBLE, 4) AS value FROM lg"""


SQL = {
    "logmel_frames": _logmel_sql(),
    "pseudo_label_scores": f"WITH u AS ({D.SQL_UTTERANCES}) SELECT doc_id, line_no, lang, {D.SQL_CORRUPT} AS whisper_transcript FROM u",
    "cascade": f"""WITH u AS ({D.SQL_UTTERANCES}), a AS (SELECT doc_id, line_no, {D.SQL_CORRUPT} AS text_asr FROM u)
SELECT doc_id, line_no, array_to_string(list_reverse(string_split(text_asr, ' ')), ' ') AS text, text_asr FROM a""",
}
