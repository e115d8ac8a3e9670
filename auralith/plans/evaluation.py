"""Evaluation queries: corpus WER/CER (A1/A2 raw + normalised), WER filter (F1) and the label QA report (M6).

Input: every line of every document is a reference utterance; the hypothesis is the deterministic corrupting
predictor of ``derived.py``. Normalisation routes by language as in the evaluation (T4).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auralith.functions import text as T
from auralith.operators import labels as LO
from auralith.operators import metrics as M
from auralith.operators.ordering import compute_once, dense_index, spread
from auralith.plans import derived as D
from auralith.plans import sqlkit as S
from auralith.plans.tables import table

WER_THRESHOLD = 20.0


def scored_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    utts = D.with_hypothesis(D.utterances(table(spark, sf_dir, "documents")))
    return M.drop_empty_references(T.with_normalized(utts, "lang", reference_norm="reference_raw", prediction_norm="prediction_raw"))


def _metric_frame(spark, sf_dir, chars: bool) -> DataFrame:
    df = scored_utterances(spark, sf_dir)
    df = M.with_pair_counts(df, "reference_raw", "prediction_raw", "raw", chars=chars)
    return M.with_pair_counts(df, "reference_norm", "prediction_norm", "norm", chars=chars)


def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference's metric row per dataset (here: per language): CER/WER raw and normalised, in percent."""
    df = _metric_frame(spark, sf_dir, chars=True)
    return df.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_utterances"),
        M.ratio_pct(F.col("char_edits_raw"), F.col("n_ref_chars_raw")).alias("cer_raw"),
        M.ratio_pct(F.col("word_edits_raw"), F.col("n_ref_words_raw")).alias("wer_raw"),
        M.ratio_pct(F.col("char_edits_norm"), F.col("n_ref_chars_norm")).alias("cer_norm"),
        M.ratio_pct(F.col("word_edits_norm"), F.col("n_ref_words_norm")).alias("wer_norm"),
    )


def corpus_wer_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _metric_frame(spark, sf_dir, chars=False)
    return df.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_utterances"),
        F.sum("n_ref_words_norm").alias("n_ref_words"),
        F.sum("word_edits_norm").alias("word_edits"),
        M.ratio_pct(F.col("word_edits_raw"), F.col("n_ref_words_raw")).alias("wer_raw"),
        M.ratio_pct(F.col("word_edits_norm"), F.col("n_ref_words_norm")).alias("wer_norm"),
    )


def corpus_cer_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scored_utterances(spark, sf_dir)
    from auralith.functions import edit as E

    df = compute_once(df, cr=E.jiwer_clean(F.col("reference_raw")), hr=E.jiwer_clean(F.col("prediction_raw")),
                      cn=E.jiwer_clean(F.col("reference_norm")), hn=E.jiwer_clean(F.col("prediction_norm")))
    df = (
        df.withColumn("n_raw", F.char_length("cr"))
        .withColumn("e_raw", E.char_edit_distance(F.col("cr"), F.col("hr"), cleaned=True))
        .withColumn("n_norm", F.char_length("cn"))
        .withColumn("e_norm", E.char_edit_distance(F.col("cn"), F.col("hn"), cleaned=True))
    )
    return df.groupBy("lang").agg(
        F.sum("n_norm").alias("n_ref_chars"),
        F.sum("e_norm").alias("char_edits"),
        M.ratio_pct(F.col("e_raw"), F.col("n_raw")).alias("cer_raw"),
        M.ratio_pct(F.col("e_norm"), F.col("n_norm")).alias("cer_norm"),
    )


def wer_filter_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 at threshold 20 on normalised text (filter routing: English normaliser for en, basic for the rest)."""
    return wer_keep_from(table(spark, sf_dir, "documents"))


def wer_keep_from(documents: DataFrame) -> DataFrame:
    utts = D.with_hypothesis(D.utterances(documents))
    df = T.with_normalized(utts, "lang", stage="filter", reference_norm="reference_raw", prediction_norm="prediction_raw")
    kept = M.wer_filter(df, "reference_norm", "prediction_norm", WER_THRESHOLD)
    return kept.select("doc_id", "line_no", "lang", "reference_raw", "prediction_raw")


def wer_filter_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 with T14/T17: on every second line the hypothesis arrives as a printed id list between special ids. The
    vocabulary is every word of the hypotheses, numbered in order, after 100 special ids."""
    keys = ["doc_id", "line_no"]
    lines = D.utterances(table(spark, sf_dir, "documents")).drop("source")
    utts = D.with_hypothesis(lines)
    prints = (F.col("doc_id") + F.col("line_no")) % 2 == 0  # only these lines' words have to meet their ids
    words = utts.select(prints.alias("printed"), F.explode(F.split("prediction_raw", " ")).alias("token"))
    vocab = dense_index(words.groupBy("token").agg(F.count_if("printed").alias("n")), ["token"], name="i")
    n = F.when(F.col("token").rlike(r"^<\|\d+\|>$"), F.lit(0)).otherwise(F.col("n"))  # such words may share a special token's name and are always joined
    vocab = vocab.select((F.col("i") + 100).alias("token_id"), "token", F.lit(False).alias("special"), n.alias("n"))
    vocab = vocab.union(spark.range(100).select("id", F.concat(F.lit("<|"), F.col("id").cast("string"), F.lit("|>")), F.lit(True), F.lit(0)))
    known = LO.KnownTokens(vocab)
    ids = LO.printed_token_ids(utts.where(prints), keys, "prediction_raw", vocab, known)
    printed = F.concat(F.lit("[1 50 "), F.col("ids"), F.lit(" 2]"))
    # the printed lines meet their ids by key; the others stay where they were read
    arrived = spread(lines.where(prints), *keys).join(ids, keys).withColumn("prediction_raw", printed).drop("ids")
    plain = utts.where(~prints & F.col("prediction_raw").isNotNull())
    decoded = [LO.decode_token_text(x, keys, "prediction_raw", vocab, known=known) for x in (arrived, plain)]
    df = T.with_normalized(decoded[0].unionByName(decoded[1]), "lang", stage="filter", reference_norm="reference_raw", prediction_norm="prediction_raw")
    kept = M.wer_filter(df, "reference_norm", "prediction_norm", WER_THRESHOLD)
    return kept.select("doc_id", "line_no", "lang", "reference_raw", "prediction_raw")


def label_qa_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6: kept vs dropped per reason, per language. Duration = characters of the line standing in for samples
    (window 0 < n < 2000), label length = words of the hypothesis (at most 128)."""
    utts = D.with_hypothesis(D.utterances(table(spark, sf_dir, "documents")))
    df = T.with_normalized(utts, "lang", stage="filter", reference_norm="reference_raw", prediction_norm="prediction_raw")
    df = M.with_rejection_reason(
        df, "reference_norm", "prediction_norm", WER_THRESHOLD,
        n_samples=F.char_length("reference_raw"), min_samples=0, max_samples=2000,
        n_labels=F.size(F.split("prediction_raw", " ")), max_labels=128,
    )
    return df.groupBy("lang", "reason").agg(F.count(F.lit(1)).alias("n_rows"))


LATIN, KANA = "abcdefghijklmnopqrstuvwxyz", "あいうえおかきくけこさしすせそたちつてとなにぬねのは"


def japanese_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3 + T4 (``ja`` branch) + A1/A2: every line rewritten in kana (a letter for a letter, ``。`` for a full stop), its
    corrupted copy as hypothesis; one row per source language."""
    kana = F.translate(F.lower(F.col("reference_raw")), LATIN + ".", KANA + "。")
    utts = compute_once(D.utterances(table(spark, sf_dir, "documents")), reference_raw_ja=kana).drop("reference_raw")
    utts = D.with_hypothesis(utts.withColumnRenamed("reference_raw_ja", "reference_raw"))
    df = T.with_normalized(utts, F.lit("ja"), reference_norm="reference_raw", prediction_norm="prediction_raw")
    df = M.with_pair_counts(M.drop_empty_references(df), "reference_norm", "prediction_norm", "norm")
    return df.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_utterances"), F.sum("n_ref_chars_norm").alias("n_ref_chars"), F.sum("char_edits_norm").alias("char_edits"),
        M.ratio_pct(F.col("char_edits_norm"), F.col("n_ref_chars_norm")).alias("cer_norm"),
        M.ratio_pct(F.col("word_edits_norm"), F.col("n_ref_words_norm")).alias("wer_norm"))


def _spelled(n):
    """Number words of 0 .. 999,999, built by division (the way back from digits to words)."""
    from auralith.functions import numbers as N

    def pick(words: list[str], i):
        return F.element_at(F.array(*[F.lit(w) for w in words]), i.cast("int"))

    def below_hundred(x):
        tens, ones = F.floor(x / 10), x % 10
        return F.when(x < 10, pick(N.UNITS, F.greatest(ones, F.lit(1)))).when(x < 20, pick(N.TEENS, F.greatest(x - 9, F.lit(1)))).otherwise(
            F.concat_ws(" ", pick(N.TENS, F.greatest(tens - 1, F.lit(1))), F.when(ones > 0, pick(N.UNITS, F.greatest(ones, F.lit(1))))))

    def below_thousand(x):
        hundreds, rest = F.floor(x / 100), x % 100
        return F.concat_ws(" ", F.when(hundreds > 0, F.concat(pick(N.UNITS, F.greatest(hundreds, F.lit(1))), F.lit(" hundred"))),
                           F.when((hundreds > 0) & (rest > 0), F.lit("and")), F.when(rest > 0, below_hundred(rest)))

    thousands, rest = F.floor(n / 1000), n % 1000
    return F.when(n == 0, F.lit("zero")).otherwise(F.concat_ws(
        " ", F.when(thousands > 0, F.concat(below_thousand(thousands), F.lit(" thousand"))), F.when(rest > 0, below_thousand(rest))))


def english_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2 number words: a spelled-out number derived from each line's key, in four settings, normalised back to digits."""
    utts = D.utterances(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))
    keyed = compute_once(utts.select("doc_id", "line_no"), n=(F.col("doc_id") * 7919 + F.col("line_no") * 104729) % 1000000)
    spoken, k = _spelled(F.col("n")), (F.col("doc_id") + F.col("line_no")) % 4
    line = (F.when(k == 0, F.concat(F.lit("Count "), spoken, F.lit(" of them"))).when(k == 1, F.concat(spoken, F.lit(" percent, nearly")))
            .when(k == 2, F.concat(F.lit("it's "), spoken, F.lit(" dollars"))).otherwise(F.concat(F.lit("minus "), spoken, F.lit(" point "), _spelled(F.col("n") % 10))))
    lines = compute_once(keyed, line=line).withColumn("lang", F.lit("en"))
    return T.with_normalized(lines, "lang", text="line").select("doc_id", "line_no", "text")


# ---- oracles ------------------------------------------------------------------------------------------------------
def _sql_norm(x: str) -> str:
    # T4 (eval): en -> T2, ja -> T3, others -> T1
    return (f"CASE WHEN lang = 'en' THEN {S.english_normalize(x)} "
            f"WHEN lang = 'ja' THEN replace(replace({S.basic_normalize(x)}, ' ', ''), '。.', '。') ELSE {S.basic_normalize(x)} END")


def _sql_filter_norm(x: str) -> str:
    # T4 (filter): en -> T2, every other language -> T1
    return f"CASE WHEN lang = 'en' THEN {S.english_normalize(x)} ELSE {S.basic_normalize(x)} END"


def _sql_scored(norm) -> str:
    return f"""u AS ({D.SQL_UTTERANCES}),
h AS (SELECT *, {D.SQL_CORRUPT} AS prediction_raw FROM u),
n AS (SELECT *, {norm('reference_raw')} AS reference_norm, {norm('prediction_raw')} AS prediction_norm FROM h)"""


_WORDS_CTES = f"""k AS (SELECT *, {S.words('reference_raw')} AS a_raw, {S.words('prediction_raw')} AS b_raw,
                 {S.words('reference_norm')} AS a_norm, {S.words('prediction_norm')} AS b_norm
          FROM n WHERE length(reference_norm) > 0),
{S.edit_distance_cte('e1', 'k', 'a_raw', 'b_raw', 'd_raw')},
{S.edit_distance_cte('e2', 'e1', 'a_norm', 'b_norm', 'd_norm')}"""

_CHAR_CTES = f"""k AS (SELECT *, {S.chars('reference_raw')} AS a_raw, {S.chars('prediction_raw')} AS b_raw,
                 {S.chars('reference_norm')} AS a_norm, {S.chars('prediction_norm')} AS b_norm
          FROM n WHERE length(reference_norm) > 0),
{S.edit_distance_cte('e1', 'k', 'a_raw', 'b_raw', 'd_raw')},
{S.edit_distance_cte('e2', 'e1', 'a_norm', 'b_norm', 'd_norm')}"""


def _pct(e: str, n: str) -> str:
    return f"100.0::DOUBLE * sum({e})::DOUBLE / sum({n})::DOUBLE"


_BASIC_SCORED = f"""u AS ({D.SQL_UTTERANCES}),
h AS (SELECT *, {D.SQL_CORRUPT} AS prediction_raw FROM u),
n AS (SELECT *, {_sql_filter_norm('reference_raw')} AS reference_norm,
                {_sql_filter_norm('prediction_raw')} AS prediction_norm FROM h),
k AS (SELECT *, {S.words('reference_norm')} AS a_norm, {S.words('prediction_norm')} AS b_norm FROM n),
{S.edit_distance_cte('e', 'k', 'a_norm', 'b_norm', 'd')}"""
_KEEP = f"(length(reference_norm) > 0 AND prediction_norm IS NOT NULL AND len(a_norm) > 0 AND 100.0 * d < {WER_THRESHOLD} * len(a_norm))"

def _ja(x: str) -> str:
    return f"replace(replace({S.basic_normalize(x)}, ' ', ''), '。.', '。')"


SQL = {
    "english_numbers": f"""SELECT doc_id, line_no, CASE (doc_id + line_no) % 4 WHEN 0 THEN 'count ' || n || ' of them'
  WHEN 1 THEN n || '% nearly' WHEN 2 THEN 'it is $' || n ELSE '-' || n || '.' || n % 10 END AS text
FROM (SELECT doc_id, line_no, (doc_id * 7919 + line_no * 104729) % 1000000 AS n FROM ({D.SQL_UTTERANCES}) u)""",
    "japanese_metrics": f"""WITH u0 AS ({D.SQL_UTTERANCES}),
u AS (SELECT * REPLACE (translate(lower(reference_raw), '{LATIN}.', '{KANA}。') AS reference_raw) FROM u0),
h AS (SELECT *, {D.SQL_CORRUPT} AS prediction_raw FROM u),
n AS (SELECT *, {_ja('reference_raw')} AS reference_norm, {_ja('prediction_raw')} AS prediction_norm FROM h),
k AS (SELECT *, {S.words('reference_norm')} AS a_norm, {S.words('prediction_norm')} AS b_norm,
             {S.chars('reference_norm')} AS ca_norm, {S.chars('prediction_norm')} AS cb_norm FROM n WHERE length(reference_norm) > 0),
{S.edit_distance_cte('e1', 'k', 'a_norm', 'b_norm', 'd_norm')},
{S.edit_distance_cte('e2', 'e1', 'ca_norm', 'cb_norm', 'cd_norm')}
SELECT lang, count(*) AS n_utterances, sum(len(ca_norm))::BIGINT AS n_ref_chars, sum(cd_norm)::BIGINT AS char_edits,
       {_pct('cd_norm', 'len(ca_norm)')} AS cer_norm, {_pct('d_norm', 'len(a_norm)')} AS wer_norm
FROM e2 GROUP BY lang""",
    "eval_metrics": f"""WITH {_sql_scored(_sql_norm)},
k AS (SELECT *, {S.words('reference_raw')} AS a_raw, {S.words('prediction_raw')} AS b_raw,
                {S.words('reference_norm')} AS a_norm, {S.words('prediction_norm')} AS b_norm,
                {S.chars('reference_raw')} AS ca_raw, {S.chars('prediction_raw')} AS cb_raw,
                {S.chars('reference_norm')} AS ca_norm, {S.chars('prediction_norm')} AS cb_norm
          FROM n WHERE length(reference_norm) > 0),
{S.edit_distance_cte('e1', 'k', 'a_raw', 'b_raw', 'd_raw')},
{S.edit_distance_cte('e2', 'e1', 'a_norm', 'b_norm', 'd_norm')},
{S.edit_distance_cte('e3', 'e2', 'ca_raw', 'cb_raw', 'cd_raw')},
{S.edit_distance_cte('e4', 'e3', 'ca_norm', 'cb_norm', 'cd_norm')}
SELECT lang, count(*) AS n_utterances,
       {_pct('cd_raw', 'len(ca_raw)')} AS cer_raw, {_pct('d_raw', 'len(a_raw)')} AS wer_raw,
       {_pct('cd_norm', 'len(ca_norm)')} AS cer_norm, {_pct('d_norm', 'len(a_norm)')} AS wer_norm
FROM e4 GROUP BY lang""",
    "wer_filter_keep": f"""WITH {_BASIC_SCORED}
SELECT doc_id, line_no, lang, reference_raw, prediction_raw FROM e WHERE {_KEEP}""",
    "label_qa_report": f"""WITH {_BASIC_SCORED}
SELECT lang, CASE WHEN length(reference_norm) = 0 THEN 'empty_reference'
                  WHEN prediction_norm IS NULL THEN 'null_prediction'
                  WHEN NOT {_KEEP} THEN 'wer'
                  WHEN NOT (length(reference_raw) > 0 AND length(reference_raw) < 2000) THEN 'duration'
                  WHEN NOT (len(string_split(prediction_raw, ' ')) > 0 AND len(string_split(prediction_raw, ' ')) <= 128)
                       THEN 'label_length'
                  ELSE 'kept' END AS reason, count(*) AS n_rows
FROM e GROUP BY ALL""",
    "corpus_wer_by_lang": f"""WITH {_sql_scored(_sql_norm)}, {_WORDS_CTES}
SELECT lang, count(*) AS n_utterances, sum(len(a_norm))::BIGINT AS n_ref_words, sum(d_norm)::BIGINT AS word_edits,
       {_pct('d_raw', 'len(a_raw)')} AS wer_raw, {_pct('d_norm', 'len(a_norm)')} AS wer_norm
FROM e2 GROUP BY lang""",
    "corpus_cer_by_lang": f"""WITH {_sql_scored(_sql_norm)}, {_CHAR_CTES}
SELECT lang, sum(len(a_norm))::BIGINT AS n_ref_chars, sum(d_norm)::BIGINT AS char_edits,
       {_pct('d_raw', 'len(a_raw)')} AS cer_raw, {_pct('d_norm', 'len(a_norm)')} AS cer_norm
FROM e2 GROUP BY lang""",
}
# the decoded hypotheses are the raw ones again, so the rows are those of wer_filter_keep
SQL["wer_filter_token_ids"] = SQL["wer_filter_keep"]
