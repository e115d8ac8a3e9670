"""Error-rate operators: per-pair edit counts, corpus WER/CER (A1/A2), WER filter (F1), label QA report (M6).

Corpus error rates are ratios of sums (sum of edits over sum of reference units), so the aggregation is a plain
partial + final hash aggregate: one shuffle of one small row per partition and group, whatever the corpus size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auralith.functions import edit as E
from auralith.operators.ordering import compute_once


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def with_pair_counts(df: DataFrame, ref, hyp, suffix: str, chars: bool = True) -> DataFrame:
    """Add ``n_ref_words_<s>``, ``word_edits_<s>`` and (optionally) ``n_ref_chars_<s>``, ``char_edits_<s>``."""
    ref, hyp = _c(ref), _c(hyp)
    # cleaned strings once per row; both distances of a pair from one pass through a Python worker
    cr, ch, e = f"_cr_{suffix}", f"_ch_{suffix}", f"_e_{suffix}"
    out = compute_once(df, **{cr: E.jiwer_clean(ref), ch: E.jiwer_clean(hyp)})
    distances = E.word_and_char_levenshtein if chars else E.word_levenshtein
    out = out.withColumn(e, distances(F.col(cr), F.col(ch)))
    out = out.withColumns({f"n_ref_words_{suffix}": F.size(E.words_of_cleaned(F.col(cr))), f"word_edits_{suffix}": F.col(e)["words"]})
    if chars:
        out = out.withColumns({f"n_ref_chars_{suffix}": F.char_length(cr), f"char_edits_{suffix}": F.col(e)["chars"]})
    return out.drop(cr, ch, e)


def ratio_pct(edits: Column, total: Column) -> Column:
    return F.lit(100.0) * F.sum(edits).cast("double") / F.sum(total).cast("double")


def drop_empty_references(df: DataFrame, ref_norm: str = "reference_norm") -> DataFrame:
    """rows whose normalised reference is the empty string are not scored."""
    return df.where(F.length(ref_norm) > 0)


def _with_bounded_distance(df: DataFrame, ref_norm: str, hyp_norm: str, threshold: float) -> DataFrame:
    """``_n`` reference words and ``_d``, the word distance, -1 where it exceeds the threshold; every step is computed once."""
    out = compute_once(df, _cr=E.jiwer_clean(F.col(ref_norm)), _ch=E.jiwer_clean(F.col(hyp_norm)))
    out = out.withColumns({"_n": F.size(E.words_of_cleaned(F.col("_cr"))), "_e": E.word_levenshtein(F.col("_cr"), F.col("_ch"))["words"]})
    out = compute_once(out, _d=F.when(F.col("_e") <= E.wer_bound(F.col("_n"), threshold), F.col("_e")).when(F.col("_e").isNotNull(), F.lit(-1)))
    return out.drop("_cr", "_ch", "_e")


def wer_filter(df: DataFrame, ref_norm: str, hyp_norm: str, threshold: float) -> DataFrame:
    """keep a row iff ``100 * WER(hyp, ref) < threshold`` (strict) on normalised text; a row with an empty
    normalised reference or a NULL hypothesis is dropped."""
    out = _with_bounded_distance(df, ref_norm, hyp_norm, threshold)
    keep = (F.length(ref_norm) > 0) & F.col(hyp_norm).isNotNull() & E.wer_below(F.col("_d"), F.col("_n"), threshold)
    return out.where(keep).drop("_n", "_d")


def with_rejection_reason(df: DataFrame, ref_norm: str, hyp_norm: str, threshold: float, n_samples=None, min_samples=None,
                          max_samples=None, n_labels=None, max_labels=None) -> DataFrame:
    """M6: adds ``reason``, the first failing check in pipeline order, or ``kept``."""
    out = _with_bounded_distance(df, ref_norm, hyp_norm, threshold)
    reason = F.when(F.length(ref_norm) == 0, F.lit("empty_reference")).when(F.col(hyp_norm).isNull(), F.lit("null_prediction"))
    reason = reason.when(~E.wer_below(F.col("_d"), F.col("_n"), threshold), F.lit("wer"))
    if n_samples is not None:
        reason = reason.when(~((_c(n_samples) > min_samples) & (_c(n_samples) < max_samples)), F.lit("duration"))
    if n_labels is not None:
        reason = reason.when(~((_c(n_labels) > 0) & (_c(n_labels) <= max_labels)), F.lit("label_length"))
    return out.withColumn("reason", reason.otherwise(F.lit("kept"))).drop("_n", "_d")
