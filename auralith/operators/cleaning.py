"""Per-corpus transcript cleaners (T5-T11, F6, F7) and line parsers.

Each cleaner is ``DataFrame -> DataFrame`` over a transcript column and keeps the reference's order of steps; rows
that the reference skips (ignore segments, empty after cleaning) are filtered out, never collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auralith.functions import text as T
from auralith.operators.ordering import compute_once


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def not_ignored(c) -> Column:
    """lower-cased text is not one of the ignore segments (exact match)."""
    return ~F.lower(_c(c)).isin(T.IGNORE_SEGMENTS)


def parse_stm(df: DataFrame, value: str = "value") -> DataFrame:
    """``fn channel speaker start end label transcript`` (line stripped, split on the first six spaces)."""
    names = ["fn", "channel", "speaker", "start", "end", "label", "transcript"]
    df = compute_once(df, _parts=F.split(T.strip_ws(_c(value)), " ", 7))
    return df.select(*[c for c in df.columns if c != "_parts"], *[F.col("_parts").getItem(i).alias(n) for i, n in enumerate(names)])


def clean_tedlium(df: DataFrame, transcript: str = "transcript", out: str = "text") -> DataFrame:
    df = compute_once(df, _t0=F.lower(T.trim_paren_suffix(_c(transcript)))).where(not_ignored("_t0"))
    t = T.join_spaced_contractions(F.replace(F.col("_t0"), F.lit(T.TEDLIUM_UNK), F.lit("")))
    df = compute_once(df.drop(out) if out in df.columns else df, **{out: T.jiwer_clean(t)})
    return df.where(F.col(out).isNotNull() & (F.length(out) > 0)).drop("_t0")


def clean_gigaspeech(df: DataFrame, text: str = "text_tn", out: str = "text") -> DataFrame:
    df = df.where(not_ignored(text))
    t = T.spelled_punctuation(T.remove_tokens(F.lower(_c(text)), T.GIGASPEECH_JUNK_TOKENS))
    return compute_once(df.drop(out) if out in df.columns else df, **{out: T.jiwer_clean(t)}).where(F.length(out) > 0)


def clean_earnings(df: DataFrame, text: str = "sentence", out: str = "text") -> DataFrame:
    df = df.where(not_ignored(text))
    t = T.remove_tokens(_c(text), T.EARNINGS_JUNK_TOKENS)
    return compute_once(df.drop(out) if out in df.columns else df, **{out: T.jiwer_clean(t)}).where(F.length(out) > 0)


def clean_common_voice(df: DataFrame, text: str = "sentence", out: str = "text") -> DataFrame:
    return compute_once(df.drop(out) if out in df.columns else df, **{out: T.unquote_sentence(_c(text))}).where(F.length(out) > 0)


def common_voice_path(path, clips_dir: str) -> Column:
    """Append ``.mp3`` when missing, prefix the clip directory."""
    p = _c(path)
    return F.concat(F.lit(clips_dir.rstrip("/") + "/"), F.when(p.endswith(".mp3"), p).otherwise(F.concat(p, F.lit(".mp3"))))


def parse_ami_line(df: DataFrame, split_name: str, value: str = "value") -> DataFrame:
    """First whitespace token is the id (six ``_`` parts), the rest the text; file name ``split_`` + lower(id)."""
    toks = F.split(T.strip_ws(_c(value)), f"{T.WS}+")
    id_ = toks.getItem(0)
    return df.select(
        "*",
        id_.alias("id"),
        F.array_join(F.slice(toks, 2, F.greatest(F.size(toks) - 1, F.lit(0))), " ").alias("text"),
        F.concat(F.lit(split_name + "_"), F.lower(id_), F.lit(".wav")).alias("audio_filename"),
        (F.size(F.split(id_, "_")) == 6).alias("well_formed"),
    )


def parse_librispeech_line(df: DataFrame, value: str = "value") -> DataFrame:
    """Split on the first space into (id, text); text lower-cased."""
    parts = F.split(_c(value), " ", 2)
    return df.select("*", parts.getItem(0).alias("id"), F.lower(parts.getItem(1)).alias("text"))
