"""Corpus profile (A3/A4/L9): per-row waveform and transcript measures, folded into one aggregate per dataset.

The running sum/max/min accumulator of the reference is exactly a partial + final hash aggregate; the nested
report is a projection of the flat row (``to_report``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auralith.functions.text import pandas_round

MEASURES = ["duration", "amplitude_max", "amplitude_min", "amplitude_mean", "character_length", "token_length"]


def _r6(c: Column) -> Column:
    return pandas_round(c, 6)


def row_measures(df: DataFrame, samples: str, rate: int, text: str, tokens) -> DataFrame:
    """Size, max, min and mean of the samples; code-point and token lengths of the transcript."""
    s = F.col(samples)
    return df.select(
        "*",
        (F.size(s) / F.lit(float(rate))).alias("duration"),
        F.array_max(s).cast("double").alias("amplitude_max"),
        F.array_min(s).cast("double").alias("amplitude_min"),
        (F.aggregate(s, F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double")) / F.size(s)).alias("amplitude_mean"),
        F.char_length(F.col(text)).cast("long").alias("character_length"),
        F.size(tokens(F.col(text))).cast("long").alias("token_length"),
    )


def profile(df: DataFrame, dataset: str, samples: str, rate: int, text: str, tokens) -> DataFrame:
    m = row_measures(df, samples, rate, text, tokens)
    aggs = [F.count(F.lit(1)).alias("total_data_size"), _r6(F.sum("duration")).alias("total_audio_duration"),
            F.sum("character_length").alias("total_characters")]
    for c in MEASURES:
        aggs += [_r6(F.avg(c)).alias(f"{c}_mean"), F.max(c).alias(f"{c}_max"), F.min(c).alias(f"{c}_min")]
    return m.groupBy(dataset).agg(*aggs)


def to_report(flat: DataFrame, dataset: str) -> DataFrame:
    """Nested report ``{audio: {duration: {mean, max, min}, ...}, transcription: {...}, totals}`` as JSON per dataset."""
    def trio(c):
        return F.struct(F.col(f"{c}_mean").alias("mean"), F.col(f"{c}_max").alias("max"), F.col(f"{c}_min").alias("min"))

    report = F.struct(
        F.struct(*[trio(c).alias(c) for c in MEASURES[:4]]).alias("audio"),
        F.struct(*[trio(c).alias(c) for c in MEASURES[4:]]).alias("transcription"),
        F.col("total_data_size"), F.col("total_audio_duration").alias("total_audio_duration (sec)"),
        F.col("total_characters").alias("total_transcription_size (character)"),
    )
    return flat.select(dataset, F.to_json(report).alias("report"))
