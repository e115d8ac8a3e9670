"""Metric-log operators: compaction (O1 + A9), labels (J9 + T20), leaderboard pivot (A7), trial statistics
(A6 + W9), runtime pivot (A8) and optional equality (F9).

Everything is an aggregate keyed by run parameters: ``min_by``/``max_by`` pick "first"/"last" rows by an explicit
order key (partial aggregation, no sort of a whole group); pivots take their column values explicitly so no extra
distinct-values job runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auralith.functions.text import pandas_round
from auralith.operators.ordering import dense_index

# Display names of the leaderboard's dataset dimension (dataset id -> pretty name); unknown ids show as they are.
PRETTY_DATASET_NAMES = [
    ("corpus/ja.jsut_basic5000", "JSUT Basic 5000"),
    ("corpus/ja.common_voice_8_0", "CommonVoice 8 (Japanese test set)"),
    ("corpus/ja.reazonspeech_test", "ReazonSpeech (held out test set)"),
    ("corpus/en.esb_eval", "ESB"),
    ("corpus/ja2en.s2t_translation", "Translation (Ja->En)"),
    ("corpus/en2ja.s2t_translation", "Translation (En->Ja)"),
]
SORT_KEYS = ["dataset", "model", "chunk_length_s", "translation_model", "punctuator", "stable_ts"]
DEDUP_KEYS = ["dataset", "dataset_config", "dataset_split", "model", "chunk_length_s", "translation_model",
              "punctuator", "stable_ts"]
METRICS = ["cer_raw", "wer_raw", "cer_norm", "wer_norm"]


def nulls_last_key(cols: list[str], tiebreak: str) -> Column:
    """O1 as a comparable struct: ascending, NULLs last, then the file position (stable sort)."""
    fields = []
    for i, c in enumerate(cols):
        fields += [F.col(c).isNull().alias(f"n{i}"), F.col(c).alias(f"v{i}")]
    return F.struct(*fields, F.col(tiebreak).alias("pos"))


def compact_metric_log(log: DataFrame, language: str, task: str, pos: str = "file_pos") -> DataFrame:
    """F8 + O1 + A9: keep ``language``/``task`` rows, then the first row (in sorted, stable order) of every
    duplicate group of the eight run keys. Within a group the sort keys are equal, so "first" is the smallest file
    position; NULL keys group together (pandas treats NaN as equal)."""
    rows = log.where((F.col("language") == language) & (F.col("task") == task))
    others = [c for c in rows.columns if c not in DEDUP_KEYS]
    packed = F.struct(*[F.col(c) for c in others])
    return rows.groupBy(*DEDUP_KEYS).agg(F.min_by(packed, F.col(pos)).alias("_r")).select(*DEDUP_KEYS, "_r.*")


def dataset_label(spark, dataset: Column, config: Column) -> tuple[DataFrame, Column]:
    dim = spark.createDataFrame(PRETTY_DATASET_NAMES, "dataset_key string, pretty string")
    label = F.concat(
        F.lit("["), F.coalesce(F.col("pretty"), dataset), F.lit("](https://huggingface.co/datasets/"), dataset, F.lit(")"),
        F.when(config.isNotNull(), F.concat(F.lit(" ("), config, F.lit(")"))).otherwise(F.lit("")),
    )
    return dim, label


def with_dataset_label(df: DataFrame, out: str = "dataset_label") -> DataFrame:
    """Pretty name when known (left join on the fixed dimension of known names), raw name otherwise, plus `` (config)``."""
    dim, label = dataset_label(df.sparkSession, F.col("dataset"), F.col("dataset_config"))
    j = df.join(F.broadcast(dim), df["dataset"] == dim["dataset_key"], "left")
    return j.withColumn(out, label).drop("dataset_key", "pretty")


def model_label(m: Column, p: Column, s: Column, t: Column) -> Column:
    """Markdown link with the flag suffix; a NULL flag counts as false, a NULL translation model as absent."""
    link = F.format_string("[%s](https://huggingface.co/%s)", m, m)
    p, s = F.coalesce(p, F.lit(False)), F.coalesce(s, F.lit(False))
    return (
        F.when(p & s, F.concat(link, F.lit(" (punctuator + stable-ts)")))
        .when(s, F.concat(link, F.lit(" (stable-ts)")))
        .when(p, F.concat(link, F.lit(" (punctuator)")))
        .when(t.isNotNull(), F.concat(link, F.format_string(" ([%s](https://huggingface.co/%s))", t, t)))
        .otherwise(link)
    )


def leaderboard(compacted: DataFrame, metric: str, columns: list[str], pos: str = "file_pos") -> DataFrame:
    """rows = model label, columns = dataset label, cell = first non-NULL value in sorted order (pandas
    ``aggfunc='first'``), values rounded half-to-even to one digit as the display does."""
    df = with_dataset_label(compacted).withColumn(
        "model_label", model_label(F.col("model"), F.col("punctuator"), F.col("stable_ts"), F.col("translation_model"))
    )
    v = pandas_round(F.col(metric), 1)
    okey = nulls_last_key(SORT_KEYS, pos)
    return (
        df.withColumn("_v", v).withColumn("_k", F.when(F.col("_v").isNotNull(), okey))
        .groupBy("model_label").pivot("dataset_label", columns).agg(F.min_by("_v", "_k"))
    )


def leaderboard_long(compacted: DataFrame, metrics: list[str] = METRICS, pos: str = "file_pos") -> DataFrame:
    """A7 in long form, every dataset label and all metrics at once: (model_label, dataset_label, metric, value). Nothing
    has to be listed beforehand, so no label is left out."""
    df = with_dataset_label(compacted).withColumn(
        "model_label", model_label(F.col("model"), F.col("punctuator"), F.col("stable_ts"), F.col("translation_model")))
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), pandas_round(F.col(m), 1).alias("value")) for m in metrics]))
    okey = nulls_last_key(SORT_KEYS, pos)
    df = df.withColumn("_k", okey).select("model_label", "dataset_label", "_k", cells.alias("_c")).select("*", "_c.*")
    return df.where(F.col("value").isNotNull()).groupBy("model_label", "dataset_label", "metric").agg(F.min_by("value", "_k").alias("value"))


def sorted_log(log: DataFrame, pos: str = "file_pos") -> DataFrame:
    """O1 + K5b: the log's rows numbered in display order (sort keys ascending, NULLs last, then file position). Only the
    keys are ordered; the rows are joined to their numbers."""
    keys = log.select(*SORT_KEYS, pos)
    order = [k for c in SORT_KEYS for k in (F.col(c).isNull(), F.col(c))] + [F.col(pos)]
    index = dense_index(keys, order, name="row_idx").select(pos, "row_idx")
    return log.join(index, pos)


def drop_first_trial(runs: DataFrame, keys: list[str], ts: str, tiebreak: str) -> DataFrame:
    """W9 without a per-group sort: the warm-up trial of each group is found by a partial ``min_by`` aggregate and
    removed with an anti-join on its unique id (shuffled by id, so a hot group does not land in one task)."""
    first = runs.groupBy(*keys).agg(F.min_by(F.col(tiebreak), F.struct(F.col(ts), F.col(tiebreak))).alias(tiebreak))
    return runs.join(first.select(tiebreak), tiebreak, "left_anti")


def trial_stats(runs: DataFrame, keys: list[str], value: str, ts: str, tiebreak: str,
                decimals: int | None = None) -> DataFrame:
    """Drop the first trial, then count, mean and sample standard deviation per configuration.

    With ``decimals`` the values are fixed-point (``round(v * 10**decimals)`` exact integers): the sums are exact
    and independent of partitioning and task order, so the result is bit-for-bit reproducible at any scale;
    mean = S1 / (n * 10**d), std = sqrt((n*S2 - S1^2) / (n * (n - 1))) / 10**d."""
    rest = drop_first_trial(runs, keys, ts, tiebreak)
    if decimals is None:
        return rest.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n_trials"), F.avg(value).alias("time_mean"), F.stddev_samp(value).alias("time_std"),
        )
    unit = float(10 ** decimals)
    q = F.round(F.col(value) * F.lit(unit)).cast("decimal(38,0)")
    agg = rest.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_trials"), F.sum(q).alias("_s1"), F.sum(q * q).alias("_s2"))
    n = F.col("n_trials")
    num = n.cast("decimal(38,0)") * F.col("_s2") - F.col("_s1") * F.col("_s1")
    std = F.sqrt(num.cast("double") / (n * (n - 1)).cast("double")) / F.lit(unit)
    return agg.select(*keys, "n_trials", (F.col("_s1").cast("double") / (n * F.lit(unit))).alias("time_mean"),
                      F.when(n > 1, std).alias("time_std"))


def optional_eq(c: str, value) -> Column:
    """``col == value``, or ``col IS NULL`` when value is None (null-safe equality covers both)."""
    return F.col(c).eqNullSafe(F.lit(value))
