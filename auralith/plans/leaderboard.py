"""Leaderboard queries over a metric log and a runtime log derived from ``events`` (one event = one logged run).

metric log: model = event_type; dataset by ``user_id % 3`` (two known datasets with display names, one unknown);
config NULL or ``cfg<user_id % 2>``; chunk 15/30 s; language ``en`` when ``user_id % 5 = 0`` else ``ja``; task
``translate`` when ``event_id % 7 = 0``; punctuator / stable_ts flags with NULLs; translation model on every 11th
event; metrics from ``value``; file position = ``event_id``.
runtime log: model = event_type; attention sdpa / eager / NULL; duration 10/30/60/300 s; time = value / 10.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auralith.functions.text import pandas_round
from auralith.operators import board as B
from auralith.plans.tables import table
from auralith.session import ensure_checkpoint_dir
from auralith.sources.metriclog import MetricLog

DATASETS = ["corpus/ja.jsut_basic5000", "corpus/ja.common_voice_8_0", "local/extra_set"]
CONFIGS = [None, "cfg0", "cfg1"]
DURATIONS = [10, 30, 60, 300]
NLLB = "facebook/nllb-200-3.3B"


def metric_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_log_from(table(spark, sf_dir, "events"))


def metric_log_from(ev: DataFrame) -> DataFrame:
    u, e = F.col("user_id"), F.col("event_id")
    return ev.select(
        F.col("event_type").alias("model"),
        F.when(u % 3 == 0, F.lit(DATASETS[0])).when(u % 3 == 1, F.lit(DATASETS[1])).otherwise(F.lit(DATASETS[2])).alias("dataset"),
        F.when(u % 4 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("cfg"), (u % 2).cast("string"))).alias("dataset_config"),
        F.lit("test").alias("dataset_split"),
        F.when(u % 2 == 0, F.lit(15)).otherwise(F.lit(30)).alias("chunk_length_s"),
        F.when(u % 5 == 0, F.lit("en")).otherwise(F.lit("ja")).alias("language"),
        F.when(e % 7 == 0, F.lit("translate")).otherwise(F.lit("transcribe")).alias("task"),
        F.when(e % 3 == 0, F.lit(None).cast("boolean")).when(e % 3 == 1, F.lit(False)).otherwise(F.lit(True)).alias("punctuator"),
        F.when(e % 5 == 0, F.lit(None).cast("boolean")).when(e % 5 == 1, F.lit(True)).otherwise(F.lit(False)).alias("stable_ts"),
        F.when(e % 11 == 0, F.lit(NLLB)).alias("translation_model"),
        F.col("value").alias("cer_raw"), (F.col("value") * 2).alias("wer_raw"),
        (F.col("value") / 2).alias("cer_norm"), (F.col("value") * 1.5).alias("wer_norm"),
        e.alias("file_pos"),
    )


def runtime_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    u = F.col("user_id")
    dur = F.when(u % 4 == 0, 10).when(u % 4 == 1, 30).when(u % 4 == 2, 60).otherwise(300)
    return ev.select(
        F.col("event_type").alias("model"),
        F.when(u % 3 == 0, F.lit("sdpa")).when(u % 3 == 1, F.lit("eager")).otherwise(F.lit(None).cast("string")).alias("attention"),
        dur.alias("duration"), (F.col("value") / 10).alias("time"), "ts", "event_id",
    )


def dataset_labels() -> list[str]:
    pretty = dict(B.PRETTY_DATASET_NAMES)
    out = []
    for d in DATASETS:
        for c in CONFIGS:
            out.append(f"[{pretty.get(d, d)}](https://huggingface.co/datasets/{d})" + (f" ({c})" if c else ""))
    return out


def metric_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.compact_metric_log(metric_log(spark, sf_dir), "ja", "transcribe")


def metric_log_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5 + K5b + S13: the log arrives in two appends (by file position), each followed by a compaction; the rows of the last
    version, without their positions, are those of ``metric_dedup``."""
    rows = metric_log(spark, sf_dir)
    log = MetricLog(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/metric-log-{uuid.uuid4().hex[:12]}")
    half = (rows.agg(F.max("file_pos")).first()[0] or 0) // 2
    for part in (rows.filter(F.col("file_pos") <= half), rows.filter(F.col("file_pos") > half)):
        log.append(part.repartitionByRange("file_pos").sortWithinPartitions("file_pos").drop("file_pos"))
        log.compact(lambda held: B.compact_metric_log(held, "ja", "transcribe").drop("file_pos"))
    return log.read().drop("file_pos")


def leaderboard_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.leaderboard(metric_dedup(spark, sf_dir), "wer_norm", dataset_labels())


def leaderboard_of(metric: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return B.leaderboard(metric_dedup(spark, sf_dir), metric, dataset_labels())

    return query


def leaderboard_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.leaderboard_long(metric_dedup(spark, sf_dir))


def sorted_metric_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The compacted log in display order (all rows, all metrics)."""
    return B.sorted_log(metric_dedup(spark, sf_dir))


def trial_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6 ``time (all)`` as rows: every trial of every configuration but the warm-up one. A list per configuration would
    gather a hot configuration in one row."""
    return B.drop_first_trial(runtime_log(spark, sf_dir), ["model", "attention", "duration"], "ts", "event_id").select(
        "model", "attention", "duration", "event_id", "time")


def trial_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    # times are in milliseconds resolution (value / 10 with two decimals): exact fixed-point statistics
    return B.trial_stats(runtime_log(spark, sf_dir), ["model", "attention", "duration"], "time", "ts", "event_id", decimals=3)


def runtime_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8 + F9: attention = sdpa, rows = model, columns = duration, mean of the trial means, rounded to 3."""
    stats = trial_stats(spark, sf_dir).where(B.optional_eq("attention", "sdpa"))
    return stats.groupBy("model").pivot("duration", DURATIONS).agg(pandas_round(F.avg("time_mean"), 3))


def optional_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F9 with the parameter unset: the runs whose attention IS NULL."""
    return trial_stats(spark, sf_dir).where(B.optional_eq("attention", None))


# ---- oracles ------------------------------------------------------------------------------------------------------
_LOG = f"""log AS (SELECT event_type AS model,
  CASE WHEN user_id % 3 = 0 THEN '{DATASETS[0]}' WHEN user_id % 3 = 1 THEN '{DATASETS[1]}' ELSE '{DATASETS[2]}' END AS dataset,
  CASE WHEN user_id % 4 = 0 THEN NULL ELSE 'cfg' || (user_id % 2) END AS dataset_config, 'test' AS dataset_split,
  CASE WHEN user_id % 2 = 0 THEN 15 ELSE 30 END AS chunk_length_s,
  CASE WHEN user_id % 5 = 0 THEN 'en' ELSE 'ja' END AS language,
  CASE WHEN event_id % 7 = 0 THEN 'translate' ELSE 'transcribe' END AS task,
  CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN false ELSE true END AS punctuator,
  CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN true ELSE false END AS stable_ts,
  CASE WHEN event_id % 11 = 0 THEN '{NLLB}' END AS translation_model,
  value AS cer_raw, value * 2 AS wer_raw, value / 2 AS cer_norm, value * 1.5 AS wer_norm, event_id AS file_pos FROM events),
d AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY dataset, dataset_config, dataset_split, model,
        chunk_length_s, translation_model, punctuator, stable_ts ORDER BY file_pos) AS rn
      FROM log WHERE language = 'ja' AND task = 'transcribe') WHERE rn = 1)"""

_RUN = """run AS (SELECT event_type AS model,
  CASE WHEN user_id % 3 = 0 THEN 'sdpa' WHEN user_id % 3 = 1 THEN 'eager' END AS attention,
  CASE WHEN user_id % 4 = 0 THEN 10 WHEN user_id % 4 = 1 THEN 30 WHEN user_id % 4 = 2 THEN 60 ELSE 300 END AS duration,
  value / 10 AS time, ts, event_id FROM events),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model, attention, duration ORDER BY ts, event_id) AS rn FROM run) WHERE rn > 1),
q AS (SELECT model, attention, duration, count(*) AS n, sum(round(time * 1000)::HUGEINT) AS s1,
             sum((round(time * 1000)::HUGEINT) * (round(time * 1000)::HUGEINT)) AS s2 FROM r GROUP BY model, attention, duration),
st AS (SELECT model, attention, duration, n AS n_trials, s1::DOUBLE / (n * 1000.0) AS time_mean,
              CASE WHEN n > 1 THEN sqrt((n * s2 - s1 * s1)::DOUBLE / (n * (n - 1))::DOUBLE) / 1000.0 END AS time_std FROM q)"""


def _model_label_sql() -> str:
    link = "'[' || model || '](https://huggingface.co/' || model || ')'"
    return f"""CASE WHEN coalesce(punctuator, false) AND coalesce(stable_ts, false) THEN {link} || ' (punctuator + stable-ts)'
     WHEN coalesce(stable_ts, false) THEN {link} || ' (stable-ts)'
     WHEN coalesce(punctuator, false) THEN {link} || ' (punctuator)'
     WHEN translation_model IS NOT NULL THEN {link} || ' ([' || translation_model || '](https://huggingface.co/' || translation_model || '))'
     ELSE {link} END"""


def _pivot_sql(metric: str = "wer_norm") -> str:
    pretty = ", ".join(f"('{k}', '{v}')" for k, v in B.PRETTY_DATASET_NAMES)
    key = ", ".join(f"'n{i}': {c} IS NULL, 'v{i}': {c}" for i, c in enumerate(B.SORT_KEYS))
    cells = ",\n  ".join(
        f"arg_min(v, k) FILTER (WHERE dataset_label = '{lab}' AND v IS NOT NULL) AS \"{lab}\"" for lab in dataset_labels()
    )
    return f"""WITH {_LOG},
l AS (SELECT d.*, '[' || coalesce(p.pretty, d.dataset) || '](https://huggingface.co/datasets/' || d.dataset || ')'
                 || CASE WHEN dataset_config IS NOT NULL THEN ' (' || dataset_config || ')' ELSE '' END AS dataset_label,
             {_model_label_sql()} AS model_label,
             round_even({metric} * 10, 0) / 10 AS v,
             {{{key}, 'pos': file_pos}} AS k
      FROM d LEFT JOIN (VALUES {pretty}) p(dataset_key, pretty) ON d.dataset = p.dataset_key)
SELECT model_label,
  {cells}
FROM l GROUP BY model_label"""


def _long_sql() -> str:
    rows = "\n  UNION ALL ".join(f"SELECT model_label, dataset_label, '{m}' AS metric, v AS value FROM p_{m} WHERE v IS NOT NULL" for m in B.METRICS)
    key = ", ".join(f"{c} IS NULL, {c}" for c in B.SORT_KEYS)
    pretty = ", ".join(f"('{k}', '{v}')" for k, v in B.PRETTY_DATASET_NAMES)
    firsts = ",\n".join(f"""p_{m} AS (SELECT model_label, dataset_label, first(v ORDER BY {key}, file_pos) AS v
      FROM (SELECT *, round_even({m} * 10, 0) / 10 AS v FROM l) WHERE v IS NOT NULL GROUP BY ALL)""" for m in B.METRICS)
    return f"""WITH {_LOG},
l AS (SELECT d.*, '[' || coalesce(p.pretty, d.dataset) || '](https://huggingface.co/datasets/' || d.dataset || ')'
                 || CASE WHEN dataset_config IS NOT NULL THEN ' (' || dataset_config || ')' ELSE '' END AS dataset_label,
             {_model_label_sql()} AS model_label FROM d LEFT JOIN (VALUES {pretty}) p(dataset_key, pretty) ON d.dataset = p.dataset_key),
{firsts}
{rows}"""


SQL = {
    **{f"leaderboard_{m}": _pivot_sql(m) for m in ("cer_raw", "wer_raw", "cer_norm")},
    "leaderboard_long": _long_sql(),
    "sorted_metric_log": f"""WITH {_LOG}
SELECT *, row_number() OVER (ORDER BY {", ".join(f"{c} ASC NULLS LAST" for c in B.SORT_KEYS)}, file_pos) - 1 AS row_idx FROM d""",
    "trial_times": f"WITH {_RUN} SELECT model, attention, duration, event_id, time FROM r",
    "metric_dedup": f"WITH {_LOG} SELECT * FROM d",
    "metric_log_versions": f"WITH {_LOG} SELECT * EXCLUDE (file_pos) FROM d",
    "leaderboard_pivot": _pivot_sql(),
    "trial_stats": f"WITH {_RUN} SELECT * FROM st",
    "runtime_pivot": f"""WITH {_RUN}
SELECT model, {", ".join(f'round_even(avg(time_mean) FILTER (WHERE duration = {d}) * 1000, 0) / 1000 AS "{d}"' for d in DURATIONS)}
FROM st WHERE attention = 'sdpa' GROUP BY model""",
    "optional_eq": f"WITH {_RUN} SELECT * FROM st WHERE attention IS NULL",
}
