"""Timestamp/segment queries over ``events``: gap fill (W6/A12/W11), regrouping (W10), silence overlap.

An audio is 32 consecutive events (``audio_id = event_id // 32``, ``pos = event_id % 32``). Times are integer milliseconds from the audio's first event (``start``) plus ``value * 100`` ms
(``end``), as doubles in seconds; for W6, ``start`` is missing when ``event_id % 5 = 0`` and ``end`` when
``event_id % 7 = 0``; an audio lasts one second past its last end. Words are the event types, with a full stop on
every fourth event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auralith.operators import segments as G
from auralith.plans.tables import table

AUDIO_SIZE = 32
MAX_GAP = 10.0
EPOCH_2024_US = 1_704_067_200_000_000


def _parts(spark, sf_dir) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    audio = F.floor(F.col("event_id") / AUDIO_SIZE).cast("long")
    us = F.unix_micros(F.col("ts").cast("timestamp"))  # ts is TIMESTAMP_NTZ; the session zone is UTC
    w = Window.partitionBy("audio_id")  # bounded: one audio = 32 events
    base = ev.select("event_id", "event_type", "value", "ts", audio.alias("audio_id"), (F.col("event_id") % AUDIO_SIZE).alias("pos"))
    base = base.withColumn("start_ms", F.floor((us - F.min(us).over(w)) / 1000).cast("long")).withColumn(
        "dur_ms", F.round(F.col("value") * 100).cast("long"))
    return base.select(
        "event_id", "event_type", "audio_id", "pos",
        (F.col("start_ms") / 1000.0).alias("start"), ((F.col("start_ms") + F.col("dur_ms")) / 1000.0).alias("end"),
        ((F.max(F.col("start_ms") + F.col("dur_ms")).over(w) + 1000) / 1000.0).alias("total_dur"),
        F.concat(F.col("event_type"), F.when(F.col("event_id") % 4 == 3, F.lit(".")).otherwise(F.lit(""))).alias("word"),
    )


def fill_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parts(spark, sf_dir)
    holed = p.select(
        "audio_id", "pos",
        F.when(F.col("event_id") % 5 == 0, F.lit(None).cast("double")).otherwise(F.col("start")).alias("start"),
        F.when(F.col("event_id") % 7 == 0, F.lit(None).cast("double")).otherwise(F.col("end")).alias("end"),
        "total_dur",
    )
    return G.fill_timestamps(holed)


def _holed(spark, sf_dir) -> DataFrame:
    p = _parts(spark, sf_dir)
    return p.select(
        "audio_id", "pos",
        F.when(F.col("event_id") % 5 == 0, F.lit(None).cast("double")).otherwise(F.col("start")).alias("start"),
        F.when(F.col("event_id") % 7 == 0, F.lit(None).cast("double")).otherwise(F.col("end")).alias("end"),
    )


def lookahead_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W11 on the holed parts: the time of the first later part of the same audio with a known time (a non-zero
    start, else its end); NULL when none follows."""
    return G.next_known_time(_holed(spark, sf_dir)).select("audio_id", "pos", "next_time")


def median_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12 per audio: twice the median duration of its complete parts, 2.0 when none is complete."""
    return G.median_duration(_holed(spark, sf_dir))


def regroup_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.regroup(_parts(spark, sf_dir), MAX_GAP)


def silence_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error events are silences; every other event is a speech segment; pairs that overlap inside one audio."""
    p = _parts(spark, sf_dir)
    segs = p.where(F.col("event_type") != "error").select("audio_id", F.col("event_id").alias("seg_id"), "start", "end")
    sil = p.where(F.col("event_type") == "error").select("audio_id", F.col("event_id").alias("sil_id"), "start", "end")
    return G.overlapping(segs, sil)


def _long_parts(spark, sf_dir) -> DataFrame:
    """Every third event belongs to one recording (-1), which so holds a third of all rows; times count from 2024."""
    ev = table(spark, sf_dir, "events")
    ms = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH_2024_US) / 1000).cast("long")
    audio = F.when(F.col("event_id") % 3 == 0, -1).otherwise(F.floor(F.col("event_id") / AUDIO_SIZE)).cast("long")
    return ev.select(
        "event_id", "event_type", audio.alias("audio_id"), F.col("event_id").alias("pos"), (ms / 1000.0).alias("start"),
        ((ms + F.round(F.col("value") * 100).cast("long")) / 1000.0).alias("end"),
        F.concat(F.col("event_type"), F.when(F.col("event_id") % 4 == 3, F.lit(".")).otherwise(F.lit(""))).alias("word"))


def long_recording_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J12 where one recording holds a third of all rows."""
    p = _long_parts(spark, sf_dir)
    segs = p.where(F.col("event_type") != "error").select("audio_id", F.col("event_id").alias("seg_id"), "start", "end")
    return G.overlapping(segs, p.where(F.col("event_type") == "error").select("audio_id", F.col("event_id").alias("sil_id"), "start", "end"))


def long_recording_regroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W10 where one recording holds a third of all rows."""
    return G.regroup(_long_parts(spark, sf_dir), MAX_GAP)


def long_recording_lookahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W11 where one recording holds a third of all rows; starts and ends are missing as in ``lookahead_times``."""
    p = _long_parts(spark, sf_dir)
    holed = p.select("audio_id", "pos", F.when(F.col("event_id") % 5 != 0, F.col("start")).alias("start"), F.when(F.col("event_id") % 7 != 0, F.col("end")).alias("end"))
    return G.next_known_time(holed).select("audio_id", "pos", "next_time")


# ---- oracles ------------------------------------------------------------------------------------------------------
_BASE = f"""b0 AS (SELECT event_id, event_type, event_id // {AUDIO_SIZE} AS audio_id, event_id % {AUDIO_SIZE} AS pos,
        (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY event_id // {AUDIO_SIZE})) // 1000 AS start_ms,
        round(value * 100)::BIGINT AS dur_ms FROM events),
base AS (SELECT event_id, event_type, audio_id, pos, start_ms / 1000.0 AS start, (start_ms + dur_ms) / 1000.0 AS "end",
        (max(start_ms + dur_ms) OVER (PARTITION BY audio_id) + 1000) / 1000.0 AS total_dur,
        event_type || CASE WHEN event_id % 4 = 3 THEN '.' ELSE '' END AS word FROM b0)"""

# W6 as a fold over each audio's parts in order; acc = {s: filled starts, e: filled ends, d: median duration once needed}
_MED = """(CASE WHEN len(dl) = 0 THEN 2.0
      WHEN len(dl) % 2 = 1 THEN list_sort(dl)[len(dl) // 2 + 1] * 2
      ELSE (list_sort(dl)[len(dl) // 2] + list_sort(dl)[len(dl) // 2 + 1]) / 2.0 * 2 END)"""


def _fill_sql() -> str:
    dl = ("list_concat(list_transform(range(1, i), lambda j: acc.e[j] - acc.s[j]), "
          "list_filter(list_transform(range(i + 1, len(ps) + 1), lambda j: ps[j].e - ps[j].s), lambda x: x IS NOT NULL))")
    med = _MED.replace("dl", dl)
    need = ("((ps[i].s IS NULL AND i = 1) OR (ps[i].e IS NULL AND (i = len(ps) OR ps[i + 1].s IS NULL)))")
    d_now = f"coalesce(acc.d, CASE WHEN {need} THEN {med} END)"
    s_i = (f"(CASE WHEN ps[i].s IS NOT NULL THEN ps[i].s WHEN i = 1 THEN "
           f"greatest(round(coalesce(nullif(ps[1].e, 0.0), 0.0) - {d_now}, 3), 0.0) ELSE acc.e[i - 1] END)")
    cap = ("(CASE WHEN i = len(ps) THEN total ELSE coalesce(list_filter(list_transform(range(i + 1, len(ps) + 1), "
           "lambda j: CASE WHEN coalesce(nullif(ps[j].e, 0.0), ps[j].s) IS NOT NULL THEN coalesce(nullif(ps[j].s, 0.0), ps[j].e) END), "
           "lambda x: x IS NOT NULL)[1], total) END)")
    e_i = (f"(CASE WHEN ps[i].e IS NOT NULL THEN ps[i].e WHEN i < len(ps) AND ps[i + 1].s IS NOT NULL THEN ps[i + 1].s "
           f"ELSE least(round({s_i} + {d_now}, 3), {cap}) END)")
    fold = (f"list_reduce(range(1, len(ps) + 1), lambda acc, i: {{'s': list_append(acc.s, {s_i}), "
            f"'e': list_append(acc.e, {e_i}), 'd': {d_now}}}, {{'s': []::DOUBLE[], 'e': []::DOUBLE[], 'd': NULL::DOUBLE}})")
    return f"""WITH {_BASE},
h AS (SELECT audio_id, pos, CASE WHEN event_id % 5 = 0 THEN NULL ELSE start END AS s,
             CASE WHEN event_id % 7 = 0 THEN NULL ELSE "end" END AS e, total_dur FROM base),
g AS (SELECT audio_id, list({{'s': s, 'e': e}} ORDER BY pos) AS ps, list(pos ORDER BY pos) AS poss, any_value(total_dur) AS total
      FROM h GROUP BY audio_id),
f AS (SELECT audio_id, poss, {fold} AS r FROM g)
SELECT audio_id, unnest(poss) AS pos, unnest(r.s) AS start, unnest(r.e) AS "end" FROM f"""


_HOLED = """h AS (SELECT audio_id, pos, CASE WHEN event_id % 5 = 0 THEN NULL ELSE start END AS start,
             CASE WHEN event_id % 7 = 0 THEN NULL ELSE "end" END AS "end" FROM base)"""

_LONG = f"""l0 AS (SELECT event_id, event_type, CASE WHEN event_id % 3 = 0 THEN -1 ELSE event_id // {AUDIO_SIZE} END AS audio_id, event_id AS pos,
        (epoch_us(ts) - {EPOCH_2024_US}) // 1000 AS ms, round(value * 100)::BIGINT AS dur_ms FROM events),
base AS (SELECT event_id, event_type, audio_id, pos, ms / 1000.0 AS start, (ms + dur_ms) / 1000.0 AS "end",
        event_type || CASE WHEN event_id % 4 = 3 THEN '.' ELSE '' END AS word FROM l0)"""

SQL = {
    "lookahead_times": f"""WITH {_BASE}, {_HOLED}
SELECT audio_id, pos, first(coalesce(nullif(start, 0.0), "end") IGNORE NULLS) OVER (PARTITION BY audio_id ORDER BY pos
       ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_time FROM h""",
    "median_durations": f"""WITH {_BASE}, {_HOLED}
SELECT audio_id, coalesce(median(CASE WHEN start IS NOT NULL AND "end" IS NOT NULL THEN "end" - start END) * 2, 2.0) AS median_dur
FROM h GROUP BY audio_id""",
    "fill_timestamps": _fill_sql(),
    "regroup_segments": f"""WITH {_BASE},
b AS (SELECT *, CASE WHEN start - lag("end") OVER w > {MAX_GAP} OR right(lag(word) OVER w, 1) IN ('.', '?', '!', '。')
                     THEN 1 ELSE 0 END AS brk FROM base WINDOW w AS (PARTITION BY audio_id ORDER BY pos)),
g AS (SELECT *, sum(brk) OVER (PARTITION BY audio_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS segment FROM b)
SELECT audio_id, segment::BIGINT AS segment, min(start) AS start, max("end") AS "end", count(*) AS n_words,
       string_agg(word, ' ' ORDER BY pos) AS text FROM g GROUP BY audio_id, segment""",
    "silence_overlap": f"""WITH {_BASE}
SELECT s.audio_id, s.event_id AS seg_id, q.event_id AS sil_id, greatest(s.start, q.start) AS overlap_start,
       least(s."end", q."end") AS overlap_end
FROM base s JOIN base q ON s.audio_id = q.audio_id AND s.start < q."end" AND q.start < s."end"
WHERE s.event_type <> 'error' AND q.event_type = 'error'""",
}
SQL |= {f"long_recording_{new}": SQL[old].replace(_BASE, _LONG) for new, old in (
    ("overlap", "silence_overlap"), ("regroup", "regroup_segments"), ("lookahead", "lookahead_times"))}
