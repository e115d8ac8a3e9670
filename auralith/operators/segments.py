"""Segment/timestamp operators: gap fill (W6 with A12 and W11), regrouping (W10), silence overlap (J12),
second-based slicing (L10) and fixed-length chunk explode (M4).

A recording may be of any length. What a part needs of the parts around it comes from segmented scans over range partitions
(``scans``), medians from ``ranks``, and overlaps from a sweep over cells of the time line (``overlapping``), so no step puts a
recording into one task. W6 is sequential only inside a run of parts without a start of their own (a filled end becomes
the next start), so only such a run is folded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auralith.operators.ranks import medians
from auralith.operators.scans import Pieces, first_after, following, last_before, previous, running_sum, same
from auralith.session import cut_lineage

CELL_ROWS = 1024


def _time(start: Column, end: Column) -> Column:
    """A part's known time: its non-zero start, else its end."""
    return F.coalesce(F.nullif(start, F.lit(0.0)), end)


def fill_timestamps(parts: DataFrame, audio: str = "audio_id", pos: str = "pos", hot_rows: int = 1 << 20) -> DataFrame:
    """``parts(audio_id, pos, start, end, total_dur)`` -> filled ``(audio_id, pos, start, end)``.

    A missing start is the filled end before it (first part: end minus the usual duration, not below 0); a missing end
    is the next part's own start, else start plus the usual duration, at most the next known time or the audio's
    length. The usual duration is A12 at the first part that needs it: parts before it count as filled so far (which
    takes neighbours' times only), parts after it as given. A time of 0.0 counts as missing where it is compared.

    Neighbours, places and runs are scans over range partitions. The audio's first need and usual duration are aggregates joined
    back. Then each run of parts that begins with a part with its own start is folded from left to right."""
    zero, key = F.lit(0.0), ["audio_id"]
    known = F.when(F.coalesce(F.nullif("end", zero), "start").isNotNull(), _time(F.col("start"), F.col("end")))
    p = parts.select(F.col(audio).alias("audio_id"), F.col(pos).alias("pos"), "start", "end", "total_dur")
    p = Pieces(p, key, ["pos"]).scan(i=running_sum(F.lit(1)), prev_end=previous("end"), next_start=following("start"), later=first_after(known),
                                     run=running_sum(F.col("start").isNotNull().cast("long")))
    p = cut_lineage(p.select("audio_id", "pos", "start", "end", "i", "prev_end", "next_start", "run", F.coalesce("later", "total_dur").alias("cap")))
    needs = ((F.col("i") == 1) & F.col("start").isNull()) | (F.col("end").isNull() & F.col("next_start").isNull())
    lengths = same(p, p.groupBy(*key).agg(F.min(F.when(needs, F.col("i"))).alias("first_need")), key)
    length = F.when(F.col("i") < F.col("first_need"), F.coalesce("end", "next_start") - F.coalesce("start", "prev_end")).otherwise(F.col("end") - F.col("start"))
    p = same(p, medians(lengths, key, length, "usual", hot_rows), key, "left").withColumn("usual", F.coalesce(F.col("usual") * 2, F.lit(2.0)))
    opening = F.greatest(F.round(F.coalesce("end", zero) - F.col("usual"), 3), zero)
    p = p.select("audio_id", "run", F.struct("i", "pos", F.when(F.col("i") == 1, F.coalesce("start", opening)).otherwise(F.col("start")).alias("start"),
                                             F.coalesce("end", "next_start").alias("end"), "usual", "cap").alias("part"))

    def step(done: Column, part: Column) -> Column:
        start = F.coalesce(part["start"], done["last"])
        end = F.coalesce(part["end"], F.least(F.round(start + part["usual"], 3), part["cap"]))
        return F.struct(end.alias("last"), F.concat(done["out"], F.array(F.struct(part["pos"].alias("pos"), start.alias("start"), end.alias("end")))).alias("out"))

    pos_type = parts.schema[pos].dataType.simpleString()
    empty = F.struct(F.lit(None).cast("double").alias("last"), F.array().cast(f"array<struct<pos:{pos_type},start:double,end:double>>").alias("out"))
    runs = p.groupBy("audio_id", "run").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    return runs.select("audio_id", F.inline(F.aggregate("parts", empty, step)["out"]))


def median_duration(parts: DataFrame, audio: str = "audio_id", hot_rows: int = 1 << 20) -> DataFrame:
    """``median(end - start) * 2`` over complete parts, 2.0 when there are none (exact; audios of more than
    ``hot_rows`` parts by rank selection)."""
    found = medians(parts, [audio], F.col("end") - F.col("start"), "median_dur", hot_rows)
    return found.withColumn("median_dur", F.coalesce(F.col("median_dur") * 2, F.lit(2.0)))


def next_known_time(parts: DataFrame, audio: str = "audio_id", pos: str = "pos") -> DataFrame:
    """``parts`` with ``next_time``, the time of the first later part with a known (non-zero start, else end) time."""
    scanned = Pieces(parts, [audio], [pos]).scan(next_time=first_after(_time(F.col("start"), F.col("end"))))
    return scanned.select(*parts.columns, "next_time")


def regroup(words: DataFrame, max_gap: float, marks: str = ".?!。", audio: str = "audio_id", pos: str = "pos") -> DataFrame:
    """W10 (gaps and islands): a new segment starts after a gap longer than ``max_gap`` seconds or after a word that
    ends with a sentence-final mark; each segment keeps its first start, last end and words joined by spaces."""
    pieces = Pieces(words, [audio], [pos])
    beside = pieces.scan(prev_end=previous("end"), prev_word=previous("word"))
    brk = (F.col("start") - F.col("prev_end") > F.lit(max_gap)) | F.substring("prev_word", -1, 1).isin(list(marks))
    pieces.rows = cut_lineage(beside.withColumn("brk", F.when(brk, 1).otherwise(0)).drop("prev_end", "prev_word"))
    tagged = pieces.scan(segment=running_sum("brk"))
    return tagged.groupBy(audio, "segment").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.count(F.lit(1)).alias("n_words"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos), F.col("word")))), lambda x: x["word"]), " ").alias("text"),
    )


def _overlaps(s: DataFrame, q: DataFrame, keys: list[str], also: Column | None = None) -> DataFrame:
    """Pairs of ``s`` and ``q`` (key columns, id, start, end) that share a key and overlap."""
    right = q.withColumnsRenamed({c: f"q_{c}" for c in q.columns})
    on = (F.col("start") < F.col("q_end")) & (F.col("q_start") < F.col("end"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"q_{k}"))
    return s.join(right, on if also is None else on & also).select(
        "audio", F.col("id").alias("seg_id"), F.col("q_id").alias("sil_id"), F.greatest("start", "q_start").alias("overlap_start"),
        F.least("end", "q_end").alias("overlap_end"))


def swept(both: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``both`` (audio, side 0 or 1, id, start, end) dealt into cells for ``overlapping``: consecutive runs of at most ``cell_rows`` starts
    of one audio. An interval belongs to the cell it starts in (``native``) and is copied into each later cell that begins
    before its end and in which an interval of the other side starts."""
    rows = Pieces(both, ["audio"], ["start", "side", "id"]).rows
    cell = F.floor((F.col("_at") - F.shiftleft(F.col("_part").cast("long"), 33)) / F.lit(float(cell_rows))).cast("long")
    rows = rows.withColumn("cell", F.shiftleft(F.col("_part").cast("long"), 33) + cell).drop("_part", "_at")
    cells = rows.groupBy("audio", "cell").agg(F.min("start").alias("first"), F.max(F.col("side") == 0).alias("has_0"), F.max(F.col("side") == 1).alias("has_1"))
    numbers = Pieces(cells, ["audio"], ["cell"])  # cells of an audio, in order
    cells = cut_lineage(numbers.scan(number=running_sum(F.lit(1)), next_first=following("first")).drop("_part", "_at"))
    rows = rows.join(cells.select("audio", "cell", "number", "next_first"), ["audio", "cell"])
    crossing = cut_lineage(rows.filter(F.col("end") > F.col("next_first")).select("audio", "side", "id", "start", "end", "number"))
    # the last cell that begins before a crossing interval's end: ends and beginnings in one order, ends first
    ends = crossing.select("audio", F.col("end").alias("time"), F.lit(0).alias("kind"), "side", "id", "start", F.col("number").alias("own"))
    begins = cells.select("audio", F.col("first").alias("time"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("side"), F.lit(None).cast(both.schema["id"].dataType).alias("id"),
                          F.lit(None).cast("double").alias("start"), F.col("number").alias("own"))
    reach = Pieces(ends.unionByName(begins), ["audio"], ["time", "kind"]).scan(last=last_before(F.when(F.col("kind") == 1, F.col("own"))))
    reach = reach.filter("kind = 0 and last > own").withColumn("number", F.explode(F.sequence(F.col("own") + 1, F.col("last"))))
    copies = reach.select("audio", "number", "side", "id", "start", F.col("time").alias("end")).join(cells.select("audio", "number", "cell", "has_0", "has_1"), ["audio", "number"])
    copies = copies.filter((F.col("side") == 0) & F.col("has_1") | (F.col("side") == 1) & F.col("has_0"))
    columns = ["audio", "cell", "side", "id", "start", "end"]
    return rows.select(*columns, F.lit(True).alias("native")).unionByName(copies.select(*columns, F.lit(False).alias("native")))


def overlapping(segments: DataFrame, silences: DataFrame, audio: str = "audio_id", cell_rows: int = CELL_ROWS) -> DataFrame:
    """Interval-overlap join inside one audio (``s.start < q.end AND q.start < s.end``), with the overlap trimmed by
    ``greatest``/``least``.

    Audios of at most ``cell_rows`` intervals are joined on the audio id. A longer one is swept: its time line is cut into cells
    (``swept``), intervals that are open at a cell's beginning are carried into it, and a pair is found in the cell in
    which its later interval starts. The work per task is bounded by the cell and the pairs it returns."""
    def side(df: DataFrame, name: str, number: int) -> DataFrame:
        kept = df.select(F.col(audio).alias("audio"), F.lit(number).alias("side"), F.col(name).alias("id"), "start", "end")
        return kept.filter("audio is not null and start is not null and end is not null")

    s, q = side(segments, "seg_id", 0), side(silences, "sil_id", 1)
    long = s.unionByName(q).groupBy("audio").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cell_rows).select("audio")
    if not long.head(1):
        return _overlaps(s, q, ["audio"]).withColumnRenamed("audio", audio)
    long = cut_lineage(long)
    short = _overlaps(s.join(long, "audio", "left_anti"), q.join(long, "audio", "left_anti"), ["audio"])
    cells = cut_lineage(swept(s.unionByName(q).join(long, "audio", "left_semi"), cell_rows))
    found = _overlaps(cells.filter("side = 0"), cells.filter("side = 1"), ["audio", "cell"], F.col("native") | F.col("q_native"))
    return short.unionByName(found).withColumnRenamed("audio", audio)


def slice_seconds(samples: Column, rate: int, start_sec: Column, end_sec: Column) -> Column:
    """``samples[int(start*rate):min(int(end*rate), n)]``."""
    a = F.floor(start_sec * F.lit(rate)).cast("int")
    b = F.least(F.floor(end_sec * F.lit(rate)).cast("int"), F.size(samples))
    return F.slice(samples, a + 1, F.greatest(b - a, F.lit(0)))


def chunk_explode(df: DataFrame, samples: str, rate: int, chunk_s: float) -> DataFrame:
    """M4: one row per fixed-length chunk (the last one shorter), with its sample slice."""
    n = F.size(samples)
    per = int(round(chunk_s * rate))
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(per))).otherwise(F.array().cast("array<int>"))
    out = df.select("*", F.posexplode(starts).alias("chunk_idx", "_from")).withColumn("chunk_idx", F.col("chunk_idx").cast("long"))
    return out.withColumn("chunk", F.slice(samples, F.col("_from") + 1, F.lit(per))).drop("_from")


def segment_audio(segments: DataFrame, audio: DataFrame, key: str, samples: str, rate: int) -> DataFrame:
    """Segments (``key``, ``start``, ``end`` seconds) joined to their recording on ``key``, then each segment's
    samples cut out (L10). The join is on the recording id, so only one recording's samples meet its segments."""
    j = segments.join(audio.select(key, samples), key)
    return j.withColumn("segment", slice_seconds(F.col(samples), rate, F.col("start"), F.col("end"))).drop(samples)
