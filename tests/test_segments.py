"""Timestamp fill (W6), regroup (W10), overlap join (J12), slices."""

from pyspark.sql import functions as F

from auralith.operators import segments as G


def fill(spark, parts, total=10.0):
    rows = [(0, i, s, e, total) for i, (s, e) in enumerate(parts)]
    df = spark.createDataFrame(rows, "audio_id long, pos long, start double, end double, total_dur double")
    return [(r.start, r.end) for r in G.fill_timestamps(df).orderBy("pos").collect()]


def test_first_start_clamped(spark):
    # median of the complete part (1.0 -> 2.0) is 1.0, doubled -> 2.0; first start = max(1.0 - 2.0, 0) = 0.0
    assert fill(spark, [(None, 1.0), (1.0, 2.0)]) == [(0.0, 1.0), (1.0, 2.0)]


def test_missing_end_takes_next_start_or_capped_duration(spark):
    assert fill(spark, [(0.0, 1.0), (1.5, None), (2.5, 3.0)]) == [(0.0, 1.0), (1.5, 2.5), (2.5, 3.0)]
    # no next start: start + 2 * median (1.0 -> 2.0) = 3.5, capped by the next known time (end 3.0 of the last part)
    assert fill(spark, [(0.0, 1.0), (1.5, None), (None, 3.0)]) == [(0.0, 1.0), (1.5, 3.0), (3.0, 3.0)]
    # last part: capped by the audio length
    assert fill(spark, [(0.0, 1.0), (9.5, None)], total=10.0) == [(0.0, 1.0), (9.5, 10.0)]


def test_runs_without_starts_carry_the_filled_end(spark):
    # usual duration 2 * median(1.0, 1.0) = 2.0; each filled end starts the next part; capped by the next known time 9.0
    parts = [(0.0, 1.0), (2.0, None), (None, None), (None, None), (9.0, 10.0)]
    assert fill(spark, parts, 20.0) == [(0.0, 1.0), (2.0, 4.0), (4.0, 6.0), (6.0, 9.0), (9.0, 10.0)]


def test_usual_duration_is_taken_at_the_first_need(spark):
    # first need at the third part: the second counts as filled from its neighbours (1.0 to 4.0), the last as given
    parts = [(0.0, 1.0), (None, 4.0), (4.5, None), (None, 9.0), (9.0, 9.5)]
    # lengths 1.0, 3.0, 0.5 -> median 1.0 -> 2.0
    assert fill(spark, parts, 20.0) == [(0.0, 1.0), (1.0, 4.0), (4.5, 6.5), (6.5, 9.0), (9.0, 9.5)]
    assert fill(spark, [(None, None)], 1.5) == [(0.0, 1.5)]  # no complete part: 2.0, capped by the audio's length


def test_zero_times_count_as_missing_for_the_cap(spark):
    assert fill(spark, [(1.0, None), (None, 0.0), (3.0, 3.5)], 10.0) == [(1.0, 2.0), (2.0, 0.0), (3.0, 3.5)]


def test_fill_keeps_audios_apart(spark):
    df = spark.createDataFrame([(0, 0, None, 1.0, 10.0), (0, 1, 1.0, 2.0, 10.0), (1, 0, 0.0, None, 5.0)],
                               "audio_id long, pos long, start double, end double, total_dur double")
    got = sorted(tuple(r) for r in G.fill_timestamps(df).collect())
    assert got == [(0, 0, 0.0, 1.0), (0, 1, 1.0, 2.0), (1, 0, 0.0, 2.0)]
    names = " ".join(df.sparkSession._jvm.PythonSQLUtils.explainString(G.fill_timestamps(df)._jdf.queryExecution(), "simple").split())
    assert "Pandas" not in names and "Arrow" not in names


def test_regroup_and_overlap(spark):
    w = spark.createDataFrame([(0, 0, 0.0, 1.0, "hi"), (0, 1, 1.0, 2.0, "there."), (0, 2, 2.0, 3.0, "next"), (0, 3, 30.0, 31.0, "far")],
                              "audio_id long, pos long, start double, end double, word string")
    segs = sorted((r.segment, r.text) for r in G.regroup(w, 10.0).collect())
    assert segs == [(0, "hi there."), (1, "next"), (2, "far")]
    s = spark.createDataFrame([(0, 1, 0.0, 2.0), (0, 2, 5.0, 6.0)], "audio_id long, seg_id long, start double, end double")
    q = spark.createDataFrame([(0, 9, 1.5, 5.5)], "audio_id long, sil_id long, start double, end double")
    got = sorted(tuple(r) for r in G.overlapping(s, q).collect())
    assert got == [(0, 1, 9, 1.5, 2.0), (0, 2, 9, 5.0, 5.5)]


def test_slices(spark):
    df = spark.createDataFrame([(list(range(10)),)], "a array<int>")
    assert df.select(G.slice_seconds(F.col("a"), 2, F.lit(1.0), F.lit(9.0)).alias("s")).first().s == [2, 3, 4, 5, 6, 7, 8, 9]
    chunks = G.chunk_explode(df, "a", 2, 2.0).orderBy("chunk_idx").collect()
    assert [r.chunk for r in chunks] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9]]
