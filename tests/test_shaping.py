"""Table-shape helpers (P5, P8, P9/P9b, P10, F10, F11, W4, O7, O9, S4b/U3) and J4."""

import pytest
from pyspark.sql import functions as F

from auralith.operators import shaping as SH
from auralith.operators.segments import segment_audio


def test_specs():
    assert SH.column_specs("a,b,c", "transcribe,translate", "ja,en") == [("a", "transcribe", "ja"), ("b", "translate", "en")]
    spec = SH.feature_specs("c1,c2,c3", "ja,en,ja", "transcribe,translate,transcribe", "true,false,false", "false,true,true")
    assert spec["transcribe"] == {"column": "c3", "language": "ja", "timestamp": False, "kl": True}  # last wins
    with pytest.raises(ValueError):
        SH.feature_specs("a,b", "ja", "t", "true", "false")


def test_row_ops(spark):
    df = spark.range(10).withColumnRenamed("id", "row_idx")
    assert SH.row_slice(df, 3, 6).count() == 3
    with pytest.raises(ValueError):
        SH.require_columns(df, ["row_idx", "audio"])
    b = df.withColumn("batch_id", SH.batch_ids(F.col("row_idx"), 4))
    assert SH.limit_steps(b, "batch_id", 2).count() == 8
    t = SH.tag_and_blank(spark.createDataFrame([("x",)], "text string"), "ami", is_test=True).first()
    assert (t.dataset, t.text) == ("ami", "")


def test_predicates(spark):
    df = spark.createDataFrame([("org/x.all_1.wer_10",), ("org/x.all_1",), ("org/y.vectorized",)], "n string")
    assert df.where(SH.catalog_filter(F.col("n"), contains=".all_", endswith="wer_10")).count() == 1
    assert df.where(SH.catalog_filter(F.col("n"), not_contains="wer")).count() == 2
    m = spark.createDataFrame([("a/1.flac",), ("a/1-2.trans.txt",), ("clips/c.mp3",), ("t.stm",), ("x",)], "n string")
    assert [r.k for r in m.select(SH.member_kind(F.col("n")).alias("k")).collect()] == ["audio", "transcript", "clip", "segments", "other"]
    w = spark.createDataFrame([([1, 2, 3, 4],)], "a array<int>")
    assert w.select(SH.waveform_prefix(F.col("a"), 2).alias("p")).first().p == [1, 2]


def test_nested_subsets(spark):
    dirs = {"s": ["s"], "m": ["s", "m_additional"], "l": ["s", "m_additional", "l_additional"]}
    counts = {"s": 6, "m_additional": 21, "l_additional": 103}
    m = SH.expand_subsets(spark, dirs, counts, "m")
    names = {r.archive for r in m.collect()}
    assert len(names) == 27 and "s_part_0.tar.gz" in names and "m_part_20.tar.gz" in names
    assert SH.expand_subsets(spark, dirs, counts, "l").count() == 130


def test_segment_audio(spark):
    audio = spark.createDataFrame([("talk1", list(range(40)))], "fn string, samples array<int>")
    segs = spark.createDataFrame([("talk1", 0.5, 1.0), ("talk1", 4.5, 9.0), ("other", 0.0, 1.0)], "fn string, start double, end double")
    got = sorted((r.start, r.segment) for r in segment_audio(segs, audio, "fn", "samples", 8).collect())
    assert got == [(0.5, [4, 5, 6, 7]), (4.5, [36, 37, 38, 39])]


def test_keep_and_lineage(spark):
    df = spark.createDataFrame([(1, "a", "b")], "id int, text string, extra string")
    assert SH.keep_columns(df, {"id", "text", "missing"}).columns == ["id", "text"]
    assert SH.lineage_name("corpus.all", 10.0, vectorized=True, chunk=3) == "corpus.all_3.wer_10.0.vectorized"
