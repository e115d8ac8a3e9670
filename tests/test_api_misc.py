"""Remaining public operators: sinks K2/K3/K5, runtime log S13, quarantine J2, single-head scoring M1, path helpers
T22/J11, timestamp ids T15 and the CER denominator."""

import json

from pyspark.sql import functions as F

from auralith.functions import edit as E
from auralith.functions import labels as L
from auralith.functions import text as T
from auralith.operators import joins as J
from auralith.operators import scoring as SC
from auralith.sources import readers as R
from auralith.sources import sinks as K


def test_sinks_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([("f1", [1, 2, 3]), ("f2", [4])], "file_id string, whisper_transcript array<int>")
    K.save_table(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    K.write_transcripts_csv(df, str(tmp_path / "csv"))
    got = sorted(tuple(r) for r in spark.read.option("header", "true").csv(str(tmp_path / "csv")).collect())
    assert got == [("f1", "[1,2,3]"), ("f2", "[4]")]
    m = spark.createDataFrame([("m", 1.0)], "model string, wer_norm double")
    K.append_metrics(m, str(tmp_path / "log"))
    K.append_metrics(m, str(tmp_path / "log"))
    log = spark.read.json(str(tmp_path / "log"))
    assert log.count() == 2 and "run_ts" in log.columns


def test_runtime_log(spark, tmp_path):
    rows = [{"model": "m", "attention": "sdpa", "device": "cuda", "duration": 10, "time (mean)": 1.5, "time (std)": 0.1,
             "time (all)": [1.4, 1.6]}, {"model": "m", "attention": None, "device": "cuda", "duration": 30,
                                         "time (mean)": float("nan"), "time (std)": None, "time (all)": []}]
    p = tmp_path / "runtime.jsonl"
    p.write_text("\n".join(json.dumps(r) for r in rows).replace("NaN", "\"NaN\""))
    df = R.read_runtime_log(spark, str(p)).orderBy("duration").collect()
    assert df[0].time_mean == 1.5 and df[0].time_all == [1.4, 1.6] and df[1].attention is None


def test_quarantine_and_single_head(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    dim = spark.createDataFrame([(1, "en"), (3, "de")], "doc_id long, lang string")
    assert [r.doc_id for r in J.quarantine(rows, dim, "doc_id").collect()] == [2]
    df = spark.createDataFrame([(1, 0, "a b c d e f g")], "doc_id long, line_no long, reference_raw string")
    out = SC.score(df, ["doc_id", "line_no"], ["reference_raw"], "hyp", SC.corrupting_predictor).first()
    assert out.hyp == "a b c d e zz g"


def test_path_helpers_and_ids(spark):
    df = spark.createDataFrame([("./a/b/c.tar.gz",)], "p string")
    r = df.select(T.basename("p").alias("b"), T.stem("p").alias("s"), T.strip_leading_dot_slash("p").alias("l")).first()
    assert (r.b, r.s, r.l) == ("c.tar.gz", "c.tar", "a/b/c.tar.gz")
    ts = spark.createDataFrame([(0.0,), (1.0,), (99.0,)], "t double").select(L.timestamp_id(F.col("t")).alias("i"))
    assert [x.i for x in ts.collect()] == [L.TIMESTAMP_FIRST, L.TIMESTAMP_FIRST + 50, L.TIMESTAMP_FIRST + 1500]
    n = spark.createDataFrame([("  東京  x ",)], "s string").select(E.char_count(F.col("s")).alias("n")).first().n
    assert n == 4


def test_profile_report(spark):
    from auralith.functions.labels import toy_token_ids
    from auralith.operators import profile as PR

    df = spark.createDataFrame([("d", [0.5, -0.5, 1.0, 0.0], "ab cd"), ("d", [0.25, 0.25], "x")],
                               "ds string, wave array<float>, text string")
    flat = PR.profile(df, "ds", "wave", 2, "text", toy_token_ids)
    r = flat.first()
    assert (r.total_data_size, r.duration_max, r.duration_min, r.character_length_max, r.token_length_max) == (2, 2.0, 1.0, 5, 2)
    rep = json.loads(PR.to_report(flat, "ds").first().report)
    assert rep["audio"]["duration"] == {"mean": 1.5, "max": 2.0, "min": 1.0}
    assert rep["transcription"]["token_length"]["max"] == 2 and rep["total_data_size"] == 2


def test_orphans_reports_null_keys_once_for_each_side(spark):
    from auralith.operators import joins as J

    def sides(left, right):
        members, manifest = (spark.createDataFrame([(k,) for k in keys], "name string") for keys in (left, right))
        return sorted((str(r.name), r.side) for r in J.orphans(members, manifest, "name").collect())

    member, transcript = "member_without_transcript", "transcript_without_member"
    assert sides(["a", "b", "b", None, None], ["a", "c", None]) == [("None", member), ("None", transcript), ("b", member), ("c", transcript)]
    assert sides(["a", None], ["a"]) == [("None", member)]
    assert sides(["a"], ["a", None, None]) == [("None", transcript)]


def test_checked_join_refuses_empty_sides(spark):
    import pytest

    from auralith.operators import joins as J

    a = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    assert J.checked_join(a, a.select("k"), "k").count() == 2
    for left, right, what in ((a, a.limit(0), "right"), (a.limit(0), a, "left"), (a, a.selectExpr("k + 9 AS k"), "joined")):
        with pytest.raises(ValueError, match=what):
            J.checked_join(left, right.select("k"), "k", "meta")
