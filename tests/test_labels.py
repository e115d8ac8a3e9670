"""Label arrays (L1-L8, W1, F2/F3, W3) on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from auralith.functions import labels as L
from auralith.operators import labels as LO
from auralith.operators.ordering import chunk_ids

S, LANG, TASK, NT, E = L.SOT, L.LANG["en"], L.TRANSCRIBE, L.NOTIMESTAMPS, L.EOT
TS = L.TIMESTAMP_FIRST


def test_drop_timestamps_inserts_notimestamps(spark):
    df = spark.createDataFrame([([S, LANG, TASK, TS, 7, TS + 5, E],)], "ids array<int>")
    out = df.select(L.maybe_drop_timestamps(F.col("ids"), F.lit(False)).alias("o")).first().o
    assert out == [S, LANG, TASK, NT, 7, E]
    kept = df.select(L.maybe_drop_timestamps(F.col("ids"), F.lit(True)).alias("o")).first().o
    assert kept == [S, LANG, TASK, TS, 7, TS + 5, E]


def test_single_eot(spark):
    df = spark.createDataFrame([([S, 5, E, 6, E],)], "ids array<int>")
    assert df.select(L.with_single_eot("ids").alias("o")).first().o == [S, 5, 6, E]


def test_prompt_from_previous_row(spark):
    rows = [(1, 0, [S, LANG, TASK, NT, 11, 12, E]), (1, 1, [S, LANG, TASK, NT, 21, E]), (2, 0, [S, LANG, TASK, NT, 31, E])]
    df = spark.createDataFrame(rows, "b long, r long, ids array<int>")
    out = LO.prompt_with_previous(df, "b", "r", "ids", F.lit(True), 448)
    got = {(r.b, r.r): r.labels for r in out.collect()}
    assert got[(1, 0)] == [S, LANG, TASK, NT, 11, 12, E]  # first row of a batch is never conditioned
    assert got[(1, 1)] == [L.PREV, 11, 12, S, LANG, TASK, NT, 21, E]
    assert got[(2, 0)] == [S, LANG, TASK, NT, 31, E]
    short = LO.prompt_with_previous(df, "b", "r", "ids", F.lit(True), 9)  # 3 + 6 = 9 is not < 9
    assert {(r.b, r.r): r.labels for r in short.collect()}[(1, 1)] == [S, LANG, TASK, NT, 21, E]


def test_prompt_keeps_repeated_rows_and_bridges_gaps(spark):
    rows = [(1, 0, [S, LANG, TASK, NT, 11, E], "a"), (1, 4, [S, LANG, TASK, NT, 21, E], "b"), (1, 4, [S, LANG, TASK, NT, 21, E], "c"),
            (1, 9, [S, LANG, TASK, NT, 31, E], "d"), (2, 3, [S, LANG, TASK, NT, 41, E], "e")]
    df = spark.createDataFrame(rows, "b long, r long, ids array<int>, tag string")
    got = {r.tag: r.labels for r in LO.prompt_with_previous(df, "b", "r", "ids", F.lit(True), 448).collect()}
    assert got == {"a": rows[0][2], "b": [L.PREV, 11, *rows[1][2]], "c": [L.PREV, 11, *rows[2][2]], "d": [L.PREV, 21, *rows[3][2]], "e": rows[4][2]}


def test_printed_ids_decode_by_vocabulary(spark):
    vocab = spark.createDataFrame([(0, "<|s|>", True), (5, "a", False), (6, "", False), (7, "c", False)], "token_id long, token string, special boolean")
    rows = [(1, "[0 5 6 7 0]"), (2, "[7, 5]"), (3, "plain [5]"), (4, "[]"), (5, None), (6, "[0]"), (7, "5 6")]
    df = spark.createDataFrame(rows, "k long, t string")
    got = {r.k: r.t for r in LO.decode_token_text(df, ["k"], "t", vocab).collect()}
    assert got == {1: "a  c", 2: "c a", 3: "plain [5]", 4: "", 5: None, 6: "", 7: "5 6"}
    with pytest.raises(Exception, match="no token for id 9"):
        LO.decode_token_text(spark.createDataFrame([(1, "[9]")], "k long, t string"), ["k"], "t", vocab).collect()


def test_prompt_mask_and_shift(spark):
    df = spark.createDataFrame([([9, 8, S, 1, 2],), ([5, 6, 7, 8],), ([S, 1, 2, 3],)], "t array<int>")
    got = [r.o for r in df.select(L.mask_prompt("t").alias("o")).collect()]
    assert got == [[-100, -100, -100, 1, 2], [5, 6, 7, 8], [S, 1, 2, 3]]
    p = spark.createDataFrame([([1, 2, 3, E, E],)], "p array<int>")
    r = p.select(L.shift_inputs("p").alias("i"), L.shift_targets("p", F.lit(3)).alias("t")).first()
    assert r.i == [1, 2, 3, E] and r.t == [2, 3, -100, -100]


def test_pad_batch_drops_leading_bos_only_if_all(spark):
    df = spark.createDataFrame([(1, 0, [S, 1]), (1, 1, [S, 1, 2]), (2, 0, [S, 1]), (2, 1, [7, 1, 2, 3])], "b long, r long, labels array<int>")
    got = {(r.b, r.r): r.labels_padded for r in LO.pad_batch(df, "b", "labels", -100, drop_leading=S).collect()}
    assert got[(1, 0)] == [1, -100] and got[(1, 1)] == [1, 2]
    assert got[(2, 0)] == [S, 1, -100, -100] and got[(2, 1)] == [7, 1, 2, 3]


def test_length_filters(spark):
    df = spark.createDataFrame([(n,) for n in (480000, 479999, 0, 1)], "n int")
    keep = [r.n for r in df.where((F.col("n") > 0) & (F.col("n") < 480000)).collect()]
    assert keep == [479999, 1]  # both bounds strict (0 s < d < 30 s at 16 kHz)
    lab = spark.createDataFrame([(n,) for n in (0, 1, 128, 129)], "n int").select(F.array_repeat(F.lit(1), F.col("n")).alias("l"))
    assert [len(r.l) for r in lab.where(L.labels_in_range("l", 128)).collect()] == [1, 128]


def test_chunking(spark):
    df = spark.range(19).select(F.col("id").alias("row_idx"))
    assert df.select(chunk_ids(F.col("row_idx"), 19, 10).alias("c")).distinct().count() == 19
    with pytest.raises(Exception):
        spark.range(5).select(chunk_ids(F.col("id"), 5, 10).alias("c")).collect()


def test_spaced_index(spark):
    df = spark.createDataFrame([(32, 4), (12, 3), (5, 1)], "n int, k int")
    got = [r.o for r in df.select(L.spaced_index(F.col("n"), F.col("k")).alias("o")).collect()]
    assert got == [[0, 10, 20, 31], [0, 5, 11], [4]]
    lay = spark.createDataFrame([(12, 3)], "n int, k int").select(L.spaced_index(F.col("n"), F.col("k"), F.floor(F.col("n") / F.col("k")).cast("int") - 1).alias("o"))
    assert lay.first().o == [3, 7, 11]
