"""Text functions: normaliser, whitespace rules, cleaners' building blocks, punctuation repair, rounding."""

from pyspark.sql import functions as F

from auralith.functions import text as T


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "s string").select(expr(F.col("s")).alias("o")).first().o


def test_basic_normalize(spark):
    assert one(spark, T.basic_normalize, "Hello,  World (aside) [x] <b>Ünïcode</b>\tTab!") == "hello world ünïcode tab "
    assert one(spark, T.basic_normalize, "ﬁ ＡＢ") == "fi ab"  # NFKC (compatibility characters)


def test_collapse_keeps_single_tab(spark):
    assert one(spark, T.jiwer_clean, "  a  b\tc  ") == "a b\tc"
    assert one(spark, T.strip_ws, "　x ") == "x"


def test_japanese_normalize(spark):
    assert one(spark, T.japanese_normalize, "今日は 晴れ。") == "今日は晴れ"


def test_unquote_and_suffix(spark):
    assert one(spark, T.unquote_sentence, '"He said ""hi"""') == 'He said "hi"'
    assert one(spark, T.unquote_sentence, '"') == ""
    assert one(spark, T.trim_paren_suffix, "some words (k1)") == "some words"
    assert one(spark, T.trim_paren_suffix, "(k1)") == "(k1)"


def test_gender_and_suffix(spark):
    assert one(spark, T.parse_gender, "<o,f0,F>") == "female"
    assert one(spark, T.parse_gender, "<o,f0,M>") == "male"
    assert one(spark, T.parse_gender, "<NA>") == "-1"
    assert one(spark, lambda c: T.remove_suffix(c, ".sph"), "hpsxx.sph") == "hpsxx"


def test_punct_repair(spark):
    df = spark.createDataFrame([("raw", "あ。い。"), ("raw", "あ。い。うえおか"), ("raw", "unk。x。"), ("raw", "一つ。")], "r string, p string")
    got = [r.o for r in df.select(T.punct_repair(F.col("r"), F.col("p")).alias("o")).collect()]
    assert got == ["あい。", "あいう。えおか", "raw", "一つ。"]


def test_pandas_round_half_even(spark):
    import pandas as pd

    xs = [0.25, 0.35, 2.5, 1.45, 9.825]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r.o for r in df.select(T.pandas_round(F.col("x"), 1).alias("o")).collect()]
    assert got == pd.Series(xs).round(1).tolist()  # pandas/numpy semantics (0.35 -> 0.4, unlike Python's round)
    assert spark.range(1).select(F.bround(F.lit(0.25), 1).alias("b")).first().b == 0.2


def test_int_list_and_timestamps(spark):
    assert one(spark, T.int_list_from_text, "[11 12 13]") == [11, 12, 13]
    assert one(spark, T.remove_timestamp_tokens, "<|0.00|> hi<|1.20|>") == " hi"
    assert one(spark, T.has_markup, "a <b> c") is True
