"""Edit distance kernels (T24), WER filter (F1) and corpus ratios (A1/A2): fixture rows and properties."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auralith.functions import edit as E
from auralith.operators import metrics as M


def dp(a, b):
    prev = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        cur = [i] + [0] * len(b)
        for j, cb in enumerate(b, 1):
            cur[j] = min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (ca != cb))
        prev = cur
    return prev[-1]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab c東é", max_size=80), st.text(alphabet="ab c東é", max_size=80))
def test_bitparallel_matches_dp(a, b):
    assert E.bitparallel_levenshtein(a, b) == dp(a, b)


def test_vectorised_kernel_matches_scalar():
    rnd = random.Random(11)
    pairs = []
    for la in (0, 1, 63, 64, 65, 127, 128, 129, 191, 640, 1100):  # word boundaries and the scalar fallback
        for _ in range(12):
            a = "".join(rnd.choice("ab cé東") for _ in range(rnd.randint(0, la)))
            b = "".join(rnd.choice("ab cé東") for _ in range(rnd.randint(0, la)))
            pairs.append((a, b))
    got = list(E.batch_levenshtein(pairs, max_words=8))
    assert got == [E.bitparallel_levenshtein(a, b) for a, b in pairs]
    assert got[:30] == [dp(a, b) for a, b in pairs[:30]]


def test_bitparallel_long_pair():
    rnd = random.Random(7)
    a = "".join(rnd.choice("abcdefgh ") for _ in range(700))
    b = a.replace("c", "x")[5:] + "tail"
    assert E.bitparallel_levenshtein(a, b) == dp(a, b)


def test_word_and_char_distance_fixtures(spark):
    df = spark.createDataFrame(
        [("the cat sat on", "the cat sit on mat"), ("東京", "東都"), ("a b", ""), ("", "x y"), ("", "")], "r string, h string")
    out = df.select(
        E.word_edit_distance(E.words("r"), E.words("h")).alias("w"),
        E.char_edit_distance(F.col("r"), F.col("h")).alias("c"),
        E.char_edit_distance(F.col("r"), F.col("h"), method="native").alias("cn"),
    ).collect()
    assert [(r.w, r.c, r.cn) for r in out] == [(2, 5, 5), (1, 1, 1), (2, 3, 3), (2, 3, 3), (0, 0, 0)]


def test_word_distance_beyond_bmp(spark):
    """More distinct words than BMP code points below the surrogates: the surrogate-pair encoding keeps it exact."""
    n = 56000
    df = spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("w"), i.cast("string"))), " ").alias("r"))
    df = df.withColumn("h", F.regexp_replace("r", " w55990 ", " zz "))
    assert df.select(E.word_edit_distance(E.words("r"), E.words("h")).alias("d")).first().d == 1


@settings(max_examples=25, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c", "dd"]), max_size=12), st.lists(st.sampled_from(["a", "b", "c", "dd"]), max_size=12))
def test_word_distance_properties(spark, a, b):
    ra, rb = " ".join(a), " ".join(b)
    df = spark.createDataFrame([(ra, rb)], "r string, h string")
    d = df.select(E.word_edit_distance(E.words("r"), E.words("h")).alias("d"),
                  E.word_edit_distance(E.words("h"), E.words("r")).alias("s"),
                  E.word_edit_distance(E.words("r"), E.words("h"), 3).alias("b")).first()
    assert d.d == d.s == dp(a, b)
    assert abs(len(a) - len(b)) <= d.d <= max(len(a), len(b))
    assert d.b == (d.d if d.d <= 3 else -1)


def test_wer_filter_is_strict(spark):
    ref = "a b c d e f g h i j"
    df = spark.createDataFrame([(1, ref, "a b c d e f g h i x"), (2, ref, ref), (3, "", "x"), (4, "a", None)],
                               "id int, r string, h string")
    kept = M.wer_filter(df, "r", "h", 10.0).select("id").collect()
    assert [r.id for r in kept] == [2]  # WER exactly 10 is dropped; empty reference and NULL hypothesis dropped


def test_corpus_wer_is_ratio_of_sums(spark):
    df = spark.createDataFrame([("a b", "a"), ("c d e f", "c d e f")], "r string, h string")
    df = M.with_pair_counts(df, "r", "h", "x", chars=False)
    wer = df.agg(M.ratio_pct(F.col("word_edits_x"), F.col("n_ref_words_x")).alias("w")).first().w
    assert wer == pytest.approx(100.0 / 6)


def test_vectorised_kernel_large_alphabet(monkeypatch):
    """A CJK-sized alphabet forces the chunk to split under the match-table budget; results stay exact."""
    monkeypatch.setattr(E, "MATCH_TABLE_BYTES", 1 << 16)
    rnd = random.Random(2)
    alphabet = [chr(0x4E00 + i) for i in range(3000)]
    pairs = [("".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 150))),
              "".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 150)))) for _ in range(200)]
    assert list(E.batch_levenshtein(pairs)) == [E.bitparallel_levenshtein(a, b) for a, b in pairs]


def test_bounded_equals_full_on_real_utterances(spark):
    from auralith.functions import text as T
    from auralith.plans import derived as D
    from conftest import SF_SMALL

    u = D.with_hypothesis(D.utterances(spark.read.parquet(f"{SF_SMALL}/documents.parquet")))
    rw, hw = E.words(T.basic_normalize("reference_raw")), E.words(T.basic_normalize("prediction_raw"))
    n = F.size(rw)
    bound = E.wer_bound(n, 20.0)
    df = u.select(E.word_edit_distance(rw, hw).alias("full"), E.word_edit_distance(rw, hw, bound).alias("b"), bound.alias("k"))
    bad = df.where("(b = -1 AND full <= k) OR (b <> -1 AND (b <> full OR full > k))").count()
    assert bad == 0 and df.count() > 0
