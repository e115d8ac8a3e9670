"""Longest-match token ids (T17) against brute force, round trips, truncation and vocabulary checks."""

import os
import random

import pytest
from pyspark.sql import functions as F

from auralith.operators import vocabulary as V

TEXTS = ["", None, "the cat", " a  b", "Zürich 東京 😀\n", "abcabcabd abx", "x" * 5000, " leading", "trailing ", "\x00\x7f"]


def brute(data, tokens):
    out, at = [], 0
    while at < len(data):
        best = max((t for t in tokens if data.startswith(t, at)), key=len)
        out.append(tokens[best])
        at += len(best)
    return out


def made(spark, tokens):
    return spark.createDataFrame([(n, bytearray(t)) for t, n in tokens.items()], "token_id int, token binary")


def test_ids_are_the_longest_matches_and_read_back(spark):
    rng = random.Random(2)
    tokens = {bytes([b]): b for b in range(256)}
    for i in range(300):
        piece = "".join(rng.choice("abcxth e") for _ in range(rng.randrange(2, 6))).encode()
        tokens.setdefault(piece, 1000 + i)
    texts = TEXTS + ["".join(rng.choice("abcxth eé") for _ in range(rng.randrange(80))) for _ in range(60)]
    vocabulary = V.Vocabulary(made(spark, tokens))
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").repartition(3)
    rows = df.withColumns({"ids": vocabulary.ids(F.col("t")), "cut": vocabulary.ids(F.col("t"), max_length=3)}).withColumn("back", vocabulary.text(F.col("ids")))
    for r in rows.collect():
        want = None if r.t is None else brute(r.t.encode(), tokens)
        assert r.ids == want and r.back == r.t and r.cut == (None if want is None else want[:3])


def test_unknown_bytes_and_ids(spark):
    table = made(spark, {b"a": 1, b"ab": 2, b"b": 3})
    df = spark.createDataFrame([("abxaé",)], "t string")
    assert df.select(V.Vocabulary(table, unknown=0).ids(F.col("t"))).first()[0] == [2, 0, 1, 0, 0]
    with pytest.raises(Exception, match="no token for byte"):
        df.select(V.Vocabulary(table).ids(F.col("t"))).collect()
    with pytest.raises(Exception):
        spark.createDataFrame([([9],)], "i array<int>").select(V.Vocabulary(table).text(F.col("i"))).collect()


def test_vocabularies_are_checked(spark):
    with pytest.raises(ValueError, match="more than 2"):
        V.Vocabulary(made(spark, {b"a": 1, b"b": 2, b"c": 3}), max_tokens=2)
    for rows in ([(1, b"a"), (1, b"b")], [(1, b"a"), (2, b"a")], [(1, b"")]):
        with pytest.raises(ValueError, match="empty or repeated"):
            V.Vocabulary(spark.createDataFrame([(n, bytearray(t)) for n, t in rows], "token_id int, token binary"))


def test_vocabulary_by_rule(spark):
    rows = {bytes(r.token): r.token_id for r in V.letter_vocabulary(spark).collect()}
    assert len(rows) == 19_210 and rows[b"a"] == 97 and rows[b"aa"] == 256 and rows[b"zzz"] == 256 + 676 + 17_575 and rows[b" zz"] == 19_209


PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary file here")
def test_ids_by_a_public_vocabulary_file(spark):
    table = V.read_ranks(spark, PATH)
    vocabulary = V.Vocabulary(table)
    tokens = {bytes(r.token): r.token_id for r in table.collect()}
    assert vocabulary.size == len(tokens) == 50_256
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string").withColumn("ids", vocabulary.ids(F.col("t")))
    for r in df.withColumn("back", vocabulary.text(F.col("ids"))).collect():
        assert r.back == r.t
        if r.t:
            first = max((t for t in tokens if r.t.encode().startswith(t)), key=len)
            assert r.ids[0] == tokens[first]
