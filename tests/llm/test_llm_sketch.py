"""Document sketches against a plain statement of the definition, and their edge cases."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from auralith.llm import doc_sketch


def plain_sketch(text, width=5, fraction=0.25):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    runs = [words[i: i + width] for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = sorted({hashlib.md5(" ".join(r).encode()).hexdigest()[:16] for r in runs})
    return [h for h in hashes if h < doc_sketch.threshold(fraction)] or hashes[:1]


def plain_likeness(a, b):
    return len(set(a) & set(b)) / min(len(a), len(b)) if a and b else float(len(a) == len(b))


RNG = random.Random(12)
WORDS = ["ab", "Ünï", "c.", "東京", "😀x", "dd\x1cd", "e"]
TEXTS = ["", None, "one", "a b c d", "a b c d e", " \t\x0b ", "x\x0by  z", "😀" * 7, "ab " * 400] + [
    " ".join(RNG.choice(WORDS) for _ in range(RNG.randrange(1, 60))) for _ in range(30)]


def test_sketch_is_the_definition(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, text string")
    for width, fraction in ((5, 0.25), (2, 0.9), (3, 1.0)):
        got = {r.i: list(r.s) for r in df.select("i", doc_sketch.sketch(F.col("text"), width, fraction).alias("s")).collect()}
        assert got == {i: plain_sketch(t, width, fraction) for i, t in enumerate(TEXTS)}


def test_merged_sketch_and_containment_of_unequal_texts(spark):
    long = " ".join(f"w{RNG.randrange(10 ** 6)}" for _ in range(20_000))
    short = " ".join(long.split()[5000:5400])
    df = spark.createDataFrame([(long, short)], "a string, b string")
    a, b = doc_sketch.sketch(F.col("a")), doc_sketch.sketch(F.col("b"))
    both = doc_sketch.sketch(F.concat_ws(" ", F.col("a"), F.lit("zz"), F.col("b")))
    near, merged, whole = df.select(doc_sketch.likeness(a, b), doc_sketch.merge(a, b), both).first()
    assert near == 1.0
    assert set(merged) <= set(whole) and len(set(whole) - set(merged)) <= 8  # the shingles across the joint


def plain_compare(rows):
    out = []
    for at, (doc, text) in enumerate(rows):
        after = rows[(at + 1) % len(rows)][1] or ""
        text = text or ""
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        a, b, c = (plain_sketch(x) for x in (text, edited, after))
        out.append((doc, len(text), edited, "".join(a), "".join(b), plain_likeness(a, b), plain_likeness(a, c)))
    return sorted(out, key=str)


def compared(spark, rows, **extra):
    df = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id long, text string, sketch string").repartition(3)
    return sorted(((r.doc_id, r.n_chars, r.edited, "".join(r.sketch), "".join(r.edited_sketch), r.near_edited, r.near_next)
                   for r in doc_sketch.compare_next(df, **extra).collect()), key=str)


def test_next_document_in_descending_order(spark):
    rows = [(i * 3 - 20, t) for i, t in enumerate(TEXTS)][::-1]
    assert compared(spark, rows) == plain_compare(rows)


@pytest.mark.parametrize("rows", [[], [(4, "a b c d e f")], [(4, None)], [(None, "a b"), (None, "a b"), (None, "a b")]])
def test_few_documents(spark, rows):
    assert compared(spark, rows) == plain_compare(rows)


def test_repeated_rows_follow_each_other_and_null_ids_come_last(spark):
    got = compared(spark, [(9, "p q r"), (7, "a b c"), (7, "a b c"), (None, "u v w")])
    assert got == plain_compare([(9, "p q r"), (7, "a b c"), (7, "a b c"), (None, "u v w")])


def test_rows_of_one_id_keep_one_outcome(spark):
    rows = [(5, f"text {i} of the same id") for i in range(6)] + [(5, None), (1, "last")]
    first = compared(spark, rows)
    assert first == compared(spark, rows[::-1]) and len(first) == len(rows)
    assert sorted(str(r[1]) for r in first) == sorted(str(len(t or "")) for _, t in rows)
