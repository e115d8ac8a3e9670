"""Language identification by rank-order n-gram profiles (operator 10).

A profile lists a language's ``size`` most frequent n-grams (1 to 3 letters, a blank at each word end) in order of
frequency. A text's own most frequent n-grams are compared with every profile by out-of-place distance: how far each
n-gram stands from its place in the profile, or ``size`` if it is not there. The nearest profile wins; the score is one
minus its distance as a share of the largest possible.

Letters are whatever Unicode calls alphabetic, lower-cased, each by its own code point in every script: an n-gram is three
places of 21 bits in one number. Profiles count every letter of every training text: tasks merge
their counts and send one row per language and n-gram. Scoring is one pass without a shuffle.

Defined cases: a text that is null or has no letters is ``und`` with score 0, and so is every text if nothing was
learned; ties go to the smaller language code; a null language teaches nothing; repeated rows count and are scored each;
an empty table gives an empty result.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auralith.llm import blocks
from auralith.llm.columns import Carried

_BITS, _BLANK = 21, 1  # of a code point; a blank inside an n-gram, which is no letter's code point
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """The lower-case code point of every letter; 0 for what is no letter."""
    global _letters
    if _letters is None:
        table = np.zeros(sys.maxunicode + 1, np.int32)
        for point in range(sys.maxunicode + 1):
            letter = chr(point)
            if letter.isalpha():
                table[point] = ord(letter.lower()[0])
        _letters = table
    return _letters


def counted(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, n-gram, count) of every n-gram of the texts, sorted by row."""
    strings = [t or "" for t in texts.to_pylist()]
    points = np.frombuffer(("\n" + "\n".join(strings) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(strings) + 1), [len(t) + 1 for t in strings] + [1])
    table = letters()
    found = table[points]
    keep = found > 0
    keep[1:] |= found[:-1] > 0  # one blank for a run of them
    keep[0] = True
    found, row = found[keep], row[keep]
    here = np.zeros(len(table), bool)
    here[found] = True
    here[0] = True
    distinct = np.flatnonzero(here)  # the letters of these texts, the blank first: n-grams are short numbers while they are counted
    number = np.zeros(len(table), np.int32)
    number[distinct] = np.arange(len(distinct))
    c, size = number[found].astype(np.int64), len(distinct)
    one = np.flatnonzero(c)
    two = np.flatnonzero((c[:-1] > 0) | (c[1:] > 0))
    three = one[(one > 0) & (one < len(c) - 1)]
    gram = np.concatenate([c[one], size + c[two] * size + c[two + 1], size + size ** 2 + (c[three - 1] * size + c[three]) * size + c[three + 1]])
    row = np.concatenate([row[one], np.where(c[two] > 0, row[two], row[two + 1]), row[three]])
    most = size + size ** 2 + size ** 3
    if (len(strings) + 1) * most < 1 << 63:
        keys = np.sort(row * most + gram)
        row, gram = keys // most, keys % most
    else:
        order = np.lexsort((gram, row))
        row, gram = row[order], gram[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])
    at = np.flatnonzero(new)
    return row[at], _named(gram[at], distinct), np.diff(np.append(at, len(row)))


def _named(gram: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    """The n-grams by code points."""
    size = len(distinct)
    point = np.where(distinct > 0, distinct, _BLANK).astype(np.int64)
    three, two = gram - size - size ** 2, gram - size
    out = point[np.where(two < 0, gram, 0)]
    pair, triple = (two >= 0) & (three < 0), three >= 0
    out[pair] = (point[two[pair] // size] << _BITS) | point[two[pair] % size]
    x = three[triple]
    out[triple] = (point[x // size ** 2] << 2 * _BITS) | (point[x // size % size] << _BITS) | point[x % size]
    return out


def spelled(gram: int) -> str:
    """An n-gram as text, its blanks as blanks."""
    return "".join(" " if p == _BLANK else chr(p) for p in (gram >> 2 * _BITS, (gram >> _BITS) & (1 << _BITS) - 1, gram & (1 << _BITS) - 1) if p)


def _counter(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    waiting = 0

    def merge() -> None:
        for lang, parts in held.items():
            value, inverse = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True)
            held[lang] = [(value, np.bincount(inverse, weights=np.concatenate([n for _, n in parts]), minlength=len(value)))]

    for piece in blocks.batches(frames):
        row, gram, n = counted(piece.column("text"))
        names, lang = np.unique(np.array(piece.column("lang").to_pylist(), object).astype(str), return_inverse=True)
        for k, name in enumerate(names.tolist()):
            mine = lang[row] == k
            held.setdefault(name, []).append((gram[mine], n[mine].astype(float)))
        waiting += len(gram)
        if waiting > 2_000_000:
            merge()
            waiting = 0
    merge()
    for lang, [(value, n)] in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(value), pa.string()), pa.array(value), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


@dataclass
class Profiles:
    languages: list[str]
    listed: np.ndarray  # the n-grams of all profiles, sorted; each has a column in ``ranks``, the last is that of all others
    ranks: np.ndarray  # languages x listed n-grams: place in the profile, ``size`` where it is not
    size: int


def fit(train: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = 400) -> Profiles:
    texts = train.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter("lang is not null and text is not null")
    counts = texts.mapInArrow(_counter, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")) - 1
    top = counts.withColumn("rank", rank).filter(F.col("rank") < size).select("lang", "gram", "rank").toArrow()  # size rows a language
    lang, gram, place = top.column("lang").to_pylist(), np.asarray(top.column("gram"), np.int64), np.asarray(top.column("rank"), np.int64)
    languages = sorted(set(lang))
    listed = np.unique(gram)
    ranks = np.full((len(languages), len(listed) + 1), size, np.int32)
    ranks[[languages.index(x) for x in lang], np.searchsorted(listed, gram)] = place
    return Profiles(languages, listed, ranks, size)


def distances(texts: pa.Array, profiles: Profiles) -> tuple[np.ndarray, np.ndarray]:
    """Out-of-place distance to every language (languages x texts) and number of n-grams compared."""
    row, gram, n = counted(texts)
    order = np.lexsort((gram, -n, row))
    row, gram = row[order], gram[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    top = place < profiles.size
    row, gram, place = row[top], gram[top], place[top]
    at = np.minimum(np.searchsorted(profiles.listed, gram), len(profiles.listed) - 1)
    ranks = profiles.ranks[:, np.where(profiles.listed[at] == gram, at, len(profiles.listed))]
    out = np.where(ranks < profiles.size, np.abs(ranks - place), profiles.size)
    return np.stack([np.bincount(row, weights=d, minlength=len(texts)) for d in out]), np.bincount(row, minlength=len(texts))


def _predictor(shared, names: list[str]) -> Callable:
    def predict(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles(*shared.value)
        for piece in blocks.batches(frames, "__text"):
            if profiles.languages:
                far, n = distances(piece.column("__text"), profiles)
                best = far.argmin(axis=0)
                score = np.where(n > 0, 1 - far.min(axis=0) / np.maximum(1, n * profiles.size), 0.0)
                lang = [profiles.languages[b] if k else "und" for b, k in zip(best.tolist(), n.tolist())]
            else:
                lang, score = ["und"] * piece.num_rows, np.zeros(piece.num_rows)
            yield pa.RecordBatch.from_arrays([piece.column(c) for c in names] + [pa.array(lang, pa.string()), pa.array(np.asarray(score, float))],
                                             [*names, "__lang_pred", "__score"])

    return predict


def predict(docs: DataFrame, profiles: Profiles, text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """``docs`` (or its ``columns``) with ``lang_pred`` and ``score``."""
    carried = Carried(docs)
    rows = carried.rows.withColumn("__text", carried.col(text_col).cast("string"))
    carried.only(docs.columns if columns is None else columns)
    rows = rows.select(*carried.names, "__text")
    schema = T.StructType([*rows.select(*carried.names).schema.fields, T.StructField("__lang_pred", T.StringType()), T.StructField("__score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast((profiles.languages, profiles.listed, profiles.ranks, profiles.size))
    return carried.back(rows.mapInArrow(_predictor(shared, carried.names), schema), "lang_pred", "score")
