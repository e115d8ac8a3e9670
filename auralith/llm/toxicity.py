"""Toxicity scoring by non-negative positive-unlabelled learning (operator 9).

Positives are texts confirmed as toxic; everything else is unlabelled text, never taken as clean. The classifier is
linear over the presence of words and of 4- and 5-byte pieces inside words, hashed to ``2**BITS`` features. With the class
prior ``p`` (the share of toxic rows among the labelled training rows), the risk is ``p * R+(positives) + max(0,
R-(unlabelled) - p * R-(positives))`` for the logistic loss; where the bracket turns negative, the step goes the other
way to undo the overfit.

Fitting uses at most ``positives`` confirmed and ``unlabelled`` other training texts, drawn by a hash of the id; this
bound is a parameter and the only limit. Their features are counted on Spark, the most telling ``features`` are kept, and
the numpy fit sees only those. Scoring covers every whole text in one pass without a shuffle, so no key can be hot.

Defined cases: a null or empty text scores as a text without features; without any confirmed text nothing is toxic
(score 0); a null id belongs to the training part; repeated rows are scored each; a null label is unlabelled; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auralith.llm import blocks
from auralith.llm.columns import Carried

BITS = 20
GRAMS = (4, 5)
_PART = np.zeros(256, bool)  # bytes that a word's core begins and ends with
_PART[48:58] = _PART[65:91] = _PART[97:123] = _PART[128:] = True


def features(texts: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) pairs, each once, sorted; ``wanted``: mask of the features to look for."""
    words = blocks.scan(texts, lower=True)
    data, start, end = words.data, words.start, words.end
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    values = blocks._BYTE[data]
    place = np.arange(len(data))
    part = _PART[data]
    core_end = np.maximum.accumulate(np.where(part, place + 1, 0))[end - 1]
    core_start = np.minimum.accumulate(np.where(part, place, len(data))[::-1])[::-1][start]
    some = core_start < core_end
    rows, found = [], []

    def add(row: np.ndarray, hashes: np.ndarray, kind: int) -> None:
        feature = (blocks.mix(hashes + np.uint64(kind)) >> np.uint64(64 - BITS)).astype(np.int64)
        keep = slice(None) if wanted is None else wanted[feature]
        rows.append(row[keep])
        found.append(feature[keep])

    add(words.row[some], blocks.span_hashes(values, core_start[some], core_end[some], 0x9E3779B97F4A7C15), 1)
    length = end - start
    stop = np.repeat(end, length)
    inside = np.repeat(start - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))  # every byte of a word
    row = np.repeat(words.row, length)
    for size in GRAMS:
        fits = inside + size <= stop
        at = inside[fits]
        add(row[fits], blocks.span_hashes(values, at, at + size, 0xD6E8FEB86659FD93), size)
    pairs = np.unique((np.concatenate(rows) << BITS) | np.concatenate(found))
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def _frequencies(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of positive and of unlabelled texts with each feature; feature -1 counts the texts."""
    count = np.zeros((2, 1 << BITS), np.int64)
    texts = np.zeros(2, np.int64)
    for piece in blocks.batches(frames):
        role = np.asarray(piece.column("role"), np.int64)
        row, feature = features(piece.column("text"))
        for r in (0, 1):
            np.add.at(count[r], feature[role[row] == r], 1)
            texts[r] += int((role == r).sum())
    some = np.flatnonzero(count.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(count[0, some], texts[0])),
                                      pa.array(np.append(count[1, some], texts[1]))], ["feature", "unlabelled", "positive"])


def _rows(wanted: np.ndarray) -> Callable:
    def select(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in blocks.batches(frames):
            row, feature = features(piece.column("text"), wanted)
            cut = np.searchsorted(row, np.arange(piece.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([piece.column("role"), pa.ListArray.from_arrays(pa.array(cut), pa.array(feature.astype(np.int32)))], ["role", "found"])

    return select


@dataclass
class Model:
    weight: np.ndarray  # float32, one per feature
    bias: float
    prior: float


def nn_pu(positive: tuple[np.ndarray, np.ndarray], unlabelled: tuple[np.ndarray, np.ndarray], n: tuple[int, int], size: int, prior: float,
          steps: int = 400, rate: float = 0.05, decay: float = 1e-4, beta: float = 0.0) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the non-negative risk. Each part: (row, feature) pairs of n rows."""
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    w[-1] = np.log(prior / (1 - prior))

    def margin(part: tuple, rows: int) -> np.ndarray:
        return w[-1] + np.bincount(part[0], weights=w[part[1]], minlength=rows)

    def gradient(part: tuple, slope: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(part[1], weights=slope[part[0]], minlength=size), slope.sum())

    def sigmoid(x: np.ndarray) -> np.ndarray:
        return 0.5 * (1 + np.tanh(0.5 * x))

    for step in range(1, steps + 1):
        fp, fu = margin(positive, n[0]), margin(unlabelled, n[1])
        bracket = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        g_up = gradient(positive, -sigmoid(-fp) / n[0])
        g_negative = gradient(unlabelled, sigmoid(fu) / n[1]) - prior * gradient(positive, sigmoid(fp) / n[0])
        g = prior * g_up + g_negative if bracket >= -beta else -g_negative
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return w[:-1], float(w[-1])


def telling(in_p: np.ndarray, n_p: int, in_u: np.ndarray, n_u: int, keep: int, lift: float) -> np.ndarray:
    """Features that mark positives: at least ``lift`` times as frequent as in unlabelled text, with a likelihood ratio
    beyond what the best of as many chance features would reach (the 64 best, if none is). At most ``keep``."""
    a, b = in_p / n_p, in_u / n_u
    pooled = (in_p + in_u) / (n_p + n_u)

    def part(k: np.ndarray, n: int, p: np.ndarray) -> np.ndarray:
        return k * np.log(np.maximum(p, 1e-300)) + (n - k) * np.log(np.maximum(1 - p, 1e-300))

    ratio = 2 * (part(in_p, n_p, a) + part(in_u, n_u, b) - part(in_p, n_p, pooled) - part(in_u, n_u, pooled))
    ratio = np.where(a >= lift * b, ratio, 0.0)
    order = np.argsort(-ratio, kind="stable")
    sure = int((ratio >= 2 * np.log(max(2, len(ratio)))).sum())
    order = order[: min(keep, sure or 64)]
    return order[ratio[order] > 0]


def fold(id_column: Column, modulus: int = 5) -> Column:
    """crc32 of the id as text, modulo ``modulus``."""
    return F.crc32(id_column.cast("string").cast("binary")) % modulus


def fit(docs: DataFrame, labels: DataFrame, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        positives: int = 20_000, unlabelled: int = 40_000, keep: int = 4096, lift: float = 2.0) -> Model:
    """``train``: condition on the id column of either table; null means every row."""
    train = F.lit(True) if train is None else train
    ids = labels.filter(train).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y is not null")
    known = ids.agg(F.avg((F.col("y") == 1).cast("double"))).first()[0]
    nothing = Model(np.zeros(1 << BITS, np.float32), -np.inf, 0.0)
    if not known:
        return nothing
    draw = F.xxhash64(F.col("id"), F.lit(9))
    chosen = ids.filter("y = 1").select("id").distinct().orderBy(draw).limit(positives).withColumn("role", F.lit(1).cast("long"))
    others = docs.filter(train).select(F.col(id_col).cast("long").alias("id")).filter("id is not null").orderBy(draw).limit(unlabelled)
    both = chosen.unionByName(others.distinct().withColumn("role", F.lit(0).cast("long")))
    sample = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(both), "id")
    sample = sample.select("role", "text")  # the ids sent are bounded by the two parameters
    got = sample.mapInArrow(_frequencies, "feature long, unlabelled long, positive long").groupBy("feature").agg(
        F.sum("unlabelled"), F.sum("positive")).toArrow()  # at most 2**BITS rows
    feature, in_u, in_p = (np.asarray(c, np.int64) for c in got.columns)
    texts = {int(r): (int(u), int(p)) for r, u, p in zip(feature[feature < 0], in_u[feature < 0], in_p[feature < 0])}.get(-1, (0, 0))
    if not texts[0] or not texts[1]:
        return nothing
    feature, in_u, in_p = (x[feature >= 0] for x in (feature, in_u, in_p))
    best = feature[telling(in_p, texts[1], in_u, texts[0], keep, lift)]
    wanted = np.zeros(1 << BITS, bool)
    wanted[best] = True
    index = np.full(1 << BITS, -1, np.int64)
    index[np.flatnonzero(wanted)] = np.arange(int(wanted.sum()))
    table = sample.mapInArrow(_rows(wanted), "role long, found array<int>").toArrow()
    role, lists = np.asarray(table.column("role"), np.int64), table.column("found").combine_chunks()
    lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks)
    size = np.diff(np.asarray(lists.offsets, np.int64))
    row, flat = np.repeat(np.arange(len(role)), size), index[np.asarray(lists.flatten(), np.int64)]
    number = np.where(role == 1, np.cumsum(role == 1), np.cumsum(role == 0)) - 1
    parts = [(number[row[role[row] == r]], flat[role[row] == r]) for r in (1, 0)]
    prior = float(np.clip(known, 1e-4, 0.9))
    w, bias = nn_pu(parts[0], parts[1], (int((role == 1).sum()), int((role == 0).sum())), int(wanted.sum()), prior)
    weight = np.zeros(1 << BITS, np.float32)
    weight[np.flatnonzero(wanted)] = w
    return Model(weight, bias, prior)


def _scorer(shared, names: list[str], text: str) -> Callable:
    def score(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias = shared.value
        wanted = weight != 0
        for piece in blocks.batches(frames, text):
            row, feature = features(piece.column(text), wanted)
            margin = bias + np.bincount(row, weights=weight[feature], minlength=piece.num_rows)
            yield pa.RecordBatch.from_arrays([piece.column(n) for n in names] + [pa.array(0.5 * (1 + np.tanh(0.5 * margin)))], [*names, "__score"])

    return score


def score(docs: DataFrame, model: Model, text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """``docs`` (or its ``columns``) with ``score`` and ``predicted``."""
    from pyspark.sql import types as T

    carried = Carried(docs)
    text, rows = carried.name(text_col), carried.rows
    carried.only(docs.columns if columns is None else columns)
    if text not in carried.names or docs.schema[text_col].dataType != T.StringType():  # else the text is sent once
        rows, text = rows.withColumn("__text", F.col(text).cast("string")), "__text"
    rows = rows.select(*dict.fromkeys([*carried.names, text]))
    schema = T.StructType([*rows.select(*carried.names).schema.fields, T.StructField("__score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast((model.weight, model.bias))
    out = rows.mapInArrow(_scorer(shared, carried.names, text), schema).withColumn("__predicted", (F.col("__score") >= 0.5).cast("int"))
    return carried.back(out, "score", "predicted")
