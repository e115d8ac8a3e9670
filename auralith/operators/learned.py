"""A predictor learned from a table (M1, X6): nearest class mean, a linear classifier.

The fit is one partial aggregate over (label, dimension): sums and counts, so neither a frequent label nor a large table
meets in one task, and only labels x dimensions numbers (checked against ``MAX_WEIGHTS``) reach the driver. They are
stored as one Parquet file in the shared folder. ``predict_batch_udf`` loads them once per Python worker and scores a
batch as one matrix product; rows travel in their scan splits, without a shuffle.

Defined cases: null vectors, vectors of another length than the weights' and vectors that hold a null or a non-finite
component are not learned from and get a null prediction and margin; rows without a label are scored but not learned
from; ties go to the smaller label; with one label the margin is null; a table without any usable row is an error.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_WEIGHTS = 1 << 22  # numbers a model may have (32 MB)


def _usable(vector: str, size: int | None = None) -> Column:
    """The vector holds at least one number and nothing but finite numbers."""
    x = F.col(f"`{vector}`")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    whole = x.isNotNull() & (F.size(x) > 0 if size is None else F.size(x) == size)
    return F.coalesce(whole & finite, F.lit(False))


def fit_centroids(df: DataFrame, vector: str, label: str, path: str) -> str:
    """Store the mean vector of every label below ``path`` (rows label, mean) and return it. The vectors' length is that of
    the longest usable ones; others are left out."""
    rows = df.filter(F.col(f"`{label}`").isNotNull() & _usable(vector)).select(
        F.col(f"`{label}`").cast("long").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("x"))
    size = rows.agg(F.max(F.size("x"))).first()[0]
    if size is None:
        raise ValueError("no labelled vector to learn from")
    rows = rows.filter(F.size("x") == size)
    sums = rows.select("label", F.posexplode("x").alias("d", "v")).groupBy("label", "d").agg(F.avg("v").alias("c"))
    kinds = rows.select("label").distinct().count()
    if kinds * size > MAX_WEIGHTS:
        raise ValueError(f"{kinds} labels of {size} numbers each are more than {MAX_WEIGHTS} weights")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("d", "c"))), lambda p: p["c"])  # one number a dimension
    sums.groupBy("label").agg(ordered.alias("mean")).coalesce(1).write.parquet(path)
    return path


def load_weights(df: DataFrame, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels in order, their means and biases; at most ``MAX_WEIGHTS`` numbers, as the fit has checked."""
    held = df.sparkSession.read.parquet(path).orderBy("label").collect()
    means = np.array([r["mean"] for r in held])
    return np.array([r["label"] for r in held], np.int64), means, -(means * means).sum(axis=1) / 2


def predict_labels(df: DataFrame, vector: str, path: str, batch_size: int = 4096) -> DataFrame:
    """``df`` with ``predicted`` (label) and ``margin`` (the best score less the second best), in place of columns of these names."""
    sc = df.sparkSession.sparkContext
    weights = sc.broadcast(load_weights(df, path))  # bounded by MAX_WEIGHTS

    def load():
        labels, means, bias = weights.value

        def predict(x: np.ndarray) -> dict[str, np.ndarray]:
            scores = x @ means.T + bias
            best = scores.argmax(axis=1)  # the first of equal scores: the smaller label
            if scores.shape[1] > 1:
                top = np.partition(scores, -2, axis=1)
                margin = top[:, -1] - top[:, -2]
            else:
                margin = np.full(len(x), np.nan)
            return {"predicted": labels[best], "margin": margin}

        return predict

    size = len(weights.value[1][0])
    result = T.StructType([T.StructField("predicted", T.LongType()), T.StructField("margin", T.DoubleType())])
    head = predict_batch_udf(load, return_type=result, batch_size=batch_size, input_tensor_shapes=[[size]])
    good, x = _usable(vector, size), F.col(f"`{vector}`").cast("array<double>")
    filled = F.when(good, x).otherwise(F.array_repeat(F.lit(0.0), size))
    name = f"__head_{uuid.uuid4().hex[:8]}"
    out = df.drop("predicted", "margin").withColumn(name, head(filled))
    return out.withColumns({"predicted": F.when(good, F.col(f"{name}.predicted")),
                            "margin": F.when(good & ~F.isnan(f"{name}.margin"), F.col(f"{name}.margin"))}).drop(name)
