"""The learned predictor against a direct computation, and its edge cases."""

import numpy as np
import pytest

from auralith.operators import learned as LN

SCHEMA = "vec_id long, label int, embedding array<float>, margin string"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_nearest_mean_equals_a_direct_computation(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, int(k), [float(np.float32(v)) for v in rng.normal(k, 1.5, 6)], "m") for i, k in enumerate(rng.integers(0, 4, 300))]
    df = table(spark, rows).repartition(5)
    out = LN.predict_labels(df, "embedding", LN.fit_centroids(df, "embedding", "label", str(tmp_path / "w")), batch_size=7)
    got = {r.vec_id: (r.predicted, r.margin) for r in out.collect()}
    x, y = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    means = np.array([x[y == k].mean(axis=0) for k in range(4)])
    far = ((x[:, None] - means) ** 2).sum(axis=2)
    order = np.sort(far, axis=1)
    for i, _ in enumerate(rows):
        assert got[i][0] == far[i].argmin()
        assert got[i][1] == pytest.approx((order[i, 1] - order[i, 0]) / 2, abs=1e-9)


def test_rows_that_cannot_be_scored(spark, tmp_path):
    rows = [(1, 7, [1.0, 0.0], "a"), (2, 3, [-1.0, 0.0], "b"), (3, None, [2.0, 1.0], "c"), (4, 3, None, "d"), (5, 3, [1.0, None], "e"),
            (6, 3, [float("nan"), 1.0], "f"), (7, 3, [float("inf"), 1.0], "g"), (8, 3, [], "h"), (9, 3, [5.0], "i"), (10, None, [0.0, 9.0], "j")]
    df = table(spark, rows)
    path = LN.fit_centroids(df, "embedding", "label", str(tmp_path / "w"))
    out = LN.predict_labels(df, "embedding", path)
    assert out.columns == ["vec_id", "label", "embedding", "predicted", "margin"]
    got = {r.vec_id: (r.predicted, r.margin) for r in out.collect()}
    assert got == {1: (7, 2.0), 2: (3, 2.0), 3: (7, 4.0), 10: (3, 0.0), **{i: (None, None) for i in range(4, 10)}}
    assert LN.predict_labels(df.limit(0), "embedding", path).count() == 0
    with pytest.raises(ValueError, match="no labelled vector"):
        LN.fit_centroids(df.limit(0), "embedding", "label", str(tmp_path / "none"))
    one = df.filter("vec_id = 1")
    alone = LN.predict_labels(one, "embedding", LN.fit_centroids(one, "embedding", "label", str(tmp_path / "one"))).first()
    assert (alone.predicted, alone.margin) == (7, None)
