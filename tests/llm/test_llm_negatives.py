"""Hard-negative mining against brute force, the packed tree itself, and the edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from auralith.llm import hard_negatives


def brute(rows, anchors, positives=5, negatives=5):
    rows = sorted({(i, lab, tuple(v)) for i, lab, v in rows if None not in (i, lab) and v is not None}, key=str)

    def score(a, b):
        return max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(a, b))))

    out = []
    for i, lab, v in rows:
        if i not in anchors:
            continue
        others = [(-score(v, w), j, one) for j, one, w in rows if j != i and len(w) == len(v)]
        for s, j, _ in sorted(x for x in others if x[2] == lab)[:positives]:
            inside = sorted((t, n) for t, n, one in others if one != lab and 80 * -s <= 100 * -t <= 100 * -s)
            out += [(i, j, r, n, -s, -t) for r, (t, n) in enumerate(inside[:negatives], 1)]
    return sorted(out)


def mined(spark, rows, anchors, **options):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "id long, label long, v array<long>, tile int, h int").repartition(3)
    return sorted(map(tuple, hard_negatives.mine(df, F.col("id").isin(list(anchors)), **options).collect()))


def random_rows(seed, n, dims, spread, labels=4):
    rng = np.random.default_rng(seed)
    centre = rng.integers(-spread, spread + 1, (6, dims))
    v = centre[rng.integers(0, 6, n)] + rng.integers(-3, 4, (n, dims))
    return [(int(i), int(rng.integers(labels)), x.tolist()) for i, x in enumerate(v)]


@pytest.mark.parametrize("options", [{}, {"tile_rows": 40, "leaf": 3, "fan": 2}, {"positives": 2, "negatives": 1, "tile_rows": 90}])
def test_equals_brute_force(spark, options):
    rows = random_rows(3, 400, 6, 9)
    anchors = set(range(0, 400, 25))
    counts = {k: v for k, v in options.items() if k in ("positives", "negatives")}
    got = mined(spark, rows, anchors, **options)
    assert got == brute(rows, anchors, **counts) and got


def test_copies_ties_nulls_and_unequal_lengths(spark):
    rows = [(i, i % 3, [5, 5]) for i in range(120)] + [(i, i % 2, [4, 5, 1]) for i in range(200, 212)] + [(200, 0, [4, 5, 1])] * 30
    rows += [(300, None, [5, 5]), (None, 1, [5, 5]), (301, 1, None), (302, 1, []), (303, 2, []), (304, 1, []), (400, 1, [0, 0]), (401, 1, [-9, -9])]
    anchors = {0, 7, 200, 203, 300, 302, 400, 401}
    got = mined(spark, rows, anchors, tile_rows=16, leaf=4, fan=2)
    assert got == brute(rows, anchors)


def test_scores_beyond_double_precision_and_64_bits(spark):
    big = 1 << 40
    rows = [(i, i % 2, [big + i, big - 3 * i]) for i in range(30)]
    rows += [(100 + i, i % 2, [(1 << 28) + i, (1 << 27) - 3 * i, 2 - i]) for i in range(40)]
    anchors = {0, 5, 100, 107}
    assert mined(spark, rows, anchors, tile_rows=20, leaf=4) == brute(rows, anchors)


def test_empty_tables_and_no_anchor(spark):
    assert mined(spark, [], {1}) == []
    assert mined(spark, random_rows(1, 20, 3, 5), {999}) == []
    assert mined(spark, [(1, 1, [1, 2])], {1}) == []


def test_tree_holds_every_row_in_its_boxes():
    rng = np.random.default_rng(4)
    x, ids = rng.integers(-50, 50, (777, 5)), rng.permutation(777)
    tree = hard_negatives.Tree(x, ids, leaf=10, fan=4)
    assert sorted(map(tuple, np.c_[tree.x, tree.ids])) == sorted(map(tuple, np.c_[x, ids]))
    lows, highs, begin, end = tree.levels[0]
    assert max(end - begin) <= 10 and begin[0] == 0 and end[-1] == 777 and (begin[1:] == end[:-1]).all()
    for a, b, lo, hi in zip(begin, end, lows, highs):
        assert (tree.x[a:b].min(axis=0) == lo).all() and (tree.x[a:b].max(axis=0) == hi).all()
    for below, level in zip(tree.levels, tree.levels[1:]):
        for lo, hi, a, b in zip(*level):
            assert b - a <= 4 and (below[0][a:b].min(axis=0) == lo).all() and (below[1][a:b].max(axis=0) == hi).all()
    assert len(tree.levels[-1][0]) <= 4


def test_best_first_search_prunes_and_is_exact():
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.integers(-4, 5, (300, 3)) + c for c in ([90, 0, 0], [0, 90, 0], [0, 0, 90], [-90, 5, 5])])
    tree = hard_negatives.Tree(x, np.arange(len(x)), leaf=8, fan=4)
    q = np.array([3, 1, 0])
    query = hard_negatives.Query(q, -1, 4, [(-np.inf, np.inf), (60, 100)], [None, None], 100.0)
    query.search([tree])
    order = sorted((-int(s), i) for i, s in enumerate(x @ q))
    assert query.best[0] == order[:4]
    assert query.best[1] == [o for o in order if 60 <= -o[0] <= 100][:4]
    assert query.opened < len(tree.levels[0][0]) // 2
