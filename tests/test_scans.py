"""Segmented scans, exact medians and the interval sweep on groups that hold a third of all rows and more."""

import random

import pytest
from pyspark.sql import functions as F

from auralith.operators import ranks, scans, segments


def test_scans_equal_windows_over_the_group(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, 0, 0, 0, 1, 2]), i, rng.choice([None, rng.randrange(9)])) for i in range(400)]
    df = spark.createDataFrame(rows, "g long, pos long, x long").repartition(5)
    got = scans.Pieces(df, ["g"], ["pos"], partitions=9).scan(
        p=scans.previous("x"), f=scans.following("x"), s=scans.running_sum("x"), i=scans.running_sum(F.lit(1)), b=scans.last_before("x"), a=scans.first_after("x"))
    groups = {}
    for g, pos, x in rows:
        groups.setdefault(g, []).append((pos, x))
    want = []
    for g, part in groups.items():
        values = [x for _, x in part]
        for k, (pos, x) in enumerate(part):
            upto = [v for v in values[: k + 1] if v is not None]
            want.append((g, pos, x, values[k - 1] if k else None, values[k + 1] if k + 1 < len(part) else None, sum(upto) if upto else None, k + 1,
                         next((v for v in values[:k][::-1] if v is not None), None), next((v for v in values[k + 1:] if v is not None), None)))
    assert sorted(map(str, (tuple(r) for r in got.select("g", "pos", "x", "p", "f", "s", "i", "b", "a").collect()))) == sorted(map(str, want))


@pytest.mark.parametrize("hot_rows", [1, 7, 1000])
def test_medians_are_those_of_the_built_in(spark, hot_rows):
    rng = random.Random(hot_rows)
    rows = [(rng.choice([0, 0, 0, 1]), rng.choice([None, rng.random(), -rng.random() * 1e300, rng.randrange(3) * 1.0, 5e-324, 1.7e308])) for _ in range(301)]
    rows += [(2, 3.5)] * 40 + [(2, float("inf"))] * 9 + [(3, None)] * 4 + [(None, rng.gauss(0, 1)) for _ in range(50)] + [(4, v) for v in (float("nan"), float("inf"), -1.0, float("-inf"))] * 5
    df = spark.createDataFrame(rows, "g long, x double").repartition(4)
    got = ranks.medians(df, ["g"], F.col("x"), "m", hot_rows=hot_rows)
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(str(tuple(r)) for r in df.groupBy("g").agg(F.median("x").alias("m")).collect())


def intervals(seed, n, hot):
    rng = random.Random(seed)
    return [(0 if rng.random() < hot else rng.randrange(1, 9), i, t := round(rng.random() * n / 5, 1), round(t + rng.choice([0.0, 0.3, 2.0, 40.0, -1.0]) * rng.random(), 1))
            for i in range(n)]


def pairs(s, q):
    return sorted((a, i, j, max(b, d), min(c, e)) for a, i, b, c in s for g, j, d, e in q if a == g and b < e and d < c)


@pytest.mark.parametrize("cell_rows", [1, 5, 64, 4096])
def test_overlaps_of_a_recording_that_holds_most_rows(spark, cell_rows):
    s, q = intervals(2, 300, 0.7), intervals(3, 200, 0.5) + [(0, 900, 0.0, 1e6), (0, 901, 3.0, 3.0), (0, 902, 9.0, 2.0)]
    left = spark.createDataFrame([*s, (None, -1, 0.0, 9.0), (0, -2, None, 9.0)], "audio_id long, seg_id long, start double, end double")
    right = spark.createDataFrame(q, "audio_id long, sil_id long, start double, end double")
    got = sorted(map(tuple, segments.overlapping(left, right, cell_rows=cell_rows).collect()))
    assert got == pairs(s, q) and len(got) > 300


def test_no_cell_takes_more_than_its_share(spark):
    """One recording holds a third of all rows: its starts are dealt evenly, and few intervals are carried."""
    rows = [(0 if i % 3 == 0 else i, i % 2, i, float(i), i + 3.5) for i in range(6000)]
    cells = segments.swept(spark.createDataFrame(rows, "audio long, side int, id long, start double, end double"), 100)
    sizes = cells.groupBy("audio", "cell").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("native"), 1)).alias("own"))
    most, total = sizes.agg(F.max("n"), F.sum("n")).first()
    assert sizes.agg(F.max("own")).first()[0] <= 100 and most <= 110 and total <= 6000 * 1.1
    assert sizes.filter("audio = 0").count() >= 20


def test_no_window_takes_a_whole_recording(spark):
    """Windows run over pieces of range partitions; those over an audio see one summary row per partition."""
    parts = spark.range(2000).selectExpr("0L AS audio_id", "id AS pos", "if(id % 5 = 0, null, double(id)) AS start", "if(id % 7 = 0, null, id + 0.5) AS end", "1e4 AS total_dur", "'w' AS word")
    for made in (segments.next_known_time(parts), segments.regroup(parts, 10.0), segments.fill_timestamps(parts)):
        assert made.count() > 0
        plan = spark._jvm.PythonSQLUtils.explainString(made._jdf.queryExecution(), "simple")
        windows = [line for line in plan.splitlines() if "Window [" in line]
        assert all("_part" in line for line in windows), windows


def test_long_recordings_give_the_rows_of_short_partitions(spark):
    """The same parts over one and over many partitions."""
    rng = random.Random(5)
    rows = []
    for audio, n in ((0, 300), (1, 20), (2, 1)):
        t = 0.0
        for pos in range(n):
            start, end, t = t, round(t + rng.random(), 2), t + 1
            rows.append((audio, pos, None if rng.random() < 0.3 else start, None if rng.random() < 0.3 else end, 400.0))
    df = spark.createDataFrame(rows, "audio_id long, pos long, start double, end double, total_dur double")
    before, results = spark.conf.get("spark.sql.shuffle.partitions"), []
    for partitions in (1, 13):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        results.append([sorted(map(str, f(df).collect())) for f in (segments.next_known_time, segments.median_duration, lambda d: segments.fill_timestamps(d, hot_rows=8 * partitions))])
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1]
