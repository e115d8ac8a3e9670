"""Results kept by the fingerprints of their inputs."""

import pytest
from pyspark.sql import functions as F

from auralith.sources.metriclog import Conflict
from auralith.sources.reuse import ResultStore, cached_for, fingerprints

SCHEMA = "lang string, text string, tags array<string>"
ROWS = [("ja", "a", ["x", None]), ("ja", "b", None), ("en", "c", []), (None, "d", ["y"]), ("ja", "b", None)]


def table(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA)


def prints(df, **more):
    return {r.lang: r.fingerprint for r in fingerprints(df, ["lang"], **more).collect()}


def report(df):
    return df.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.concat_ws("", F.sort_array(F.collect_list("text"))).alias("texts"))


def held(store, version=None):
    return {r.lang: (r.n, r.texts, r.refreshed_at) for r in store.read(version).collect()}


def test_fingerprints_see_rows_not_their_order(spark):
    base = prints(table(spark))
    assert set(base) == {"ja", "en", None}
    assert prints(table(spark, ROWS[::-1]).repartition(5).select("text", "tags", "lang")) == base
    for other in (("ja", "a", [None, "x"]), ("ja", None, ["x", None]), ("ja", "a", ["x"]), ("ja", "b", None)):
        changed = prints(table(spark, [other, *ROWS[1:]]))
        assert changed["ja"] != base["ja"] and changed["en"] == base["en"] and changed[None] == base[None]
    assert prints(table(spark, ROWS[:-1]))["ja"] != base["ja"]  # a repeated row counts
    assert all(prints(table(spark), params={"beam": 2})[k] != base[k] for k in base)
    assert fingerprints(table(spark).limit(0), ["lang"]).count() == 0


def test_only_changed_keys_are_computed(spark, tmp_path):
    asked = spark.sparkContext.accumulator(0)

    def compute(df):
        return report(df.withColumn("text", counted("text")))

    @F.udf("string")
    def counted(text):
        asked.add(1)
        return text

    store = ResultStore(spark, str(tmp_path / "r"), ["lang"])
    with pytest.raises(FileNotFoundError):
        store.read()
    assert store.refresh(table(spark), compute) == 1 and asked.value == 5
    assert held(store) == {"ja": (3, "abb", 1), "en": (1, "c", 1), None: (1, "d", 1)}
    assert store.refresh(table(spark, ROWS[::-1]), compute) == 1 and asked.value == 5  # nothing to do
    later = [("ja", "a", ["x", None]), ("ja", "z", None), ("en", "c", []), ("fr", "e", [])]
    assert sorted(r.lang for r in store.stale(table(spark, later)).collect()) == ["fr", "ja"]
    assert store.refresh(table(spark, later), compute) == 2 and asked.value == 8
    assert held(store) == {"ja": (2, "az", 2), "en": (1, "c", 1), None: (1, "d", 1), "fr": (1, "e", 2)}
    assert held(store, 1) == {"ja": (3, "abb", 1), "en": (1, "c", 1), None: (1, "d", 1)}
    assert store.refresh(table(spark, later), compute, forget=True) == 3 and asked.value == 8
    assert held(store) == {"ja": (2, "az", 2), "en": (1, "c", 1), "fr": (1, "e", 2)}
    assert store.refresh(table(spark), compute) == 4  # back to rows whose results an older part still holds
    want = {"ja": (3, "abb", 4), "en": (1, "c", 1), "fr": (1, "e", 2), None: (1, "d", 4)}
    assert held(store) == want
    assert store.compact() == 5 and held(store) == want and len(store.versions.parts()) == 2
    assert store.refresh(table(spark), compute, params={"beam": 2}) == 6  # other parameters, every key of the input
    assert {k: v[2] for k, v in held(store).items()} == {"ja": 6, "en": 6, None: 6, "fr": 2}


def test_a_refresh_that_dies_or_comes_second_changes_nothing(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "r"), ["lang"])
    store.refresh(table(spark), report)
    before = held(store)
    with pytest.raises(Exception, match="half-way"):
        store.refresh(table(spark, ROWS[:2]), lambda df: report(df).withColumn("n", F.raise_error(F.lit("half-way")).cast("long")))
    assert held(store) == before and store.versions.version() == 1

    def meanwhile(df):
        ResultStore(spark, store.root, ["lang"]).refresh(table(spark, ROWS[:1]), report)
        return report(df)

    with pytest.raises(Conflict):
        store.refresh(table(spark, ROWS[:2]), meanwhile)
    assert held(store) == {**before, "ja": (1, "a", 2)}


def test_keys_without_results_and_columns_that_come_later(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "r"), ["lang"])
    assert store.refresh(table(spark), lambda df: report(df).filter("lang = 'ja'")) == 1
    assert store.refresh(table(spark), lambda df: 1 / 0) == 1  # keys without rows are not asked for again
    assert set(held(store)) == {"ja"}
    store.refresh(table(spark, [("en", "q", [])]), lambda df: report(df).withColumn("more", F.lit(7)))
    assert sorted((r.lang, r.more) for r in store.read().collect()) == [("en", 7), ("ja", None)]
    empty = ResultStore(spark, str(tmp_path / "e"), ["lang"])
    assert empty.refresh(table(spark).limit(0), report) == 1 and empty.read().count() == 0


def test_cached_for_reads_what_equal_inputs_gave(spark, tmp_path):
    root, calls = str(tmp_path / "c"), []

    def compute(df):
        calls.append(1)
        return report(df)

    first = sorted(r.texts for r in cached_for(table(spark), root, compute).collect())
    assert sorted(r.texts for r in cached_for(table(spark, ROWS[::-1]), root, compute).collect()) == first and len(calls) == 1
    cached_for(table(spark, ROWS[1:]), root, compute)
    cached_for(table(spark), root, compute, params={"beam": 2})
    assert len(calls) == 3 and cached_for(table(spark).limit(0), root, compute).count() == 0
