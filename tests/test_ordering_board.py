"""Order-dependent operators: dense index, chunk/merge, dedup with NULL keys (A9/O1), trial stats."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from auralith.operators import board as B
from auralith.operators.joins import dedup_last
from auralith.operators.ordering import dense_index


def test_dense_index_matches_row_number(spark):
    df = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5003).alias("k"))
    got = dense_index(df, ["k"]).select("k", "row_idx")
    ref = df.select("k", (F.row_number().over(Window.orderBy("k")) - 1).alias("row_idx"))
    assert got.exceptAll(ref).count() == 0 and got.count() == 5000


def test_dedup_last_wins(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, pos int, v string")
    assert sorted(tuple(r) for r in dedup_last(df, "k", "pos", ["v"]).collect()) == [("a", "y"), ("b", "z")]


def test_metric_compaction_null_keys(spark):
    rows = []
    for pos, (p, s) in enumerate([(None, None), (False, None), (True, None), (None, None)]):
        rows.append(("m", "d", None, "test", 15, "ja", "transcribe", p, s, None, 1.0, 2.0, 3.0, float(pos), pos))
    schema = ("model string, dataset string, dataset_config string, dataset_split string, chunk_length_s int, language string, "
              "task string, punctuator boolean, stable_ts boolean, translation_model string, cer_raw double, wer_raw double, "
              "cer_norm double, wer_norm double, file_pos long")
    df = spark.createDataFrame(rows, schema)
    out = B.compact_metric_log(df, "ja", "transcribe").orderBy("file_pos").collect()
    assert [r.file_pos for r in out] == [0, 1, 2]  # two NULL-keyed duplicates -> the first one is kept


def test_nulls_last_order(spark):
    df = spark.createDataFrame([(1, None), (2, False), (3, True)], "pos int, flag boolean")
    first = df.agg(F.min_by("pos", B.nulls_last_key(["flag"], "pos")).alias("p")).first().p
    last = df.agg(F.max_by("pos", B.nulls_last_key(["flag"], "pos")).alias("p")).first().p
    assert (first, last) == (2, 1)  # order: false, true, NULL


def test_trial_stats_drop_warmup(spark):
    df = spark.createDataFrame([(i, "m", float(t)) for i, t in enumerate([100, 1, 2, 3])], "ts long, model string, time double")
    df = df.withColumn("event_id", F.col("ts"))
    r = B.trial_stats(df, ["model"], "time", "ts", "event_id").first()
    assert (r.n_trials, r.time_mean, r.time_std) == (3, 2.0, 1.0)


def test_dense_index_property(spark):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    @settings(max_examples=8, deadline=None)
    @given(st.integers(1, 400), st.integers(1, 9), st.integers(1, 12))
    def check(n, parts, nranges):
        df = spark.range(0, n, 1, parts).select(((F.col("id") * 7919) % 10007).alias("k"), F.col("id"))
        got = dense_index(df, ["k", "id"], partitions=nranges).select("k", "id", "row_idx")
        ref = df.select("k", "id", (F.row_number().over(Window.orderBy("k", "id")) - 1).alias("row_idx"))
        assert got.exceptAll(ref).count() == 0 and got.count() == n

    check()


def test_balance_and_spread(spark):
    from auralith.operators.ordering import balance, spread

    one = spark.range(0, 100, 1, 1)
    assert balance(one, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(0, 100, 1, spark.sparkContext.defaultParallelism * 2)
    assert balance(many, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism * 2  # left as is
    assert spread(one, "id").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
