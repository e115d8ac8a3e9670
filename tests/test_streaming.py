"""Streaming (R1-R3): several files -> several micro-batches; the result equals the batch computation."""

import uuid

from pyspark.sql import functions as F

from auralith.streaming import ingest as R
from conftest import SF_SMALL


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    src = str(tmp_path / "src")
    events.repartition(3, "event_id").write.parquet(src)  # three files -> three micro-batches
    stream = R.file_stream(spark, src, "*.parquet", max_files_per_trigger=1)
    out = R.incremental_apply(spark, stream, lambda b: b.where(F.col("value") > 10), "t_ingest")
    assert out.count() == events.where(F.col("value") > 10).count()
    agg = R.incremental_aggregate(spark, R.file_stream(spark, src, "*.parquet"), ["event_type"],
                                  [F.count(F.lit(1)).alias("n")], "t_agg")
    batch = {r.event_type: r.n for r in events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert {r.event_type: r.n for r in agg.collect()} == batch


def test_stream_join_matches_inner_join(spark):
    arrival = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id"))
    docs = R.file_stream(spark, SF_SMALL, "documents.parquet").select("doc_id", "lang", arrival.alias("d_time"))
    labs = R.file_stream(spark, SF_SMALL, "labels.parquet").select("doc_id", "quality", arrival.alias("l_time"))
    j = R.stream_join(spark, docs, labs, "doc_id", "d_time", "l_time", "10 minutes", "1 minute", "t_join")
    batch = spark.read.parquet(f"{SF_SMALL}/documents.parquet").join(spark.read.parquet(f"{SF_SMALL}/labels.parquet"), "doc_id")
    assert j.count() == batch.count()


def test_epoch_writer_is_idempotent(spark, tmp_path):
    """Replaying an epoch (a retry after a failure before commit) replaces its output instead of duplicating it."""
    sink = str(tmp_path / "sink")
    write = R._epoch_writer(sink, lambda b: b)
    batch = spark.range(10)
    write(batch, 0)
    write(spark.range(5), 1)
    write(batch, 0)  # replay of epoch 0
    out = spark.read.parquet(sink)
    assert out.count() == 15 and out.where("batch_id = 0").count() == 10


def split_tables(spark, folder, tables, files=5):
    for t in tables:
        spark.read.parquet(f"{SF_SMALL}/{t}.parquet").repartition(files).write.parquet(f"{folder}/{t}.parquet")


def test_queries_stream_tables_of_many_files(spark, tmp_path):
    import __spark_entry__ as entry

    split_tables(spark, tmp_path, ["documents", "labels", "events"])
    for name in ("incremental_ingest", "stream_join", "stream_metrics"):
        whole = entry.queries()[name](spark, SF_SMALL).collect()
        assert sorted(map(str, entry.queries()[name](spark, str(tmp_path)).collect())) == sorted(map(str, whole)), name


def test_stream_resumes_after_the_last_batch(spark, tmp_path):
    src, run = f"{tmp_path}/in/t.parquet", uuid.uuid4().hex
    spark.range(0, 10).coalesce(1).write.parquet(src)
    ingest = lambda: R.incremental_apply(spark, R.file_stream(spark, f"{tmp_path}/in", "t.parquet"), lambda b: b, "resume", run=run)
    assert ingest().count() == 10
    spark.range(10, 25).coalesce(1).write.mode("append").parquet(src)
    assert sorted(r.id for r in ingest().collect()) == list(range(25))  # the first file is not read again
    assert ingest().count() == 25
    agg = lambda: R.incremental_aggregate(spark, R.file_stream(spark, f"{tmp_path}/in", "t.parquet"), [], [F.count(F.lit(1)).alias("n")], "resume_agg", run=run)
    assert agg().first().n == 25
    spark.range(25, 30).coalesce(1).write.mode("append").parquet(src)
    assert agg().first().n == 30


def _files(spark, path, rows, schema):
    """One file per element, in order of arrival."""
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return R.file_stream(spark, path, "*.parquet", 1)


def _sides(spark, tmp_path, left, right, expected=True):
    from auralith.streaming import buffered as B

    schema, out = "g string, k long, n long, v string", []
    for name, files in (("left", left), ("right", right)):
        stream = _files(spark, str(tmp_path / name), files, schema)
        out.append(B.side(stream, name, F.col("g"), F.col("k"), ["v"], F.col("n") if expected else None))
    return out


def test_buffered_join_waits_for_both_sides_out_of_order(spark, tmp_path):
    from auralith.streaming import buffered as B

    left = [[("a", 1, 2, "l1"), ("b", 1, 1, "l2"), (None, 1, 1, "l0")], [("a", 2, 2, "l3"), ("c", 1, 2, "l4")]]
    right = [[("a", 2, 2, "r1"), ("c", 1, 2, "r2")], [("a", 1, 2, "r3"), ("b", 1, 1, "r4"), (None, 1, 1, "r0"), ("d", 5, 1, "r5")]]
    provider = spark.conf.get(B._PROVIDER, None)
    sink, checkpoint = B.buffered_join(spark, *_sides(spark, tmp_path, left, right), "t_buffer", uuid.uuid4().hex)
    assert spark.conf.get(B._PROVIDER, None) == provider  # the session's own setting is back
    got = sorted((str(r.group), r.status, r.key, r.left, r.right) for r in sink.collect())
    assert got == [("None", "joined", "1", '{"v":"l0"}', '{"v":"r0"}'), ("a", "joined", "1", '{"v":"l1"}', '{"v":"r3"}'),
                   ("a", "joined", "2", '{"v":"l3"}', '{"v":"r1"}'), ("b", "joined", "1", '{"v":"l2"}', '{"v":"r4"}')]
    wait = sorted((r.group, r.status, r.key, str(r.left), str(r.right)) for r in B.pending(spark, checkpoint).collect())
    assert wait == [("c", "pending", "1", "None", '{"v":"r2"}'), ("c", "pending", "1", '{"v":"l4"}', "None"), ("d", "pending", "5", "None", '{"v":"r5"}')]


def test_buffered_join_reports_expired_and_late_rows(spark, tmp_path):
    from auralith.streaming import buffered as B

    run, schema = uuid.uuid4().hex, "g string, k long, n long, v string"

    def go(left, right):
        sides = []
        for name, rows in (("left", left), ("right", right)):
            path = str(tmp_path / name)
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
            sides.append(B.side(R.file_stream(spark, path, "*.parquet"), name, F.col("g"), F.col("k"), ["v"], F.col("n")))
        return B.buffered_join(spark, *sides, "t_late", run, patience=0.0)[0]

    go([("a", 1, 1, "l1"), ("b", 1, 2, "l2")], [("a", 1, 1, "r1")])
    go([("c", 1, 1, "l3")], [("c", 1, 1, "r3")])  # the timer of b has run out
    sink = go([("b", 2, 2, "l4"), ("a", 7, 1, "l5")], [("b", 1, 2, "r4")])
    got = sorted((r.group, r.status, r.key, str(r.left), str(r.right)) for r in sink.collect())
    assert got == [("a", "joined", "1", '{"v":"l1"}', '{"v":"r1"}'), ("a", "late", "7", '{"v":"l5"}', "None"), ("b", "expired", "1", '{"v":"l2"}', "None"),
                   ("b", "late", "1", "None", '{"v":"r4"}'), ("b", "late", "2", '{"v":"l4"}', "None"), ("c", "joined", "1", '{"v":"l3"}', '{"v":"r3"}')]


def test_stream_join_does_not_lose_late_rows_silently(spark, tmp_path):
    import pytest

    at = F.timestamp_seconds(F.col("id"))

    def sides():
        return [R.file_stream(spark, str(tmp_path / n), "*.parquet", 1).select("id", at.alias(f"{n}_time")) for n in "lr"]

    for n in "lr":
        for ids in ((100, 110), (10_000, 10_010), (20_000, 20_010), (120, 130)):
            spark.range(*ids).coalesce(1).write.mode("append").parquet(str(tmp_path / n))
    with pytest.raises(RuntimeError, match="later than the watermark"):
        R.stream_join(spark, *sides(), "id", "l_time", "r_time", "10 minutes", "1 minute", "t_late_join")
    assert R.stream_join(spark, *sides(), "id", "l_time", "r_time", "10 minutes", "1 minute", "t_late_join", late="drop").count() == 30
