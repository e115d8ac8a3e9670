"""Structured Streaming variants: incremental shard ingest with a batch transform (R1), stream-stream join of
transcripts and audio members (R2) and an incremental metric table (R3).

Checkpoints and sinks live under the session's ``spark.checkpoint.dir`` (shared storage on a cluster). Sinks written
from ``foreachBatch`` overwrite the directory of their own epoch, so a re-run epoch after a failure replaces its
output instead of duplicating it (exactly-once at the table level).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from auralith.session import ensure_checkpoint_dir


def stream_paths(spark: SparkSession, name: str, run: str | None = None) -> tuple[str, str]:
    """Sink and checkpoint of a stream. The same ``run`` gives the same paths, so a later call resumes after the last
    committed batch and adds to the same sink; without one, every call is a run of its own."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    run = f"{base}/streams/{name}-{run or uuid.uuid4().hex[:12]}"
    return f"{run}/sink", f"{run}/checkpoint"


def file_stream(spark: SparkSession, directory: str, table: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """Parquet files of one table as a stream: a file, a directory of part files, or a pattern of either below
    ``directory`` (schema taken once from the files, never inferred per batch)."""
    path = f"{directory.rstrip('/')}/{table}"
    schema = spark.read.parquet(path).schema
    if not any(c in table for c in "*?[{"):
        path = f"{directory.rstrip('/')}/{{{table}}}"  # as a pattern, a single file is accepted like a directory
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(path)


def _epoch_writer(sink: str, transform: Callable[[DataFrame], DataFrame]):
    def write(batch: DataFrame, epoch_id: int) -> None:
        out = transform(batch)
        out.write.mode("overwrite").parquet(f"{sink}/batch_id={epoch_id}")

    return write


def run_available(query: StreamingQuery) -> int:
    """Run to the end; returns how many rows stateful operators dropped because they were older than the watermark."""
    dropped: dict[int, int] = {}
    ended = False
    while not ended:
        ended = query.awaitTermination(2)  # progress is kept for the last hundred triggers only
        for progress in query.recentProgress:
            dropped[progress["batchId"]] = sum(op["numRowsDroppedByWatermark"] for op in progress["stateOperators"])
    if query.exception() is not None:
        raise query.exception()
    return sum(dropped.values())


def incremental_apply(spark: SparkSession, stream: DataFrame, transform: Callable[[DataFrame], DataFrame],
                      name: str, run: str | None = None) -> DataFrame:
    """Process every new file once (availableNow), applying a batch transform per micro-batch; returns the sink."""
    sink, ckpt = stream_paths(spark, name, run)
    q = (stream.writeStream.foreachBatch(_epoch_writer(sink, transform)).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start())
    run_available(q)
    return spark.read.parquet(sink).drop("batch_id")


def stream_join(spark: SparkSession, left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str,
                watermark: str, tolerance: str, name: str, run: str | None = None, late: str = "fail") -> DataFrame:
    """R2: inner stream-stream join with watermarks on both sides and a time-range condition that bounds state. Rows that
    come later than the watermark allows find no state any more: they fail the run at its end (``late="drop"``: they are left
    out). Where no bound is known, ``buffered.buffered_join`` keeps rows until their group is complete."""
    lw = left.withWatermark(left_time, watermark).alias("l")
    rw = right.withWatermark(right_time, watermark).alias("r")
    cond = F.expr(
        f"l.{key} = r.{key} AND r.{right_time} BETWEEN l.{left_time} - INTERVAL {tolerance} AND l.{left_time} + INTERVAL {tolerance}")
    joined = lw.join(rw, cond, "inner").select("l.*", *[F.col(f"r.{c}") for c in right.columns if c != key])
    sink, ckpt = stream_paths(spark, name, run)
    q = (joined.writeStream.foreachBatch(_epoch_writer(sink, lambda b: b)).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start())
    dropped = run_available(q)
    if dropped and late == "fail":
        raise RuntimeError(f"{name}: {dropped} rows came later than the watermark ({watermark}) allows and were left out")
    return spark.read.parquet(sink).drop("batch_id")


def incremental_aggregate(spark: SparkSession, stream: DataFrame, keys: list[str], aggs: list, name: str,
                          run: str | None = None) -> DataFrame:
    """Running aggregate in complete mode; each trigger writes the whole table anew beside the one before, and the
    reader takes the last complete one."""
    agg = stream.groupBy(*keys).agg(*aggs)
    sink, ckpt = stream_paths(spark, name, run)
    q = (agg.writeStream.outputMode("complete").foreachBatch(_epoch_writer(sink, lambda b: b))
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    run_available(q)
    epochs = spark.read.parquet(sink)
    return epochs.filter(F.col("batch_id") == epochs.agg(F.max("batch_id")).first()[0]).drop("batch_id")
