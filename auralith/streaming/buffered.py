"""Buffered two-sided joins of a stream by group (J3, J4, R2): rows of both sides are kept in state until their group is
complete, however far apart their files arrive, and nothing is dropped without a row that says so.

A group is complete when the sets of keys on its two sides are equal and, where rows carry an ``expected`` number of keys, of
that size; then all pairs of equal keys are emitted and its buffers cleared. Without ``expected`` a group may fill again later.
A group that is not complete ``patience`` seconds (processing time) after it began to fill expires with the next trigger: its rows are emitted one by one. Rows
that come to an expired group, or to one that was complete at its expected size, are emitted as late. Whatever still waits when
a run ends stays in the state for the next run and can be read with ``pending``.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from auralith.streaming.ingest import run_available, stream_paths

SCHEMA = "group string, status string, key string, left string, right string"
_ITEM = "key string, payload string"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Buffer(StatefulProcessor):
    """One group's buffers."""

    def __init__(self, patience: float | None):
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sides = {side: handle.getListState(side, _ITEM) for side in ("left", "right")}
        self.facts = handle.getValueState("facts", "left long, right long, expected long, closed string, deadline long")

    def _facts(self) -> list:
        return list(self.facts.get()) if self.facts.exists() else [0, 0, None, None, None]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        left, right, expected, closed, deadline = self._facts()
        began = left + right == 0
        fresh: dict[str, list[tuple[str, str]]] = {"left": [], "right": []}
        for row in rows:
            expected = row.expected if row.expected is not None else expected
            fresh[row.side].append((row.key, row.payload))
        if closed:
            yield from self._single(key, "late", fresh)
            return
        for side, items in fresh.items():
            if items:
                self.sides[side].appendList(items)
        left, right = left + len(fresh["left"]), right + len(fresh["right"])
        if left and right and (expected is None or min(left, right) >= expected):
            held = self._held()
            keys = [{k for k, _ in held[side]} for side in ("left", "right")]
            if keys[0] == keys[1] and (expected is None or len(keys[0]) == expected):
                by_key: dict[str, list[str]] = {}
                for k, payload in held["right"]:
                    by_key.setdefault(k, []).append(payload)
                self._clear()
                if expected is not None:
                    self.facts.update((0, 0, expected, "complete", None))
                for k, payload in held["left"]:
                    for other in by_key[k]:
                        yield Row(group=key[0], status="joined", key=k, left=payload, right=other)
                return
        if began and self.patience is not None:
            deadline = timerValues.getCurrentProcessingTimeInMs() + int(1000 * self.patience)
            self.handle.registerTimer(deadline)
        self.facts.update((left, right, expected, None, deadline))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        _, _, expected, closed, deadline = self._facts()
        held = self._held()
        if not closed and deadline == expiredTimerInfo.getExpiryTimeInMs() and (held["left"] or held["right"]):  # not an earlier filling's timer
            self._clear()
            self.facts.update((0, 0, expected, "expired", None))
            yield from self._single(key, "expired", held)

    def _held(self) -> dict[str, list[tuple[str, str]]]:
        return {side: [(r[0], r[1]) for r in state.get()] if state.exists() else [] for side, state in self.sides.items()}

    def _clear(self) -> None:
        for state in self.sides.values():
            state.clear()
        self.facts.clear()

    @staticmethod
    def _single(key, status: str, items: dict[str, list[tuple[str, str]]]) -> Iterator[Row]:
        for side, rows in items.items():
            for k, payload in rows:
                yield Row(group=key[0], status=status, key=k, left=payload if side == "left" else None, right=payload if side == "right" else None)

    def close(self) -> None:
        pass


@contextlib.contextmanager
def _state_store(spark: SparkSession):
    """RocksDB state, which list state and timers need, and no triggers without data (with timers on processing time they
    would never end), for queries started inside; the session's settings come back."""
    wanted = {_PROVIDER: _ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def side(stream: DataFrame, name: str, group: Column, key: Column, payload: list[str], expected: Column | None = None) -> DataFrame:
    """A side's rows (``name`` is left or right) in the form that ``buffered_join`` takes; ``payload``: the columns to carry."""
    return stream.select(group.cast("string").alias("group"), F.lit(name).alias("side"), key.cast("string").alias("key"),
                         F.to_json(F.struct(*payload), {"ignoreNullFields": "false"}).alias("payload"),
                         (F.lit(None) if expected is None else expected).cast("long").alias("expected"))


def buffered_join(spark: SparkSession, left: DataFrame, right: DataFrame, name: str, run: str | None = None, patience: float | None = None) -> tuple[DataFrame, str]:
    """Process every new file of two ``side`` streams; returns the sink (``SCHEMA``; left and right as JSON) and the checkpoint's path.
    A null group or key is an ordinary value."""
    sink, checkpoint = stream_paths(spark, name, run)
    rows = left.unionByName(right)
    rows = rows.withColumn("group", F.to_json(F.struct("group"))).withColumn("key", F.to_json(F.struct("key")))  # a null is a value
    joined = rows.groupBy("group").transformWithState(
        statefulProcessor=Buffer(patience), outputStructType=SCHEMA, outputMode="Append", timeMode="None" if patience is None else "ProcessingTime")

    def write(batch: DataFrame, epoch_id: int) -> None:
        batch.select(*(F.get_json_object(c, f"$.{c}").alias(c) if c in ("group", "key") else F.col(c) for c in batch.columns)).write.mode(
            "overwrite").parquet(f"{sink}/batch_id={epoch_id}")

    with _state_store(spark):
        query = joined.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        run_available(query)
    return spark.read.schema(f"{SCHEMA}, batch_id long").parquet(sink).drop("batch_id"), checkpoint


def pending(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The rows that still wait in the state of a finished run, in the sink's form with status ``pending``."""
    def waiting(name: str) -> DataFrame:
        held = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load()
        mine, other = (F.col("list_element.payload").alias(name), F.lit(None).cast("string").alias("right" if name == "left" else "left"))
        return held.select(F.get_json_object("key.group", "$.group").alias("group"), F.lit("pending").alias("status"),
                           F.get_json_object("list_element.key", "$.key").alias("key"), mine, other)

    with _state_store(spark):
        return waiting("left").unionByName(waiting("right")).select("group", "status", "key", "left", "right")
