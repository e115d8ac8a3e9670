"""Results that are kept by what they were computed from.

``fingerprints`` gives each key an order-free fingerprint of its rows: their number and the sums of the three parts of a 64-bit
row hash, which are partial aggregates, so a key of any size needs no more than counts. ``ResultStore`` holds results
beside the fingerprints of their inputs: a refresh computes the keys alone whose rows (or whose run parameters) have
changed, writes these as one new part, and commits an index that names, for every key, the part that holds its rows.
Parts are never changed and versions are exclusive (``metriclog.Versions``), so a refresh that dies leaves the version
before, and of two at once the later one fails with ``Conflict``.

Defined cases: a null is a key like any other; rows that repeat count as often as they occur; a key for which ``compute``
returns nothing is not computed again; an empty input gives an empty result; a column order other than before is no
change, a column more or less is one.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auralith.sources.metriclog import Versions
from auralith.sources.readers import cached_or_compute

_PIECES = ((42, 22), (21, 21), (0, 21))  # (shift, bits) of a row hash: long sums of these hold 2**41 rows


def _row_hash(df: DataFrame, columns: list[str]) -> Column:
    """64 bits over the named columns in order of their names; nulls and their places count, also inside arrays and structs."""
    parts: list[Column] = []
    for field in sorted((f for f in df.schema.fields if f.name in columns), key=lambda f: f.name):
        value = F.col(f"`{field.name}`")
        parts += [F.lit(field.name), value.isNull()]
        nested = isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType))
        parts.append(F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"}) if nested else value)
    return F.xxhash64(*parts)


def _params_text(params: dict | None) -> str:
    return hashlib.sha256(json.dumps(params or {}, sort_keys=True, default=str).encode()).hexdigest()[:16]


def fingerprints(df: DataFrame, key: list[str], params: dict | None = None) -> DataFrame:
    """One row per key: its columns and ``fingerprint``, a text that any changed, added or lost row, and any other value of
    ``params``, makes another."""
    hashed = df.select(*[F.col(f"`{k}`") for k in key], _row_hash(df, df.columns).alias("__hash"))
    pieces = [F.sum(F.shiftrightunsigned("__hash", shift).bitwiseAND(F.lit((1 << bits) - 1))).alias(f"__s{i}")
              for i, (shift, bits) in enumerate(_PIECES)]
    sums = hashed.groupBy(*[F.col(f"`{k}`") for k in key]).agg(F.count(F.lit(1)).alias("__n"), *pieces)
    text = F.concat_ws(":", F.lit(_params_text(params)), "__n", *[f"__s{i}" for i in range(len(_PIECES))])
    return sums.select(*[F.col(f"`{k}`") for k in key], text.alias("fingerprint"))


def cached_for(inputs: DataFrame, root: str, compute: Callable[[DataFrame], DataFrame], params: dict | None = None) -> DataFrame:
    """S14 + K4: ``compute(inputs)``, stored under ``root`` by the fingerprint of all rows of ``inputs`` and by ``params``; equal
    inputs read the stored table, others get one of their own."""
    held = fingerprints(inputs, [], params).first()
    name = hashlib.sha256((held["fingerprint"] or "").encode()).hexdigest()[:32]
    return cached_or_compute(inputs.sparkSession, f"{root.rstrip('/')}/{name}", lambda: compute(inputs))


class ResultStore:
    """Results under ``root``, kept for each value of the ``key`` columns."""

    def __init__(self, spark: SparkSession, root: str, key: list[str]):
        self.spark, self.root, self.key = spark, root.rstrip("/"), list(key)
        self.versions = Versions(spark, self.root)

    def _index(self, parts: list[str]) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{parts[0]}")

    def _same_key(self, left: DataFrame, right: DataFrame, more: Column | None = None) -> Column:
        found = F.lit(True) if more is None else more
        for i, k in enumerate(self.key):
            found = found & left[f"`{k}`"].eqNullSafe(right[f"__k{i}"])
        return found

    def _named(self, df: DataFrame, *more: str) -> DataFrame:
        return df.select(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(self.key)], *more)

    def _rows(self, index: DataFrame, results: list[str]) -> DataFrame:
        """The rows of each key from the part that the index names, with that part and its version."""
        stored = self.spark.read.option("mergeSchema", "true").parquet(*[f"{self.root}/{p}" for p in results])
        named = self._named(index, F.col("__part").alias("__in"), F.col("__version").alias("refreshed_at"))
        return stored.join(named, self._same_key(stored, named, stored["__part"] == named["__in"])).drop("__in", *[f"__k{i}" for i in range(len(self.key))])

    def read(self, version: int | None = None) -> DataFrame:
        """The results of a version (the newest), and ``refreshed_at``: the version that computed the row's key."""
        parts = self.versions.parts(version)
        if not parts:
            raise FileNotFoundError(f"{self.root} holds no version yet")
        return self._rows(self._index(parts), parts[1:]).drop("__part")

    def stale(self, inputs: DataFrame, params: dict | None = None) -> DataFrame:
        """The keys of ``inputs`` that a refresh would compute, with their fingerprints."""
        return self._stale(fingerprints(inputs, self.key, params), self.versions.parts())

    def _stale(self, now: DataFrame, parts: list[str]) -> DataFrame:
        if not parts:
            return now
        held = self._named(self._index(parts), F.col("fingerprint").alias("__held"))
        return now.join(held, self._same_key(now, held, now["fingerprint"] == held["__held"]), "left_anti")

    def refresh(self, inputs: DataFrame, compute: Callable[[DataFrame], DataFrame], params: dict | None = None, forget: bool = False) -> int:
        """Compute the keys whose rows in ``inputs`` are not those of the newest version and commit them; returns the version
        then valid, the one before if nothing has changed. ``compute`` gets the whole rows of these keys and returns rows
        with the key columns. Keys that ``inputs`` lacks stay as they are, or go with ``forget``. ``inputs`` is read twice
        and must not change meanwhile."""
        base = self.versions.version()
        before = self.versions.parts(base)
        part, listed = f"part-{uuid.uuid4().hex}", f"index-{uuid.uuid4().hex}"
        seen = f"{self.root}/prints-{uuid.uuid4().hex}"
        fingerprints(inputs, self.key, params).write.parquet(seen)  # what is decided below is decided once
        now = self.spark.read.parquet(seen)
        todo = self._stale(now, before)
        index = todo.withColumns({"__part": F.lit(part), "__version": F.lit(base + 1).cast("long")})
        changed = bool(todo.head(1))
        if before:
            held = self._index(before)
            fresh, present = self._named(todo), self._named(now)
            kept = held.join(fresh, self._same_key(held, fresh), "left_anti")
            if forget:
                kept = kept.join(present, self._same_key(kept, present), "left_semi")
                gone = self._index(before)
                changed = changed or bool(gone.join(present, self._same_key(gone, present), "left_anti").head(1))
            index = kept.unionByName(index)
            if not changed:
                return base
        wanted = self._named(todo)
        rows = inputs.join(wanted, self._same_key(inputs, wanted), "left_semi")
        compute(rows).withColumn("__part", F.lit(part)).write.mode("errorifexists").parquet(f"{self.root}/{part}")
        index.write.mode("errorifexists").parquet(f"{self.root}/{listed}")
        return self.versions.commit([listed, *before[1:], part], base)

    def compact(self) -> int:
        """All rows of the newest version as one part, so that a read no longer passes over rows that were replaced."""
        base = self.versions.version()
        parts = self.versions.parts(base)
        if len(parts) <= 2:
            return base
        part, listed = f"part-{uuid.uuid4().hex}", f"index-{uuid.uuid4().hex}"
        index = self._index(parts)
        self._rows(index, parts[1:]).drop("refreshed_at").withColumn("__part", F.lit(part)).write.parquet(f"{self.root}/{part}")
        index.withColumn("__part", F.lit(part)).write.parquet(f"{self.root}/{listed}")
        return self.versions.commit([listed, part], base)
