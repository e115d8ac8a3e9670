"""Tar shards (S2, X4, M5) as Spark 4 Python data sources: written by tasks with commit and abort, indexed by member, and read in
byte ranges.

* ``write_tar_shards``: every task streams its rows into shards of its own under temporary names. The commit renames the
  shards of the tasks that succeeded and sets ``_SUCCESS``; an abort removes them, so a failed or repeated task leaves nothing.
* ``tar_index``: one row per member with the place of its bytes, from the headers alone (512 bytes a member), one task per shard. A
  shard that cannot be read, or breaks off, gives a row without a member whose ``status`` says so, after its sound members.
* ``read_tar_members``: the indexed members' bytes. The members that begin in the same ``task_bytes`` of a shard are one
  range, so several tasks read a large shard.

``read_tar_shards_streamed`` reads a shard from end to end without an index (compressed ones too). Paths are opened with
pyarrow's file systems, so they must be in a store that pyarrow reaches from the driver and the executors. Nothing is left
out without notice: a problem fails the read, or is a row of its own where the caller asks for a report.
"""

from __future__ import annotations

import tarfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from io import BytesIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "shard STRING, member STRING, bytes BINARY, size LONG, status STRING"
INDEX = "shard STRING, member STRING, place LONG, size LONG, status STRING"
_BLOCK = 512


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path in it of a path or URI (``file:/x``, as Spark writes it, too)."""
    return fs.FileSystem.from_uri("/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path)


def _shards(directory: str) -> list[str]:
    store, root = _store(directory)
    found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    return sorted(f.path for f in found if f.is_file and f.path.endswith(".tar") and not f.base_name.startswith((".", "_")))


def _name(member: str) -> str:
    return member.lstrip("./")


class _Shard(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _TarReader(DataSourceReader):
    def __init__(self, root: str, with_bytes: bool):
        self.root, self.with_bytes = root, with_bytes

    def partitions(self) -> list[InputPartition]:
        return [_Shard(p) for p in _shards(self.root)]

    def read(self, partition: _Shard) -> Iterator[tuple]:
        path = partition.path
        try:
            with _store(self.root)[0].open_input_stream(path, compression=None) as raw, tarfile.open(fileobj=raw, mode="r|*") as tf:  # one member in memory at a time
                for m in tf:
                    if m.isfile():
                        data = tf.extractfile(m).read()
                        yield (path, _name(m.name), data if self.with_bytes else None, len(data), "ok")
        except (tarfile.TarError, EOFError, OSError, pa.ArrowException) as e:
            yield (path, None, None, 0, f"unreadable: {type(e).__name__}")


class _IndexReader(_TarReader):
    def read(self, partition: _Shard) -> Iterator[tuple]:
        path, end = partition.path, 0
        try:
            with _store(self.root)[0].open_input_file(path) as raw:
                total = raw.size()
                with tarfile.open(fileobj=raw, mode="r:") as tf:
                    for m in tf:
                        end = m.offset_data + -(-m.size // _BLOCK) * _BLOCK
                        if m.offset_data + m.size > total:
                            raise tarfile.ReadError("unexpected end of data")
                        if m.isfile():
                            yield (path, _name(m.name), m.offset_data, m.size, "ok")
                raw.seek(end)
                if raw.read(_BLOCK) != bytes(_BLOCK):  # an archive ends with blocks of zeros
                    raise tarfile.ReadError("no end mark")
        except (tarfile.TarError, EOFError, OSError, pa.ArrowException) as e:
            yield (path, None, end, 0, f"truncated: {type(e).__name__}" if end else f"unreadable: {type(e).__name__}")


@dataclass
class _Written(WriterCommitMessage):
    shards: list[tuple[str, str]] = field(default_factory=list)  # temporary and final path


class _TarWriter(DataSourceWriter):
    def __init__(self, root: str, shard_bytes: int):
        self.root, self.shard_bytes, self.job = root, shard_bytes, uuid.uuid4().hex

    def write(self, rows: Iterator) -> _Written:
        from pyspark import TaskContext

        store, root = _store(self.root)
        store.create_dir(f"{root}/_temporary/{self.job}")
        task, attempt, out = TaskContext.get().partitionId(), uuid.uuid4().hex[:12], _Written()
        tf = raw = None
        named, size = None, 0

        def close() -> None:
            if tf is not None:
                tf.close()
                raw.close()

        for row in rows:
            if tf is None or row.shard != named or (row.shard is None and size >= self.shard_bytes):
                close()
                named, size = row.shard, 0
                final = named or f"part-{task:05d}-{len(out.shards):04d}-{self.job[:8]}.tar"
                out.shards.append((f"{root}/_temporary/{self.job}/{attempt}-{len(out.shards)}", f"{root}/{final}"))
                raw = store.open_output_stream(out.shards[-1][0])
                tf = tarfile.open(fileobj=raw, mode="w|")
            data = bytes(row.bytes) if row.bytes is not None else b""
            info = tarfile.TarInfo(row.member)
            info.size = len(data)
            tf.addfile(info, BytesIO(data))
            size += len(data)
        close()
        return out

    def commit(self, messages: list[_Written | None]) -> None:
        store, root = _store(self.root)
        moves = [move for message in messages if message is not None for move in message.shards]
        finals = [final for _, final in moves]
        if len(set(finals)) < len(finals):
            self.abort(messages)
            raise ValueError("rows of one named shard came in several tasks: repartition by shard before writing")
        for temporary, final in moves:
            store.move(temporary, final)
        self._clear(store, root)
        with store.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def abort(self, messages: list[_Written | None]) -> None:
        self._clear(*_store(self.root))

    def _clear(self, store: fs.FileSystem, root: str) -> None:
        """This job's temporary files; those of other jobs stay."""
        if store.get_file_info(f"{root}/_temporary/{self.job}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/_temporary/{self.job}")


class TarShards(DataSource):
    """``spark.read.format("tarshards").option("path", dir)`` and ``df.write.format("tarshards")``."""

    @classmethod
    def name(cls) -> str:
        return "tarshards"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _TarReader(self.options["path"], self.options.get("with_bytes", "true") == "true")

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _TarWriter(self.options["path"], int(self.options.get("shard_bytes", str(1 << 30))))


class TarIndex(TarShards):
    @classmethod
    def name(cls) -> str:
        return "tarindex"

    def schema(self) -> str:
        return INDEX

    def reader(self, schema) -> DataSourceReader:
        return _IndexReader(self.options["path"], False)


def sound(rows: DataFrame, on_broken: str) -> DataFrame:
    """``rows`` with a status: all of them (``report``), or a failure at the first that is not ok (``fail``)."""
    if on_broken == "report":
        return rows
    if on_broken != "fail":
        raise ValueError(f"on_broken: fail or report, not {on_broken}")
    problem = F.raise_error(F.concat(F.lit("broken shard "), "shard", F.lit(": "), "status"))
    return rows.where(F.when(F.col("status") == "ok", True).otherwise(problem.cast("boolean")))


def write_tar_shards(rows: DataFrame, directory: str, shard_bytes: int = 1 << 30) -> None:
    """Append ``rows`` (member, bytes; optionally ``shard``, a file name for each row) to the shards in ``directory``. Unnamed rows
    fill shards of about ``shard_bytes``; named ones are dealt so that a shard's rows, sorted by member, are one task's."""
    rows.sparkSession.dataSource.register(TarShards)
    if "shard" in rows.columns:
        rows = rows.repartition("shard").sortWithinPartitions("shard", "member")
    else:
        rows = rows.withColumn("shard", F.lit(None).cast("string"))
    rows = rows.select("member", "bytes", "shard")
    rows.write.format("tarshards").option("path", directory).option("shard_bytes", str(shard_bytes)).mode("append").save()


def tar_index(spark: SparkSession, directory: str) -> DataFrame:
    """(shard, member, place, size, status): see the module's head."""
    spark.dataSource.register(TarIndex)
    return spark.read.format("tarindex").option("path", directory).load()


def _member_reader(directory: str):
    def read(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path, raw = _store(directory)[0], None, None
        for frame in frames:
            for row in frame.to_pylist():
                data = None
                if row["member"] is not None:
                    if row["shard"] != path:
                        if raw is not None:
                            raw.close()
                        path, raw = row["shard"], store.open_input_file(row["shard"])
                    raw.seek(row["place"])
                    data = raw.read(row["size"])
                yield pa.RecordBatch.from_pydict({"shard": [row["shard"]], "member": [row["member"]], "bytes": [data], "size": [row["size"]], "status": [row["status"]]},
                                                 schema=_MEMBER)
        if raw is not None:
            raw.close()

    return read


_MEMBER = pa.schema([("shard", pa.string()), ("member", pa.string()), ("bytes", pa.binary()), ("size", pa.int64()), ("status", pa.string())])


def read_tar_members(spark: SparkSession, directory: str, index: DataFrame | None = None, task_bytes: int = 128 << 20, on_broken: str = "fail") -> DataFrame:
    """Members with their bytes, as ``SCHEMA``, read by the index (which may be stored, or filtered to the members wanted)."""
    index = sound(tar_index(spark, directory) if index is None else index, on_broken)
    ranges = index.withColumn("range", F.floor(F.col("place") / task_bytes)).repartition("shard", "range").sortWithinPartitions("shard", "place")
    return ranges.drop("range").mapInArrow(_member_reader(directory), SCHEMA)


def read_tar_shards_streamed(spark: SparkSession, directory: str, with_bytes: bool = True, on_broken: str = "fail") -> DataFrame:
    spark.dataSource.register(TarShards)
    rows = spark.read.format("tarshards").option("path", directory).option("with_bytes", str(with_bytes).lower()).load()
    return sound(rows, on_broken)
