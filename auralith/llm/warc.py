"""WARC archives as seekable Zstandard bundles (operator 7).

Records are written to bundle files of independent Zstandard frames; each frame holds as many whole records as fit
``frame_bytes``, and a bundle ends with the seekable-format footer (a skippable frame listing every frame's compressed
and decompressed size). An index maps each record id to its bundle, frame and offset inside the decompressed frame, so
one record is read with two seeks and one frame.

Records with equal payloads of at least ``least`` bytes are stored once: the one with the largest id is a ``response``,
the others are ``revisit`` records that name it. Which record that is comes from an aggregation over digests alone;
payloads are shuffled once, by id, never by digest, so a payload that a third of all rows share is no hot key.

Executors write the files straight to ``folder`` (any file system pyarrow reaches that all executors share; by default
below the session's ``spark.checkpoint.dir``), under a name of the task's own that is moved into place when complete:
a repeated task writes the same bytes to the same name.

Defined cases: a null payload is empty; a null id gets the record id ``urn:row:null``; rows that repeat id and payload
are written as they come and all rows with the largest id are responses; an empty table writes no bundle.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auralith.llm.store import scratch, shuffle_partitions, stored

SEEKABLE_MAGIC, SKIPPABLE_MAGIC = 0x8F92EAB1, 0x184D2A5E  # fixed values of the seekable format
INDEX = "page_id long, record_id string, bundle string, frame int, offset long, length long"


def _files(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def record(kind: str, rid: str, url: str, payload: bytes, digest: str, size: int, refers: str | None) -> bytes:
    """One WARC/1.1 record. ``X-Payload-Length`` keeps the full payload's length in a revisit, which stores no payload."""
    sha1 = base64.b32encode(bytes.fromhex(digest)).decode()
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{rid}>", "WARC-Date: 1970-01-01T00:00:00Z",
            f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{sha1}", f"X-Payload-Length: {size}"]
    if refers is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers}>"]
    body = b"" if refers is not None else payload
    return "\r\n".join([*head, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict, bytes, int]:
    """Headers, body and end of the record that begins at ``at``."""
    stop = data.index(b"\r\n\r\n", at)
    lines = data[at:stop].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = dict(line.split(": ", 1) for line in lines[1:])
    begin = stop + 4
    end = begin + int(head["Content-Length"])
    return head, data[begin:end], end + 4


class Bundle:
    """Writes frames to a file object; ``close`` appends the seek table."""

    def __init__(self, out, frame_bytes: int, level: int = 6):
        import zstandard

        self.out, self.frame_bytes, self.packer = out, frame_bytes, zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.sizes: list[tuple[int, int]] = []
        self.open = bytearray()

    def add(self, raw: bytes) -> tuple[int, int]:
        """Frame number and offset inside the frame."""
        if self.open and len(self.open) + len(raw) > self.frame_bytes:
            self._flush()
        place = len(self.sizes), len(self.open)
        self.open += raw
        return place

    def _flush(self) -> None:
        packed = self.packer.compress(bytes(self.open))
        self.out.write(packed)
        self.sizes.append((len(packed), len(self.open)))
        self.open = bytearray()

    def close(self) -> None:
        if self.open:
            self._flush()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)


def seek_table(source) -> list[tuple[int, int, int]]:
    """(position, compressed size, decompressed size) of each frame, read from the footer alone."""
    source.seek(0, io.SEEK_END)
    end = source.tell()
    source.seek(end - 9)
    count, _, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    source.seek(end - 9 - 8 * count)
    sizes, at, out = struct.iter_unpack("<II", source.read(8 * count)), 0, []
    for packed, full in sizes:
        out.append((at, packed, full))
        at += packed
    return out


def read_frame(source, entry: tuple[int, int, int]) -> bytes:
    import zstandard

    source.seek(entry[0])
    return zstandard.ZstdDecompressor().decompress(source.read(entry[1]), max_output_size=entry[2])


def _id(page_id: int | None) -> str:
    return f"urn:row:{'null' if page_id is None else page_id}"


def _writer(folder: str, frame_bytes: int, bundle_bytes: int) -> Callable:
    def write(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _files(folder)
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        bundle, name, number, rows, filled = None, "", 0, [], 0

        def finish() -> pa.RecordBatch:
            bundle.close()
            bundle.out.close()
            files.move(f"{root}/.{name}-{attempt}", f"{root}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(
                (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()))],
                ["page_id", "record_id", "bundle", "frame", "offset", "length"])

        for frame in frames:
            columns = [frame.column(c) for c in ("page_id", "url", "payload", "digest", "size", "refers_to")]
            for r in range(frame.num_rows):
                page, url, payload, digest, size, refers = (c[r].as_py() for c in columns)
                kind = "response" if refers is None else "revisit"
                raw = record(kind, _id(page), (url or "").replace("\r", "").replace("\n", ""), (payload or "").encode(), digest, size,
                             None if refers is None else _id(refers))
                if bundle is None:
                    name = f"bundle-{part:06d}-{number:05d}.warc.zst"
                    bundle, rows, filled = Bundle(files.open_output_stream(f"{root}/.{name}-{attempt}"), frame_bytes), [], 0
                place = bundle.add(raw)
                rows.append((page, _id(page), name, *place, len(raw)))
                filled += len(raw)
                if filled >= bundle_bytes:
                    yield finish()
                    bundle, number = None, number + 1
        if bundle is not None:
            yield finish()

    return write


def archive(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
            least: int = 1000, frame_bytes: int = 1 << 20, bundle_bytes: int = 256 << 20) -> tuple[str, DataFrame]:
    """Write the bundles; return their folder and the index (one row per record)."""
    spark = pages.sparkSession
    folder = folder or scratch(spark, "warc")
    files, root = _files(folder)
    files.create_dir(root, recursive=True)
    text = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), text.alias("payload"))
    raw = F.encode("payload", "utf-8")
    marked = rows.withColumns({"digest": F.sha1(raw), "size": F.octet_length("payload").cast("long")})
    long = rows.select("page_id", F.sha1(raw).alias("digest"), F.sha2(raw, 256).alias("key"),
                       F.octet_length("payload").cast("long").alias("size")).filter(F.col("size") >= least)
    chosen = long.groupBy("key").agg(F.max("page_id").alias("chosen"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    revisits = long.join(chosen, "key").filter("page_id < chosen").select(
        F.col("page_id").alias("page"), F.col("digest").alias("same"), F.col("chosen").alias("refers_to")).distinct()
    marked, revisits = marked.withColumn("spot", F.xxhash64("page_id", "digest")), revisits.withColumn("spot", F.xxhash64("page", "same"))
    same = (marked["spot"] == revisits["spot"]) & (F.col("page_id") == F.col("page")) & (F.col("digest") == F.col("same"))
    placed = marked.join(revisits, same, "left").select("page_id", "url", "payload", "digest", "size", "refers_to")
    placed = placed.sortWithinPartitions("page_id", "digest", "url")  # the join's own layout: no further shuffle
    return folder, stored(placed.mapInArrow(_writer(folder, frame_bytes, bundle_bytes), INDEX), "warc-index")


def _checked(head: dict, body: bytes) -> tuple[str, str]:
    """Digest (hex) and kind; a stored payload must match its digest."""
    digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if head["WARC-Type"] == "response" and hashlib.sha1(body).hexdigest() != digest:
        raise ValueError(f"payload digest of {head['WARC-Record-ID']} does not match")
    return digest, head["WARC-Type"]


def _number(urn: str) -> int | None:
    tail = urn.strip("<>").rpartition(":")[2]
    return None if tail == "null" else int(tail)


def _reader(folder: str, with_payload: bool) -> Callable:
    def read(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _files(folder)
        for frame in frames:
            for name, number in zip(frame.column("bundle").to_pylist(), frame.column("frame").to_pylist()):
                with files.open_input_file(f"{root}/{name}") as source:
                    data = read_frame(source, seek_table(source)[number])
                at, rows = 0, []
                while at < len(data):
                    head, body, at = parse(data, at)
                    digest, kind = _checked(head, body)
                    refers = head.get("WARC-Refers-To")
                    rows.append((_number(head["WARC-Record-ID"]), int(head["X-Payload-Length"]), digest, kind,
                                 None if refers is None else _number(refers), head["WARC-Target-URI"], body.decode() if with_payload else None))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(
                    (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()))],
                    ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"])

    return read


def read_archive(spark: SparkSession, folder: str, index: DataFrame, with_payload: bool = True) -> DataFrame:
    """Every record of the bundles that ``index`` names, read frame by frame (one row per frame is dealt out)."""
    frames = index.select("bundle", "frame").distinct()
    frames = frames.repartition(shuffle_partitions(spark), "bundle", "frame")
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload string"
    return frames.mapInArrow(_reader(folder, with_payload), schema)


def fetch(folder: str, entry: dict) -> tuple[dict, bytes]:
    """One record by its index row: the seek table, one frame, and the record inside it."""
    files, root = _files(folder)
    with files.open_input_file(f"{root}/{entry['bundle']}") as source:
        data = read_frame(source, seek_table(source)[entry["frame"]])
    head, body, _ = parse(data, entry["offset"])
    return head, body


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS chosen FROM p)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < chosen THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < chosen THEN chosen END AS refers_to FROM m
"""
