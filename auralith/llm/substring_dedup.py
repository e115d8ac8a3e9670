"""Substring dedup by level-wise doubling (operator 1).

A window is ``window`` consecutive words of one document. Every word covered by a window whose word sequence also
starts earlier (smaller id, or earlier in the same document) is removed; all windows are judged on the input.

Levels double from a first length, as long as they are shorter than ``window``; the last level is ``window`` itself, so
where that is no doubling its two sub-windows overlap. At a level shorter than ``window``, each still possible
window is looked up by the smallest-hash sub-window of the level's length that it holds: equal windows hold the equal
one, so nothing repeated is lost while only about one position in eight travels (windows of 20 words, first level 5). Windows whose sub-window repeats,
and those alone, are looked up again at twice the length; once nothing repeats, nothing travels. The last level finds
the window's first start.

Per level, tasks first settle what they can see (a sub-window that repeats inside the task, a window that is not
first inside the task) and send one entry for each distinct hash, so a passage in a third of all rows costs one
entry per task. Entries travel as packed arrays, one row for each task piece and bucket. The text is shuffled once,
by document id; every level joins its verdicts to that same layout. Hashes have 64 bits; the last level compares two of
them, computed from the words' bytes with different bases, so that windows count as equal by 128 bits.

Defined cases: a null text is empty (0 words, empty text); a null id is never a copy and its text stays whole; rows
that share an id count as one document whose rows follow each other, windows never crossing rows; an empty table
gives an empty result; other columns pass through whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auralith.llm import blocks
from auralith.llm.store import shuffle_partitions

_ENTRY = "bucket int, doc long, hash binary, docs binary, at binary, second binary"
_SECOND = (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)  # odd bases of the last level's other hash: of a word, of a window
PIECE_BYTES = 2 << 20  # larger pieces settle more where they are and send fewer rows


def levels_of(window: int, first: int) -> list[int]:
    """Lengths doubled from ``first`` words (half the window, if that is less) while shorter than ``window``, then ``window``."""
    lengths = [max(1, min(first, window // 2))]
    while 2 * lengths[-1] < window:
        lengths.append(2 * lengths[-1])
    return [*lengths, window] if lengths[-1] < window else [window]


def _deltas(values: np.ndarray) -> bytes:
    return np.diff(values, prepend=0).astype(np.int64).tobytes()


def _undelta(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, np.int64))


def _survivors(words: blocks.Words, lengths: list[int], verdicts: list[list[np.ndarray]]) -> tuple[np.ndarray, ...]:
    """Starts of the windows still possible, with hash and place of their sub-window at the last of ``lengths`` that
    has no verdict yet, and the hash of the level before (that level's bucket key)."""
    window = lengths[-1]
    hashes = words.hashes()
    at, whole = words.windows(hashes, window)
    before = whole
    for level, length in enumerate(lengths):
        if length == window:
            best, place = whole, at
        else:
            sub = blocks.span_hashes(hashes, np.arange(max(0, len(hashes) - length + 1)),
                                     np.arange(max(0, len(hashes) - length + 1)) + length, 0xA0761D6478BD642F + 2 * length)
            best, place = sub[at], at.copy()
            for step in range(1, window - length + 1):
                other = sub[at + step]
                less = other < best
                best = np.where(less, other, best)
                place[less] = at[less] + step
        if level == len(verdicts):
            return at, best, place, before if level else best
        keep = np.zeros(len(at), bool)
        rows = words.row[at]
        cuts = np.searchsorted(rows, np.arange(len(words.first)))
        for row, good in enumerate(verdicts[level]):
            lo, hi = cuts[row], cuts[row + 1]
            if hi > lo and len(good):
                keep[lo:hi] = np.isin(best[lo:hi], good)
        at, whole, before = at[keep], whole[keep], best[keep]
    raise AssertionError("every level has a verdict")


def _lists(column: pa.Array, dtype) -> list[np.ndarray]:
    """Each row's packed values; null is none."""
    return [np.frombuffer(x or b"", dtype) for x in column.to_pylist()]


def _bucketed(bucket: np.ndarray, hashes: np.ndarray, docs: np.ndarray, at: np.ndarray, second: np.ndarray | None = None) -> Iterator[tuple]:
    order = np.argsort(bucket, kind="stable")
    bucket, hashes, docs, at = bucket[order], hashes[order], docs[order], at[order]
    second = None if second is None else second[order]
    ids, begins = np.unique(bucket, return_index=True)
    for b, lo, hi in zip(ids.tolist(), begins, [*begins[1:], len(bucket)]):
        yield b, None, hashes[lo:hi].tobytes(), _deltas(docs[lo:hi]), _deltas(at[lo:hi]), None if second is None else second[lo:hi].tobytes()


def _news(*keys: np.ndarray) -> np.ndarray:
    """Places of sorted rows where any of ``keys`` differs from the row before."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def _by_doc(docs: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, bytes]]:
    order = np.argsort(docs, kind="stable")
    docs, values = docs[order], values[order]
    ids, begins = np.unique(docs, return_index=True)
    for d, lo, hi in zip(ids.tolist(), begins, [*begins[1:], len(docs)]):
        yield d, values[lo:hi].tobytes()


def _frame(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


_ENTRY_ARROW = pa.schema([("bucket", pa.int32()), ("doc", pa.int64()), ("hash", pa.binary()), ("docs", pa.binary()), ("at", pa.binary()),
                          ("second", pa.binary())])
_PACKED = "part int, docs binary, counts binary, found binary"
_PACKED_ARROW = pa.schema([("part", pa.int32()), ("docs", pa.binary()), ("counts", pa.binary()), ("found", pa.binary())])
_FLAG_ARROW = pa.schema([("doc", pa.int64()), ("found", pa.binary())])


def _positions(words: blocks.Words, ids: np.ndarray, carry: tuple[int, int] | None) -> tuple[np.ndarray, tuple[int, int]]:
    """Word number inside the document for each row's first word; rows of one id follow each other (ids are sorted)."""
    count = np.diff(words.first)
    total = np.cumsum(count) - count
    new = np.ones(len(ids), bool)
    new[1:] = ids[1:] != ids[:-1]
    base = np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))
    start = total - total[base]
    if carry and len(ids) and ids[0] == carry[0]:
        start[base == 0] += carry[1]
    return start, (int(ids[-1]), int(start[-1] + count[-1])) if len(ids) else carry


def _sender(lengths: list[int], level: int, buckets: int) -> Callable:
    """Entries of one level: rows (bucket, hash, docs, at) to be settled elsewhere, or (doc, hash) settled here."""
    final = level == len(lengths) - 1

    def send(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for piece in blocks.batches(frames, "__text", PIECE_BYTES):
            ids = np.asarray(piece.column("__doc"), np.int64)
            words = blocks.scan(piece.column("__text"))
            verdicts = [_lists(piece.column(f"__v{i}"), np.uint64) for i in range(level)]
            base, carry = _positions(words, ids, carry)
            at, best, place, key = _survivors(words, lengths, verdicts)
            if not len(at):
                continue
            row = words.row[at]
            if final:
                where = base[row] + at - words.first[row]
                second = blocks.span_hashes(words.hashes(_SECOND[0]), at, at + lengths[-1], _SECOND[1])
                order = np.lexsort((second, best))  # stable: the first start of equal windows leads
                mine = np.zeros(len(best), bool)
                mine[order[_news(best[order], second[order])]] = True
                late, first, docs = np.flatnonzero(~mine), np.flatnonzero(mine), ids[row]
                flags = list(_by_doc(docs[late], where[late]))
                rows = list(_bucketed((key[first] % np.uint64(buckets)).astype(np.int32), best[first], docs[first], where[first], second[first]))
            else:
                _, only = np.unique(place, return_index=True)  # one entry for each sub-window's place
                best, docs = best[only], ids[row[only]]
                value, first, inverse, count = np.unique(best, return_index=True, return_inverse=True, return_counts=True)
                here = count[inverse] > 1
                pairs = np.unique(np.stack([docs[here].view(np.uint64), best[here]]), axis=1) if here.any() else np.zeros((2, 0), np.uint64)
                flags = list(_by_doc(pairs[0].view(np.int64), pairs[1]))
                known = (count > 1).astype(np.int64)
                order = np.sort(first)
                rows = list(_bucketed((best[order] % np.uint64(buckets)).astype(np.int32), best[order], docs[order], known[inverse[order]]))
            rows += [(int(d) % buckets, d, found, None, None, None) for d, found in flags]
            yield _frame(rows, _ENTRY_ARROW)

    return send


def _packed(docs: np.ndarray, values: np.ndarray, parts: int) -> pa.RecordBatch:
    """(doc, value) pairs as one row for each part that a document can be dealt to."""
    part = (blocks.mix(docs.view(np.uint64)) % np.uint64(parts)).astype(np.int32)
    order = np.lexsort((docs, part))
    part, docs, values = part[order], docs[order], values[order]
    ids, begins = np.unique(part, return_index=True)
    rows = []
    for p, lo, hi in zip(ids.tolist(), begins, [*begins[1:], len(part)]):
        some, counts = np.unique(docs[lo:hi], return_counts=True)
        rows.append((p, _deltas(some), counts.astype(np.int32).tobytes(), values[lo:hi].tobytes()))
    return _frame(rows, _PACKED_ARROW)


def _settler(final: bool, parts: int) -> Callable:
    """Verdicts of the entries of whole buckets: hashes that repeat or, at the last level, late starts, by document."""

    def settle(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, docs, ats, seconds, ready_docs, ready = [], [], [], [], [], []
        for frame in frames:
            for one, h, d, a, s in zip(*(frame.column(c).to_pylist() for c in ("doc", "hash", "docs", "at", "second"))):
                if one is None:
                    hashes.append(np.frombuffer(h, np.uint64))
                    docs.append(_undelta(d))
                    ats.append(_undelta(a))
                    seconds.append(np.frombuffer(s or b"", np.uint64))
                else:
                    ready.append(np.frombuffer(h, np.uint64))
                    ready_docs.append(np.full(len(ready[-1]), one, np.int64))
        if hashes:
            h, d, a = np.concatenate(hashes), np.concatenate(docs), np.concatenate(ats)
            if final:
                s = np.concatenate(seconds)
                order = np.lexsort((a, d, s, h))
                d, late = d[order], ~_news(h[order], s[order])
                value = a[order].view(np.uint64)
            else:
                order = np.argsort(h, kind="stable")
                h, d, a = h[order], d[order], a[order]
                group = np.cumsum(_news(h)) - 1
                late = ((np.bincount(group) > 1) | (np.bincount(group, weights=a) > 0))[group]
                value = h
            ready_docs.append(d[late])
            ready.append(value[late])
        if ready:
            yield _packed(np.concatenate(ready_docs), np.concatenate(ready), parts)

    return settle


def _gather(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All verdicts of a document as one row."""
    docs, found = [], []
    for frame in frames:
        for d, c, f in zip(*(frame.column(c).to_pylist() for c in ("docs", "counts", "found"))):
            docs.append(np.repeat(_undelta(d), np.frombuffer(c, np.int32)))
            found.append(np.frombuffer(f, np.uint64))
    if docs:
        rows = list(_by_doc(np.concatenate(docs), np.concatenate(found)))
        for lo in range(0, len(rows), 10_000):
            yield _frame(rows[lo: lo + 10_000], _FLAG_ARROW)


def _remover(names: list[str], text: str, window: int, schema: pa.Schema) -> Callable:
    def cut(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for piece in blocks.batches(frames, "__text", PIECE_BYTES):
            ids = np.asarray(pa.compute.fill_null(piece.column("__doc"), -1), np.int64)
            words = blocks.scan(piece.column("__text"))
            base, carry = _positions(words, ids, carry)
            late = _lists(piece.column("__late"), np.int64)
            texts = piece.column("__text").to_pylist()
            raw = words.data.tobytes()
            out = []
            for r in range(piece.num_rows):
                lo, hi = int(words.first[r]), int(words.first[r + 1])
                n = hi - lo
                starts = late[r] - base[r]
                starts = starts[(starts >= 0) & (starts + window <= n)]
                spans: list = []
                keep = np.ones(n, bool)
                if len(starts):
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, starts + window, -1)
                    keep = np.cumsum(edge[:n]) == 0
                    change = np.flatnonzero(np.diff(np.concatenate(([1], keep.astype(np.int8), [1]))))
                    spans = change.reshape(-1, 2).tolist()
                kept = b" ".join([raw[s:e] for s, e in zip(words.start[lo:hi][keep].tolist(), words.end[lo:hi][keep].tolist())])
                out.append((texts[r] if not spans else kept.decode("utf-8"), n, int(n - keep.sum()), hashlib.sha256(kept).hexdigest(), spans))
            columns = [piece.column(c) for c in names]
            columns += [pa.array([o[i] for o in out], schema.field(len(names) + i).type) for i in range(5)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return cut


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, first_level: int = 5) -> DataFrame:
    """``docs`` with the columns ``kept_text`` (the text itself if nothing is removed, else the kept words joined by one
    space), ``n_words``, ``n_removed``, ``kept_sha256`` (of the kept words joined by one space) and ``removed_spans``
    (``[first, end)`` word ranges). ``first_level``: fewest words of the shortest level."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    lengths = levels_of(window, first_level)
    parts = shuffle_partitions(spark)
    buckets = 4 * parts
    names = [f"__c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)
    doc, text = (F.col(names[docs.columns.index(c)]) for c in (id_col, text_col))
    marks = {"__doc": doc.cast("long"), "__text": text.cast("string"), "__order": F.xxhash64(text)}
    named = rows.filter(marks["__doc"].isNotNull())
    # The one shuffle of the text. Every level reads all its columns, so that Spark sees equal plans and shuffles once.
    placed = named.repartition(marks["__doc"]).withColumns(marks)
    for level, length in enumerate(lengths):
        final = length == window
        if level == 0 and not final:
            source = named.select(marks["__doc"].alias("__doc"), marks["__text"].alias("__text"))  # read where it lies
        else:
            source = placed.sortWithinPartitions("__doc", "__order")
        entries = source.mapInArrow(_sender(lengths, level, buckets), _ENTRY).repartition("bucket")
        verdicts = entries.mapInArrow(_settler(final, parts), _PACKED).repartitionById(parts, F.col("part"))
        found = verdicts.mapInArrow(_gather, "doc long, found binary")
        name = "__late" if final else f"__v{level}"
        placed = placed.join(found.withColumnsRenamed({"doc": "__found", "found": name}), F.col("__doc") == F.col("__found"), "left").drop("__found")
    extra = T.StructType([T.StructField("kept_text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
                          T.StructField("kept_sha256", T.StringType()), T.StructField("removed_spans", T.ArrayType(T.ArrayType(T.LongType())))])
    inner = T.StructType(rows.select(*names).schema.fields + extra.fields)
    ordered = placed.sortWithinPartitions("__doc", "__order").select(*names, "__doc", "__text", "__late")
    nameless = rows.filter(marks["__doc"].isNull()).withColumns(marks).select(*names, "__doc", "__text", F.lit(None).cast("binary").alias("__late"))
    out = ordered.union(nameless).mapInArrow(_remover(names, text_col, window, to_arrow_schema(inner)), inner)
    clash = [c for c in docs.columns if c not in extra.names]
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns) if c in clash], *extra.names)
