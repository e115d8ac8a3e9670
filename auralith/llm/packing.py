"""Best-fit packing of tokenised documents into fixed-length sequences (operator 3).

A document's ids (a public tokenizer's, plus one end id) are cut into pieces of ``capacity`` ids only where they are
longer. Pieces are packed by bounded-space online best fit: each task streams its pieces and keeps at
most ``open_bins`` bins open, in a bitset keyed by free space; a piece goes to the open bin with the least sufficient
space, and if there is none a new bin opens, for which the fullest open bin closes when the limit is reached. A
placement is final at once, so a task's memory is the open bins alone. Pieces are dealt to groups by a hash, about
``group_pieces`` to a group, and every group packs alone: the groups grow with the input and no task sees all pieces.
Within a group they arrive in hashed waves of about ``wave_pieces``, each from long to short.

Tokenising encodes each distinct word once per worker: this family of tokenizers drops white space and never merges
across it, so a text's ids are those of its words in turn (see ``_Encoder``).

Defined cases: a null or empty text is its end id alone; a null id is an ordinary id; repeated rows are separate
documents; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import sys
import types
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auralith.llm import blocks
from auralith.llm.store import shuffle_partitions, stored

CAPACITY = 4096
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_STOP = np.zeros(256, bool)
_STOP[[ord("."), ord(",")]] = True


class _Encoder:
    """Ids of texts through a table of the distinct units (words, with an ASCII word's trailing ``.,`` run apart) seen by
    this worker. ASCII-letter words share an entry whatever their case: the tokenizer lower-cases. The table is keyed
    by 64-bit hashes and starts anew beyond ``LIMIT`` entries, which changes nothing but time."""

    LIMIT = 3_000_000

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end_id = end_id
        self.clear()

    @classmethod
    def of(cls, path: str, end_id: int) -> _Encoder:
        """The worker process's encoder: this package travels to workers by value, so what outlives a task is kept in a
        module of its own."""
        kept = sys.modules.setdefault("_auralith_kept", types.ModuleType("_auralith_kept")).__dict__
        if ("encoder", path, end_id) not in kept:
            kept["encoder", path, end_id] = cls(path, end_id)
        return kept["encoder", path, end_id]

    def clear(self) -> None:
        self.keys, self.slots = [np.zeros(0, np.uint64)] * 2, [np.zeros(0, np.int64)] * 2  # main and recent, each sorted
        self.begin, self.size = np.zeros(1, np.int64), np.ones(1, np.int64)  # of each slot in flat; slot 0 is the end id
        self.flat = np.array([self.end_id], np.uint32)

    def _units(self, words: blocks.Words) -> tuple[np.ndarray, ...]:
        data = words.data
        place = np.arange(len(data))
        last = np.maximum.accumulate(np.where(_STOP[data], -1, place)) if len(data) else place
        core = last[words.end - 1] + 1 if len(words.end) else words.end
        core = np.where((core > words.start) & _LETTER[data[np.maximum(core, 1) - 1]], core, words.end) if len(core) else core
        tail = core < words.end
        at = np.arange(len(core)) + np.cumsum(tail) - tail
        n = len(core) + int(tail.sum())
        start, end, row = np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n, np.int64)
        start[at], end[at], row[at] = words.start, core, words.row
        start[at[tail] + 1], end[at[tail] + 1], row[at[tail] + 1] = core[tail], words.end[tail], words.row[tail]
        return start, end, row

    def _slots(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        letters = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(_LETTER[raw], out=letters[1:])
        plain = letters[end] - letters[start] == end - start
        low = blocks._LOWER[raw]
        hashes = blocks.span_hashes(blocks._BYTE[raw], start, end, 0x9E3779B97F4A7C15)
        hashes = np.where(plain, blocks.span_hashes(blocks._BYTE[low], start, end, 0x9E3779B97F4A7C15), hashes)
        keys, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        found = np.full(len(keys), -1, np.int64)
        for have, slots in zip(self.keys, self.slots):
            if len(have):
                at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
                found = np.where(have[at] == keys, slots[at], found)
        new = np.flatnonzero(found < 0)
        if len(new):
            units = [(low if plain[i] else raw)[start[i]: end[i]].tobytes().decode("utf-8") for i in first[new].tolist()]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            found[new] = len(self.size) + np.arange(len(new))
            self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.flat = np.concatenate([self.flat, np.fromiter((x for one in ids for x in one), np.uint32, int(size.sum()))])
            merge = len(self.keys[1]) > max(50_000, len(self.keys[0]) // 4)
            for into, parts in ((0, (0, 1)), (1, ())) if merge else ():
                self.keys[into] = np.concatenate([self.keys[i] for i in parts]) if parts else np.zeros(0, np.uint64)
                self.slots[into] = np.concatenate([self.slots[i] for i in parts]) if parts else np.zeros(0, np.int64)
            order_keys = np.concatenate([self.keys[1], keys[new]])
            order_slots = np.concatenate([self.slots[1], found[new]])
            order = np.argsort(order_keys, kind="stable")
            self.keys[1], self.slots[1] = order_keys[order], order_slots[order]
            if merge:
                order = np.argsort(self.keys[0], kind="stable")
                self.keys[0], self.slots[0] = self.keys[0][order], self.slots[0][order]
        return found[inverse]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in turn (little-endian unsigned 32-bit), each text's followed by the end id, and the
        position where each text's ids begin (one more entry for the end)."""
        if len(self.size) > self.LIMIT:
            self.clear()
        words = blocks.scan(texts)
        start, end, row = self._units(words)
        slots = self._slots(words.data, start, end) if len(start) else np.zeros(0, np.int64)
        units = np.bincount(row, minlength=len(texts))
        slots = np.insert(slots, np.cumsum(units), 0)  # the end id after each text's last unit
        size = self.size[slots]
        stop = np.cumsum(size)
        ids = self.flat[np.repeat(self.begin[slots] - (stop - size), size) + np.arange(int(size.sum()))].astype("<u4")
        begin = np.concatenate([[0], stop[np.cumsum(units + 1) - 1]]) if len(texts) else np.zeros(1, np.int64)
        return ids, begin


def _cutter(path: str, end_id: int, capacity: int, with_ids: bool) -> Callable:
    def cut(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in blocks.batches(frames, limit=2 << 20):  # more words alike in a piece
            ids, begin = _Encoder.of(path, end_id).encode(frame.column("text"))
            docs, pieces, starts, lengths, sums, kept = [], [], [], [], [], []
            doc_ids = frame.column("doc").to_pylist()
            for r, (lo, hi) in enumerate(zip(begin[:-1].tolist(), begin[1:].tolist())):
                for k, at in enumerate(range(lo, hi, capacity)):
                    raw = ids[at: min(hi, at + capacity)].tobytes()
                    docs.append(doc_ids[r])
                    pieces.append(k)
                    starts.append(at - lo)
                    lengths.append(len(raw) // 4)
                    sums.append(zlib.crc32(raw))
                    if with_ids:
                        kept.append(raw)
            columns = [pa.array(docs, pa.int64()), pa.array(pieces, pa.int32())] + [pa.array(x, pa.int64()) for x in (starts, lengths, sums)]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())] * with_ids,
                                             ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    return cut


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1,
           capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ``ids`` (little-endian uint32)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return rows.mapInArrow(_cutter(tokenizer, end_id, capacity, with_ids), schema)


class OpenBins:
    """A fixed number of open bins in a bitset keyed by free space."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.bits, self.count, self.made = 0, 0, 0
        self.by_space: dict[int, list[int]] = {}

    def _take(self, space: int) -> int:
        stack = self.by_space[space]
        number = stack.pop()
        if not stack:
            self.bits &= ~(1 << space)
        self.count -= 1
        return number

    def put(self, length: int) -> tuple[int, int]:
        """Bin and offset of a piece (``length`` at most ``capacity``): the tightest open bin that holds it, or a new one."""
        fitting = self.bits >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            number = self._take(space)
        else:
            if length < self.capacity and self.count >= self.limit:  # a full bin takes no place among the open ones
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            space, number = self.capacity, self.made
            self.made += 1
        left = space - length
        if left:
            self.by_space.setdefault(left, []).append(number)
            self.bits |= 1 << left
            self.count += 1
        return number, self.capacity - space


def _packer(capacity: int, open_bins: int) -> Callable:
    def pack(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, bins = None, None
        for frame in frames:
            sequence, offset = [], []
            for g, length in zip(frame.column("group").to_pylist(), frame.column("length").to_pylist()):
                if g != group:
                    group, bins = g, OpenBins(capacity, open_bins)
                number, at = bins.put(length)
                sequence.append((g << 40) + number)
                offset.append(at)
            columns = frame.columns[1:] + [pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, frame.schema.names[1:] + ["sequence_id", "offset"])

    return pack


def groups_of(pieces: int, group_pieces: int) -> int:
    return max(1, -(-pieces // group_pieces))


def dealt(keys: DataFrame, groups: int, waves: int) -> DataFrame:
    """``keys`` (rows of ``pieces`` with a unique ``row``) with their ``group``: partition g holds group g alone, in waves from
    long to short."""
    key = F.xxhash64("doc_id", "piece", "ids_crc32")
    wave = F.pmod(F.xxhash64(key), F.lit(waves))
    rows = keys.select(F.pmod(key, F.lit(groups)).cast("int").alias("group"), "*", wave.alias("wave"), key.alias("order"))
    rows = rows.repartitionById(groups, F.col("group"))  # by number: a hash would put several groups into one partition
    return rows.sortWithinPartitions("group", "wave", F.desc("length"), "order", "doc_id", "piece", "row").drop("wave", "order")


def pack(cut: DataFrame, capacity: int = CAPACITY, open_bins: int = 2048, group_pieces: int = 200_000, wave_pieces: int = 6000,
         task_bytes: int = 64 << 20) -> DataFrame:
    """``cut`` (rows of ``pieces``) with ``sequence_id`` and ``offset``. The pieces are stored once, so their number and
    their groups stay the same whatever task is lost. Only keys and lengths travel through the packing; ids, if there are
    any, are joined to their places in tasks of about ``task_bytes`` of ids."""
    from pyspark.sql import types as T

    with_ids = "ids" in cut.columns
    cut = stored(cut.withColumn("row", F.monotonically_increasing_id()), "pieces")
    count, ids = cut.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    keys = cut.drop("ids")
    schema = T.StructType(keys.schema.fields + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    placed = dealt(keys, groups_of(count, group_pieces), max(1, -(-group_pieces // wave_pieces)))
    placed = placed.mapInArrow(_packer(capacity, open_bins), schema)
    if not with_ids:
        return placed.drop("row")
    tasks = max(shuffle_partitions(cut.sparkSession), -(-4 * ids // task_bytes))
    places = placed.select("row", "sequence_id", "offset").repartition(tasks, "row")
    return cut.repartition(tasks, "row").hint("merge").join(places, "row").drop("row")
