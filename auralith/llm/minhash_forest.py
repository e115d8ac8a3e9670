"""MinHash near-dedup with an LSH forest (operator 8).

A document's set holds its distinct ``width``-word shingles (of A-Z-lowered words; fewer words: the whole sequence as
one). Equal sets are collapsed to their smallest document id first. Every remaining set gets ``TREES * DEPTH`` min-hashes;
tree t sorts the documents by its own ``DEPTH`` values in turn. Documents that share a tree's first ``ROOT`` values form a
region. The orders are range partitioned over the tasks, so a region of any size is no hot key.

Round 1 goes as deep into each region as it must: a region of more than ``CROWD`` documents is parted by the next value
until its parts are small (or its values end). In each part the longest common neighbours are linked to a spanning
forest by estimated similarity. A pair that survives the estimate is confirmed on the full sets. Round 2 takes the
components of round 1 and, in every whole region that holds more than one, compares the sets of all pairs that lie in
different components, so that nothing round 1 passed over (deep parting, forests, cuts between tasks) is lost. A region of
more than ``BLOCK`` rows (a long text counts as several) is dealt into blocks of about that many, large components into blocks of their own, and every two
blocks meet in one task group unless both hold the same single component; a group returns the links it finds, never the
pairs it looks at, and they are confirmed like the others. Estimates cut a pair only ``CUT`` standard
deviations below the threshold. At similarity 0.85 two documents share a region of one of the 16 trees with probability over
0.99999, at 0.8 over 0.9997.

Texts are shuffled once and only for documents that share a region; sets are rebuilt from them where a pair is confirmed.

Defined cases: a null or blank text has an empty set and links with nothing; a null id is its own component (null);
rows that share an id are linked like any others and share the id's component; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auralith.llm import blocks
from auralith.llm.columns import Carried
from auralith.llm.graphs import components
from auralith.llm.store import shuffle_partitions, stored

TREES, DEPTH, ROOT, CROWD, CUT, PIECE, BLOCK, HEAVY = 16, 8, 4, 64, 4.5, 20_000, 2048, 2000
_HASHES = TREES * DEPTH
_draw = np.random.default_rng(811)
_MUL = _draw.integers(1, 1 << 63, _HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _draw.integers(0, 1 << 63, _HASHES, dtype=np.uint64)


def shingle_sets(texts: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted (one array, text by text), and where each text's begin."""
    words = blocks.scan(texts, lower=True)
    hashes = words.hashes()
    at, value = words.windows(hashes, width)
    count = np.diff(words.first)
    short = np.flatnonzero((count > 0) & (count < width))
    whole = blocks.span_hashes(hashes, words.first[short], words.first[short + 1], 0xD6E8FEB86659FD93)
    row, value = np.concatenate([words.row[at], short]), np.concatenate([value, whole])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    begin = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.bincount(row[new], minlength=len(texts)), out=begin[1:])
    return value[new], begin


def signatures(sets: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """(texts, TREES * DEPTH) min-hashes; rows of empty sets are undefined."""
    full = np.flatnonzero(np.diff(begin))
    out = np.zeros((len(begin) - 1, _HASHES), np.uint32)
    if len(full):
        at = begin[full]
        for k in range(_HASHES):
            out[full, k] = np.minimum.reduceat(((sets * _MUL[k] + _ADD[k]) >> np.uint64(32)).astype(np.uint32), at)
    return out


def _signer(width: int) -> Callable:
    def sign(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in blocks.batches(frames):
            sets, begin = shingle_sets(frame.column("text"), width)
            values = signatures(sets, begin)
            trees = values.reshape(len(values), TREES, DEPTH)[:, :, :ROOT].astype(np.uint64)
            keys = np.full(trees.shape[:2], 0x51ED270B, np.uint64) + np.arange(TREES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            for k in range(ROOT):
                keys = blocks.mix(keys ^ trees[:, :, k])
            low = values.astype(np.uint8)
            digests = [hashlib.blake2b(sets[lo:hi].tobytes(), digest_size=16).digest() for lo, hi in zip(begin[:-1], begin[1:])]
            flat = pa.array(keys.view(np.int64).ravel())
            yield pa.RecordBatch.from_arrays([
                frame.column("doc"), pa.array(np.diff(begin)), pa.array(digests, pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * TREES), flat),
                pa.array([x.tobytes() for x in low], pa.binary())], ["doc", "n", "digest", "keys", "low"])

    return sign


def _similar(low: np.ndarray, n: np.ndarray, i: int, others: np.ndarray, percent: int) -> np.ndarray:
    """Estimated similarity of i to others; -1 where the sizes alone rule the pair out."""
    match = (low[others] == low[i]).mean(axis=1)
    sized = 100 * np.minimum(n[others], n[i]) >= percent * np.maximum(n[others], n[i])
    return np.where(sized, (match - 1 / 256) / (1 - 1 / 256), -1.0)


def least_estimate(percent: int) -> float:
    p = percent / 100
    return p - CUT * np.sqrt(p * (1 - p) / _HASHES)


def _parts(rest: np.ndarray, lo: int, hi: int, depth: int = 0) -> Iterator[tuple[int, int]]:
    """Runs of the sorted rows lo..hi that share as many further values as it takes to be small."""
    if hi - lo <= CROWD or depth == rest.shape[1]:
        for at in range(lo, hi, CROWD):
            yield max(lo, at - 1), min(hi, at + CROWD)  # neighbouring runs share a document
        return
    edges = lo + 1 + np.flatnonzero(rest[lo + 1: hi, depth] != rest[lo: hi - 1, depth])
    for a, b in zip([lo, *edges.tolist()], [*edges.tolist(), hi]):
        yield from _parts(rest, a, b, depth + 1)


def _forest(rep: np.ndarray, low: np.ndarray, n: np.ndarray, rest: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    cut = least_estimate(percent)
    for lo, hi in _parts(rest, 0, len(rep)):
        if hi - lo < 2:
            continue
        rows, best, to = np.arange(lo + 1, hi), np.full(hi - lo - 1, -2.0), np.full(hi - lo - 1, lo)
        at = lo
        while len(rows):  # Prim's algorithm on the estimates
            near = _similar(low, n, at, rows, percent)
            to, best = np.where(near > best, at, to), np.maximum(best, near)
            k = int(best.argmax())
            at = int(rows[k])
            if best[k] >= cut:
                yield int(rep[at]), int(rep[to[k]])
            rows, best, to = np.delete(rows, k), np.delete(best, k), np.delete(to, k)


def _crossing(rep: np.ndarray, low: np.ndarray, n: np.ndarray, group: np.ndarray, block: np.ndarray, sets: list[np.ndarray],
              percent: int) -> Iterator[tuple[int, int]]:
    """Links between different components (and, where the rows are of two blocks, between these), found by comparing the full
    sets of every pair that the estimate leaves possible; pairs that a link found here has already joined are passed over."""
    within = bool((block == block[0]).all())
    groups, group, size = np.unique(group, return_inverse=True, return_counts=True)
    cut, into = least_estimate(percent), np.arange(len(groups))
    rank = np.empty(len(groups), np.int64)
    rank[np.lexsort((np.arange(len(groups)), size))] = np.arange(len(groups))  # the largest component is never the asking side
    flat, begin = np.concatenate(sets), np.cumsum([0, *map(len, sets)])
    for i in np.flatnonzero(rank[group] < len(groups) - 1).tolist():
        others = np.flatnonzero((rank[group] > rank[group[i]]) & (into[group] != into[group[i]]) & (within | (block != block[i])))
        others = others[_similar(low, n, i, others, percent) >= cut]
        if not len(others):
            continue
        length = begin[others + 1] - begin[others]
        stop = np.cumsum(length)
        value = flat[np.repeat(begin[others] - (stop - length), length) + np.arange(stop[-1])]
        at = np.minimum(np.searchsorted(sets[i], value), len(sets[i]) - 1)
        both = np.add.reduceat((sets[i][at] == value).astype(np.int64), stop - length)
        for j in others[100 * both >= percent * (length + len(sets[i]) - both)].tolist():
            if into[group[i]] != into[group[j]]:
                into[into == into[group[j]]] = into[group[i]]
                yield int(rep[i]), int(rep[j])


def _packer(width: int) -> Callable:
    def pack(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in blocks.batches(frames):
            sets, begin = shingle_sets(piece.column("text"), width)
            packed = [sets[a:b].tobytes() for a, b in zip(begin[:-1], begin[1:])]  # whole hashes: the comparison decides
            yield pa.RecordBatch.from_arrays([piece.column("doc"), pa.array(packed, pa.binary())], ["rep", "packed"])

    return pack


def _walker(percent: int, crossing: bool) -> Callable:
    """Pairs of sorted rows. Round 1: (key, rest, rep, n, low), a region is a run of one key. Round 2, ``crossing``: (key, lo, hi,
    block, rep, n, low, component, packed), a run of one (key, lo, hi) is two blocks of a region (or one) and is never cut."""
    names = ("key", "lo", "hi") if crossing else ("key",)

    def differs(table: pa.Table, last: bool = False) -> np.ndarray:
        """Where a row's run is not that of the row before it (of the last row, if asked for)."""
        columns = [np.asarray(table.column(c), np.int64) for c in names]
        return np.any([c != c[-1] if last else c[1:] != c[:-1] for c in columns], axis=0)

    def pairs_of(rows: pa.Table) -> list[tuple[int, int]]:
        rep, n = (np.asarray(rows.column(c), np.int64) for c in ("rep", "n"))
        low = np.frombuffer(b"".join(rows.column("low").to_pylist()), np.uint8).reshape(len(rep), _HASHES)
        if crossing:
            sets = [np.frombuffer(x, np.uint64) for x in rows.column("packed").to_pylist()]
            return list(_crossing(rep, low, n, *(np.asarray(rows.column(c), np.int64) for c in ("component", "block")), sets, percent))
        rest = np.frombuffer(b"".join(rows.column("rest").to_pylist()), np.uint8).reshape(len(rep), DEPTH - ROOT)
        return list(_forest(rep, low, n, rest, percent))

    def walk(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
            edges = [0, *(1 + np.flatnonzero(differs(table))).tolist(), table.num_rows]
            found = [p for a, b in zip(edges[:-1], edges[1:]) if b - a > 1 for p in pairs_of(table.slice(a, b - a))]
            a = np.array([min(p) for p in found], np.int64)
            b = np.array([max(p) for p in found], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        held: pa.Table | None = None
        for frame in frames:
            held = pa.Table.from_batches([frame]) if held is None else pa.concat_tables([held, pa.Table.from_batches([frame])])
            if not held.num_rows:
                continue
            same = np.flatnonzero(differs(held, last=True))
            last = int(same[-1]) + 1 if len(same) else 0  # the last region may go on
            if not crossing and held.num_rows - last > PIECE:
                last = held.num_rows  # round 2 sees the region whole
            if last:
                yield from out(held.slice(0, last))
                held = held.slice(last)
        if held is not None and held.num_rows:
            yield from out(held)

    return walk


def _weight() -> Column:
    return F.sum(1 + F.col("n") / F.lit(float(HEAVY)))


def _dealt(rows: DataFrame) -> DataFrame:
    """``rows`` (key, size of the region, rep, n, component, ...) with the task groups (key, lo, hi) each goes to, and its
    ``block``. Sizes are weights: a row counts one, and one more for every ``HEAVY`` shingles, so that a block is bounded in bytes.
    Components of ``BLOCK`` or more have blocks of their own (``own``); all others of a region share blocks."""
    one = F.lit(0).cast("long")
    whole = rows.filter(F.col("size") <= BLOCK).drop("size").withColumns({"block": one, "lo": one, "hi": one})
    wide = rows.filter(F.col("size") > BLOCK).drop("size")
    cells = wide.groupBy("key", "component").agg(_weight().alias("c"))
    cells = cells.withColumn("own", F.when(F.col("c") >= BLOCK, F.col("component"))).groupBy("key", "own").agg(
        F.ceil(F.sum("c") / F.lit(float(BLOCK))).cast("long").alias("blocks"))
    cells = stored(cells.withColumn("first", F.sum("blocks").over(Window.partitionBy("key").orderBy("own")) - F.col("blocks")), "blocks")
    large = cells.filter("own is not null").select("key", F.col("own").alias("component"), F.col("first").alias("at"), F.col("blocks").alias("many"))
    small = cells.filter("own is null").select("key", "first", "blocks")
    wide = wide.join(large, ["key", "component"], "left").join(small, "key", "left")
    wide = wide.withColumns({"at": F.coalesce("at", "first"), "many": F.coalesce("many", "blocks")})
    wide = wide.withColumn("block", F.col("at") + F.pmod(F.xxhash64("rep"), "many")).drop("at", "many", "first", "blocks")
    block = cells.select("key", "own", F.explode(F.sequence("first", F.col("first") + F.col("blocks") - 1)).alias("block"))
    a, b = (block.select("key", F.col("own").alias(f"own_{x}"), F.col("block").alias(x)) for x in ("lo", "hi"))
    meet = a.join(b, "key").filter("lo <= hi and (own_lo is null or own_hi is null or own_lo <> own_hi)").select("key", "lo", "hi")
    sides = meet.withColumn("block", F.explode(F.array_distinct(F.array("lo", "hi"))))
    wide = wide.join(sides, ["key", "block"])
    return whole.unionByName(wide)


def _confirmer(percent: int, width: int) -> Callable:
    def confirm(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for part in blocks.slices(frame, "text_a"):
                for piece in blocks.slices(part, "text_b"):
                    (sa, ba), (sb, bb) = (shingle_sets(piece.column(c), width) for c in ("text_a", "text_b"))
                    keep = []
                    for r in range(piece.num_rows):
                        x, y = sa[ba[r]: ba[r + 1]], sb[bb[r]: bb[r + 1]]
                        both = len(x) + len(y) - len(np.union1d(x, y))
                        keep.append(100 * both >= percent * (len(x) + len(y) - both) and both > 0)
                    yield pa.RecordBatch.from_arrays([piece.column("a"), piece.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return confirm


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    a, b = (texts.select(F.col("doc").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(_confirmer(percent, width), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, width: int = 5,
                    columns: list[str] | None = None) -> DataFrame:
    """``docs`` (or its ``columns``) with ``n_shingles``, ``component_id`` and ``kept``; documents link at ``100 * intersection >= percent *
    union`` of their sets."""
    parts = shuffle_partitions(docs.sparkSession)
    carried = Carried(docs)
    source = carried.rows.select(carried.col(id_col).cast("long").alias("doc"), carried.col(text_col).cast("string").alias("text"))
    signed = stored(source.mapInArrow(_signer(width), "doc long, n long, digest binary, keys array<long>, low binary"), "signatures")
    sets = stored(signed.filter("n > 0 and doc is not null").groupBy("digest", "n").agg(
        F.min("doc").alias("rep"), F.first("keys").alias("keys"), F.first("low").alias("low")), "sets")
    spots = sets.select("rep", F.posexplode("keys").alias("tree", "key"))
    crowded = spots.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").drop("size")
    shared = spots.join(crowded, "key").select("key", "tree", "rep")
    shared = stored(shared.join(sets.select("rep", "n", "low"), "rep").select(
        "key", F.expr(f"substring(low, tree * {DEPTH} + {ROOT + 1}, {DEPTH - ROOT})").alias("rest"), "rep", "n", "low"), "regions")
    # the same kind of join at every size: the texts are shuffled once, the ids are never broadcast
    texts = stored(source.join(shared.select(F.col("rep").alias("doc")).distinct().hint("merge"), "doc", "left_semi"), "texts")
    ordered = ["key", "rest", "rep"]

    walked = shared.repartitionByRange(parts, *ordered).sortWithinPartitions(*ordered).mapInArrow(_walker(percent, False), "a long, b long")
    votes = walked.filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("votes"))
    rank = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("votes"), "a"))
    first = stored(_confirmed(votes.withColumn("r", rank).filter("r <= 2").select("a", "b"), texts, percent, width), "links")
    groups = components(first)
    marked = shared.join(groups.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    open_regions = marked.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most"), _weight().alias("size"))
    marked = stored(marked.drop("rest").join(open_regions.filter("least < most").select("key", "size"), "key"), "open")
    packed = texts.join(marked.select(F.col("rep").alias("doc")).distinct(), "doc", "left_semi").mapInArrow(_packer(width), "rep long, packed binary")
    met = _dealt(marked).join(packed.dropDuplicates(["rep"]), "rep").repartition(parts, "key", "lo", "hi")
    met = met.sortWithinPartitions("key", "lo", "hi", "rep").mapInArrow(_walker(percent, True), "a long, b long").filter("a < b")
    second = stored(_confirmed(met.distinct(), texts, percent, width), "links")
    groups = components(first.union(second)) if second.head(1) else groups
    named = sets.select("digest", "n", "rep").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    facts = signed.select("doc", "n", "digest").join(named.select("digest", "n", F.coalesce("component", "rep").alias("component")), ["digest", "n"], "left")
    facts = facts.groupBy("doc").agg(F.min("component").alias("component"), F.max("n").alias("n"))
    out = carried.rows.withColumn("__id", carried.col(id_col).cast("long")).join(facts.withColumnRenamed("doc", "__id"), "__id", "left")
    out = out.withColumns({"__n_shingles": F.coalesce("n", F.lit(0)).cast("long"), "__component_id": F.coalesce("component", "__id")})
    out = out.withColumn("__kept", F.col("__id").eqNullSafe(F.col("__component_id")))
    return carried.only(docs.columns if columns is None else columns).back(out, "n_shingles", "component_id", "kept")
