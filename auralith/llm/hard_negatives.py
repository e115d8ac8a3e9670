"""Hard-negative mining with a Sort-Tile-Recursive packed R-tree (operator 11).

For each anchor the best ``positives`` rows of its own label are found by integer inner product, and for each of them the
best ``negatives`` rows of other labels whose score lies in a window below the positive's.

The rows are packed by Sort-Tile-Recursive at two levels. Between tasks, the two coordinates of largest variance cut all
rows into slabs and tiles at quantiles, and a tile of more than ``tile_rows`` rows is dealt into several by a hash. Inside a
task, each label of a tile is packed coordinate by coordinate into leaves, and leaves into an R-tree of minimum bounding boxes. A box gives
an interval of inner products per coordinate, and their sum one for the box. A best-first queue over the boxes of all
wanted labels passes over boxes outside the score window, or strictly below the k-th best score so far (a tie may still
win by its id).

A query goes to the tile of its own vector first. The k-th scores found there, and the boxes of all tiles, then
decide which other tiles it still has to visit. Queries stream through a tile: a task holds one tile, and neither all
queries nor all rows.

Defined cases: rows with a null id, label or vector, or a null or non-finite component take no part; only vectors of equal
length are compared; a row never answers a query of its own id; repeated rows count once; of equal vectors of one label,
only the smallest ids that an answer could name are kept; scores beyond 64 bits saturate; an anchor without positives, and a window
without negatives, give no row; empty tables give an empty result; columns other than the three are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auralith.llm.store import shuffle_partitions, stored

TILE_ROWS, LEAF, FAN = 4096, 64, 16
_MOST = (1 << 63) - 1


def scaled(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component as long; null if the vector is null or has a null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return F.when(~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.int64).reshape(len(column), dims)


class Tree:
    """STR-packed R-tree of the rows of ``x``. ``levels[0]`` are the leaves: (lows, highs, begin, end) of the packed rows;
    each further level's begin and end count the boxes of the level below."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, leaf: int = LEAF, fan: int = FAN):
        axes = np.argsort(-x.astype(float).var(axis=0), kind="stable") if x.shape[1] else np.zeros(0, np.int64)
        runs = list(self._runs(x, np.arange(len(x)), axes, leaf))
        order = np.concatenate(runs)
        self.x, self.ids, self.wide = x[order], ids[order], None
        stop = np.cumsum([len(r) for r in runs])
        lows, highs, begin, end = self._boxes(self.x, self.x, np.concatenate([[0], stop[:-1]]), stop)
        self.levels = [(lows, highs, begin, end)]
        while len(lows) > fan:
            begin = np.arange(0, len(lows), fan)
            lows, highs, begin, end = self._boxes(lows, highs, begin, np.minimum(begin + fan, len(lows)))
            self.levels.append((lows, highs, begin, end))

    @staticmethod
    def _boxes(lows: np.ndarray, highs: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple:
        return np.minimum.reduceat(lows, begin, axis=0), np.maximum.reduceat(highs, begin, axis=0), begin, end

    @classmethod
    def _runs(cls, x: np.ndarray, rows: np.ndarray, axes: np.ndarray, leaf: int) -> Iterator[np.ndarray]:
        """The rows of each leaf: slabs of whole leaves along one coordinate after another."""
        pages = -(-len(rows) // leaf)
        if pages <= 1:
            yield rows
            return
        if not len(axes):
            yield from (rows[a: a + leaf] for a in range(0, len(rows), leaf))
            return
        rows = rows[np.argsort(x[rows, axes[0]], kind="stable")]
        slabs = max(2, int(np.ceil(pages ** (1 / len(axes)))))
        size = leaf * -(-pages // slabs)
        for a in range(0, len(rows), size):
            yield from cls._runs(x, rows[a: a + size], axes[1:], leaf)


class Query:
    """One query's vector, score windows and best answers. ``bars``: k-th scores already known (None: none)."""

    def __init__(self, vector: np.ndarray, own: int, k: int, windows: list[tuple[float, float]], bars: list[int | None], reach: float):
        self.small = reach * float(np.abs(vector.astype(float)).max(initial=0)) * max(1, len(vector)) < 2.0 ** 53
        self.vector = vector.astype(float) if self.small else vector.astype(object)
        self.up, self.down = np.maximum(self.vector, 0), np.minimum(self.vector, 0)
        self.own, self.k, self.windows = own, k, windows
        self.given = [-np.inf if b is None else b for b in bars]
        self.best: list[list[tuple[int, int]]] = [[] for _ in windows]  # (-score, id), ascending
        self.opened = 0  # boxes and leaves looked into

    def bar(self, j: int) -> float:
        best = self.best[j]
        return max(self.given[j], -best[-1][0]) if len(best) == self.k else self.given[j]

    def wanted(self, lower: float, upper: float) -> bool:
        return any(upper >= low and lower <= high and min(upper, high) >= self.bar(j) for j, (low, high) in enumerate(self.windows))

    def _of(self, array: np.ndarray) -> np.ndarray:
        return array.astype(float) if self.small else array.astype(object)

    def push(self, heap: list, tree: Tree, level: int, a: int, b: int) -> None:
        lows, highs = (self._of(x[a:b]) for x in tree.levels[level][:2])
        upper, lower = highs @ self.up + lows @ self.down, lows @ self.up + highs @ self.down
        if not self.small:
            upper, lower = (np.array([min(max(int(x), -_MOST - 1), _MOST) for x in v], object) for v in (upper, lower))
        for i, (u, w) in enumerate(zip(upper.tolist(), lower.tolist())):
            if self.wanted(w, u):
                heapq.heappush(heap, (-u, len(heap), id(tree), level, a + i, w, tree))

    def search(self, trees: list[Tree]) -> None:
        heap: list = []
        for tree in trees:
            self.push(heap, tree, len(tree.levels) - 1, 0, len(tree.levels[-1][0]))
        while heap:
            upper, _, _, level, node, lower, tree = heapq.heappop(heap)
            if not self.wanted(lower, -upper):  # the bars may have risen since
                continue
            self.opened += 1
            begin, end = int(tree.levels[level][2][node]), int(tree.levels[level][3][node])
            if level:
                self.push(heap, tree, level - 1, begin, end)
            else:
                self.take(tree, begin, end)

    def take(self, tree: Tree, begin: int, end: int) -> None:
        score = self._of(tree.x[begin:end]) @ self.vector
        if not self.small:
            score = np.array([min(max(int(x), -_MOST - 1), _MOST) for x in score], object)
        ids = tree.ids[begin:end]
        for j, (low, high) in enumerate(self.windows):
            at = np.flatnonzero((score >= max(low, self.bar(j))) & (score <= high) & (ids != self.own))
            if len(at):
                found = {(-int(score[i]), int(ids[i])) for i in at}
                self.best[j] = sorted({*self.best[j], *found})[: self.k]


def windows_of(highs: list[int] | None, least: tuple[int, int]) -> list[tuple[float, float]]:
    """The score window of each positive score: from ``least`` (a fraction) of it, rounded up, to the score itself; a single
    open window if there is none."""
    if highs is None:
        return [(-np.inf, np.inf)]
    return [(-(-least[0] * s // least[1]), s) for s in highs]


def _groups(frames: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[tuple, int, pa.RecordBatch]]:
    """Runs of one key and kind."""
    for frame in frames:
        if not frame.num_rows:
            continue
        keys = np.stack([np.asarray(frame.column(c), np.int64) for c in (*names, "kind")], axis=1)
        edges = [0, *(1 + np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1))).tolist(), len(keys)]
        for a, b in zip(edges[:-1], edges[1:]):
            yield tuple(keys[a, :-1].tolist()), int(keys[a, -1]), frame.slice(a, b - a)


def _searcher(k: int, same: bool, least: tuple[int, int], leaf: int, fan: int) -> Callable:
    """Answers queries (kind 1) from the tile rows (kind 0) before them."""

    def search(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, trees, reach = None, [], None, 0.0
        for key, kind, piece in _groups(frames, ("dims", "tile", "block")):
            if key != now:
                now, held, trees = key, [], None
            if not kind:
                held.append(piece)
                continue
            if trees is None:
                rows = pa.Table.from_batches(held) if held else None
                x = _matrix(rows.column("v"), key[0]) if held else np.zeros((0, key[0]), np.int64)
                ids, labels = (np.asarray(rows.column(c), np.int64) if held else np.zeros(0, np.int64) for c in ("id", "label"))
                reach = float(np.abs(x.astype(float)).max(initial=0))
                trees = {label: Tree(x[labels == label], ids[labels == label], leaf, fan) for label in np.unique(labels).tolist()}
                held = []
            out = []
            for row, vector in zip(piece.select(["id", "h", "label", "highs", "bars"]).to_pylist(), _matrix(piece.column("v"), key[0])):
                windows = windows_of(row["highs"], least)
                query = Query(vector, row["id"], k, windows, row["bars"] or [None] * len(windows), reach)
                query.search([t for label, t in trees.items() if (label == row["label"]) == same])
                out += [(row["id"], row["h"], j, i, -s) for j, best in enumerate(query.best) for s, i in best]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()])],
                                                 ["anchor", "h", "place", "id", "score"])

    return search


def _router(same: bool, least: tuple[int, int]) -> Callable:
    """The tiles (kind 0: their boxes) that queries (kind 1) still have to visit."""

    def route(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, boxes = None, [], None
        for key, kind, piece in _groups(frames, ("dims", "tile")):
            if key != now:
                now, held, boxes = key, [], None
            if not kind:
                held.append(piece)
                continue
            if boxes is None:
                rows = pa.Table.from_batches(held) if held else None
                lows, highs = (_matrix(rows.column(c), key[0]).astype(float) if held else np.zeros((0, key[0])) for c in ("v", "high"))
                labels, tiles = (np.asarray(rows.column(c), np.int64) if held else np.zeros(0, np.int64) for c in ("label", "box"))
                boxes, held = True, []
                reach = max(np.abs(lows).max(initial=0), np.abs(highs).max(initial=0))
            v = _matrix(piece.column("v"), key[0]).astype(float)
            up, down = np.maximum(v, 0), np.minimum(v, 0)
            for at, row in enumerate(piece.select(["id", "h", "label", "highs", "bars", "box"]).to_pylist()):
                size = reach * float(np.abs(v[at]).max(initial=0)) * max(1, key[0])
                slack = 0.0 if size < 2.0 ** 53 else size * 2.0 ** -40  # what single steps of rounding can add up to
                upper = np.minimum(highs @ up[at] + lows @ down[at] + slack, float(_MOST))
                lower = np.maximum(lows @ up[at] + highs @ down[at] - slack, -float(_MOST))
                windows = windows_of(row["highs"], least)
                bars = [-np.inf if b is None else float(b) for b in row["bars"] or [None] * len(windows)]
                wanted = np.zeros(len(tiles), bool)
                for (low, high), bar in zip(windows, bars):
                    wanted |= (upper >= low - slack) & (lower <= high + slack) & (np.minimum(upper, high + slack) >= bar)
                wanted &= ((labels == row["label"]) == same) & (tiles != row["box"])
                found = np.unique(tiles[wanted])
                if len(found):
                    n = len(found)
                    yield pa.RecordBatch.from_arrays([pa.array([row[c]] * n, pa.int64()) for c in ("id", "h")] + [pa.array(found, pa.int64())], ["id", "h", "tile"])

    return route


def _boxed(key: tuple, table: pa.Table) -> pa.Table:
    """Each label's minimum bounding box in one tile."""
    x, labels = _matrix(table.column("v"), key[0].as_py()), np.asarray(table.column("label"), np.int64)
    names = np.unique(labels)
    sides = [[f(x[labels == one], axis=0).tolist() for one in names] for f in (np.min, np.max)]
    n = len(names)
    return pa.table({"dims": pa.array([key[0].as_py()] * n, pa.int32()), "tile": pa.array([key[1].as_py()] * n, pa.int64()), "label": pa.array(names),
                     "low": pa.array(sides[0], pa.list_(pa.int64())), "high": pa.array(sides[1], pa.list_(pa.int64()))})


class Index:
    """All rows, dealt into tiles, with the boxes of the tiles."""

    def __init__(self, points: DataFrame, tile_rows: int = TILE_ROWS, leaf: int = LEAF, fan: int = FAN):
        self.leaf, self.fan, self.parts = leaf, fan, shuffle_partitions(points.sparkSession)
        slabs = max(1, int(np.ceil(np.sqrt(points.count() / tile_rows))))
        self.slabs, self.axes, self.cuts = slabs, [0, 0], []
        if slabs > 1:
            spread = points.select(F.posexplode("v").alias("axis", "x")).groupBy("axis").agg(F.var_pop("x").alias("spread"))
            self.axes = ([r.axis for r in spread.orderBy(F.desc("spread"), "axis").limit(2).collect()] * 2)[:2]
            self.cuts = points.agg(self._quantiles(0)).first()[0] or []
        placed = points.withColumn("slab", self._slab(F.array(*map(F.lit, self.cuts)) if self.cuts else None, 0))
        self.second = placed.groupBy("slab").agg(self._quantiles(1).alias("cuts")) if slabs > 1 else None  # slabs x slabs numbers
        self.second = stored(self.second, "cuts") if slabs > 1 else None
        placed = self._tiled(points)
        sizes = placed.groupBy("dims", "slab", "run").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(tile_rows))).cast("long").alias("deals"))
        self.sizes = stored(sizes, "tiles")
        self.rows = stored(self._dealt(placed), "rows")
        self.boxes = stored(self.rows.select("dims", "tile", "label", "v").groupBy("dims", "tile").applyInArrow(
            _boxed, "dims int, tile long, label long, low array<long>, high array<long>"), "boxes")

    def _quantiles(self, axis: int) -> Column:
        return F.percentile_approx(F.get("v", F.lit(self.axes[axis])), [i / self.slabs for i in range(1, self.slabs)], 10_000)

    def _slab(self, cuts: Column | None, axis: int) -> Column:
        if cuts is None:
            return F.lit(0).cast("long")
        x = F.get("v", F.lit(self.axes[axis]))
        return F.coalesce(F.size(F.filter(cuts, lambda c: c < x)), F.lit(0)).cast("long")

    def _tiled(self, df: DataFrame) -> DataFrame:
        df = df.withColumn("slab", self._slab(F.array(*map(F.lit, self.cuts)) if self.cuts else None, 0))
        if self.second is None:
            return df.withColumn("run", F.lit(0).cast("long"))
        return df.join(self.second, "slab", "left").withColumn("run", self._slab(F.col("cuts"), 1)).drop("cuts")

    def _dealt(self, tiled: DataFrame) -> DataFrame:
        tiled = tiled.join(self.sizes, ["dims", "slab", "run"], "left")
        deal = F.pmod(F.xxhash64("id", "h"), F.coalesce("deals", F.lit(1)).cast("long"))
        return tiled.withColumn("tile", F.shiftleft("slab", 42) + F.shiftleft("run", 21) + deal).drop("slab", "run", "deals")

    def home(self, queries: DataFrame) -> DataFrame:
        """``queries`` with the ``tile`` that their own vectors belong to."""
        return self._dealt(self._tiled(queries))

    def _visit(self, queries: DataFrame, k: int, same: bool, least: tuple[int, int], block_queries: int) -> DataFrame:
        """Answers of ``queries`` (with a ``tile`` each) from that tile: (anchor, h, place, id, score)."""
        blocks = max(1, -(-queries.count() // block_queries))
        columns = ["dims", "tile", "block", "kind", "id", "h", "label", "v", "highs", "bars"]
        asked = queries.withColumns({"kind": F.lit(1), "block": F.pmod(F.xxhash64("id", "h", F.lit(1)), F.lit(blocks))}).select(*columns)
        visited = queries.select("dims", "tile").distinct()
        given = self.rows.join(visited, ["dims", "tile"], "left_semi").withColumns(
            {"kind": F.lit(0), "block": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))),
             "highs": F.lit(None).cast("array<long>"), "bars": F.lit(None).cast("array<long>")}).select(*columns)
        both = given.unionByName(asked).repartition(self.parts, "dims", "tile", "block").sortWithinPartitions("dims", "tile", "block", "kind")
        return both.mapInArrow(_searcher(k, same, least, self.leaf, self.fan), "anchor long, h long, place int, id long, score long")

    def search(self, queries: DataFrame, k: int, same: bool, least: tuple[int, int] = (4, 5), block_queries: int = 1 << 16, block_boxes: int = 4096) -> DataFrame:
        """The k best rows of each query's label (``same``) or of the others, for each of its windows. ``queries``: id, h,
        dims, label, v, highs (positive scores; null: one open window). Returns (anchor, h, place, rank, id, score)."""
        queries = stored(self.home(queries), "queries")
        first = stored(self._visit(queries.withColumn("bars", F.lit(None).cast("array<long>")), k, same, least, block_queries), "found")
        kth = first.groupBy("anchor", "h", "place").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("bar"))
        bars = kth.groupBy("anchor", "h").agg(F.map_from_entries(F.collect_list(F.struct("place", "bar"))).alias("known"))  # a window each
        bars = bars.withColumnsRenamed({"anchor": "id"})
        asked = queries.join(bars, ["id", "h"], "left")
        count = F.coalesce(F.size("highs"), F.lit(1))
        asked = asked.withColumn("bars", F.when(F.col("known").isNotNull(), F.transform(
            F.sequence(F.lit(0), count - 1), lambda j: F.try_element_at("known", j)))).drop("known")
        asked = stored(asked.withColumnRenamed("tile", "box"), "queries")
        blocks = max(1, -(-self.boxes.count() // block_boxes))
        columns = ["dims", "tile", "kind", "id", "h", "label", "v", "high", "highs", "bars", "box"]
        none, many = F.lit(None).cast("array<long>"), F.lit(None).cast("long")
        boxes = self.boxes.withColumn("box", F.col("tile")).withColumns(
            {"tile": F.pmod(F.xxhash64("tile", "label"), F.lit(blocks)), "kind": F.lit(0), "id": many, "h": many, "v": F.col("low"), "highs": none, "bars": none}).select(*columns)
        every = asked.withColumns({"tile": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))), "kind": F.lit(1), "high": none}).select(*columns)
        both = boxes.unionByName(every).repartition(self.parts, "dims", "tile").sortWithinPartitions("dims", "tile", "kind")
        routes = both.mapInArrow(_router(same, least), "id long, h long, tile long").distinct()
        further = stored(asked.join(routes, ["id", "h"]), "routes")
        second = self._visit(further, k, same, least, block_queries)
        rank = F.row_number().over(Window.partitionBy("anchor", "h", "place").orderBy(F.desc("score"), "id"))
        found = first.unionByName(second).distinct().withColumn("rank", rank).filter(F.col("rank") <= k)
        return stored(found, "answers")


def mine(vectors: DataFrame, anchors: Column, id_col: str = "id", label_col: str = "label", vector_col: str = "v", positives: int = 5,
         negatives: int = 5, least: tuple[int, int] = (4, 5), tile_rows: int = TILE_ROWS, leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score). ``vector_col``: array<long> or null;
    ``anchors``: a condition on the id column; ``least``: the window's lower end as a fraction of the positive's score."""
    chosen = F.coalesce(anchors, F.lit(False)).alias("anchor")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<long>").alias("v"), chosen)
    rows = rows.filter("id is not null and label is not null and v is not null").withColumns({"h": F.xxhash64("label", "v"), "h2": F.xxhash64("v", "label")})
    rows = stored(rows.groupBy("id", "h", "h2").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.max("anchor").alias("anchor")).withColumn("dims", F.size("v")), "vectors")
    copy = F.row_number().over(Window.partitionBy("h", "h2").orderBy("id"))
    keep = max(positives, negatives) + 1
    points = rows.drop("anchor").withColumn("copy", copy).filter(F.col("copy") <= keep).drop("copy", "h2")
    index = Index(stored(points, "points"), tile_rows, leaf, fan)
    asked = rows.filter("anchor").select("id", "h", "dims", "label", "v", F.lit(None).cast("array<long>").alias("highs"))
    near = index.search(asked, positives, True, least)
    facts = F.array_sort(F.collect_list(F.struct("rank", "score", "id")))  # at most ``positives`` of them
    facts = near.groupBy(F.col("anchor").alias("id"), "h").agg(facts.alias("near"))
    asked = stored(asked.drop("highs").join(facts, ["id", "h"]), "positives")
    found = index.search(asked.withColumn("highs", F.col("near")["score"]).drop("near"), negatives, False, least)
    out = found.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).join(
        asked.select(F.col("id").alias("anchor"), "h", F.posexplode("near").alias("place", "positive")), ["anchor", "h", "place"])
    return out.select(F.col("anchor").alias("anchor_id"), F.col("positive.id").alias("positive_id"), "rank", "negative_id",
                      F.col("positive.score").alias("positive_score"), "negative_score")


SQL = """
WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INT AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
