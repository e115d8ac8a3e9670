"""Embedding near-dedup with randomised-rotation binary codes (operator 6).

Vectors of equal label link when their cosine reaches ``threshold``. A unit vector ``o`` is turned by one random
rotation; its code is the sign of each turned component, and it stores the correction factor ``f = <code, o>`` (the
code as a unit vector). For any unit vector ``q``, ``<code, q> / f`` is an unbiased estimate of the cosine, whose error is
``sqrt(1/f**2 - 1) * sqrt(1 - cos**2) * t`` with ``t`` one coordinate of a random unit vector in ``d - 1`` dimensions. A
pair at or above the threshold therefore shows at least ``threshold - bound`` except with the probability that
``|t|`` exceeds ``epsilon / sqrt(d - 1)`` (about 2e-9 at the default 6; where that is over 1 the bound is certain). Pairs
that pass from both sides are recomputed exactly in double precision; no other pair is.

Equal vectors are collapsed first, so a vector in a third of all rows is one weighted row. The distinct vectors of a
label are dealt into blocks of bounded size, each pair of blocks is one task group, and it returns one row per vector
(its number of links) and a spanning forest of its links, never the pairs themselves. Components of the forests come
from ``graphs.components``. Every block of a label meets every other: work per label is quadratic, memory and rows sent
per group are not.

Defined cases: vectors that are null, zero or hold null or non-finite components, and rows with a null label, link with
nothing; only vectors of equal length are compared; repeated rows are vectors of their own; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auralith.llm.columns import Carried
from auralith.llm.graphs import components
from auralith.llm.store import stored


def rotation(dims: int, seed: int = 7) -> np.ndarray:
    """Uniformly random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def encode(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Turned vectors, codes (bool) and correction factors."""
    turned = unit @ turn
    return turned, turned > 0, np.abs(turned).sum(axis=1) / np.sqrt(unit.shape[1])


def candidate_pairs(left: tuple, right: tuple, threshold: float, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs whose estimates from both sides leave the threshold possible."""
    dims = left[0].shape[1]
    spread = min(1.0, epsilon / np.sqrt(dims - 1)) if dims > 1 else 1.0
    spread *= np.sqrt(max(0.0, 1 - threshold ** 2))
    possible = np.ones((len(left[0]), len(right[0])), bool)
    for (_, code, factor), (turned, _, _), flip in ((left, right, False), (right, left, True)):
        signs = (np.where(code, 1.0, -1.0) / np.sqrt(dims)).astype(np.float32)
        estimate = (signs @ turned.T.astype(np.float32)) / factor[:, None].astype(np.float32)
        least = threshold - np.sqrt(np.maximum(0.0, 1 / factor ** 2 - 1)) * spread - 1e-5  # single precision
        passed = estimate >= least[:, None].astype(np.float32)
        possible &= passed.T if flip else passed
    return np.nonzero(possible)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes over the links (a, b)."""
    root = np.arange(n)
    while len(a):
        before = root.copy()
        np.minimum.at(root, a, root[b])
        np.minimum.at(root, b, root[a])
        root = root[root]
        if (root == before).all():
            break
    return root


def _linker(threshold: float, epsilon: float, seed: int) -> Callable:
    def link(key: tuple, table: pa.Table) -> pa.Table:
        dims, lo, hi = (k.as_py() for k in key[1:])
        order = np.argsort(np.asarray(table.column("rep"), np.int64), kind="stable")
        rep, weight = (np.asarray(table.column(c), np.int64)[order] for c in ("rep", "weight"))
        block = np.asarray(table.column("block"), np.int64)[order]
        flat = table.column("v").combine_chunks()
        v = np.asarray((flat if isinstance(flat, pa.ListArray) else flat.chunk(0)).flatten(), np.float64).reshape(-1, dims)[order]
        top = np.abs(v).max(axis=1, keepdims=True)
        v = v / top  # so that squares neither overflow nor vanish
        unit = v / np.sqrt((v * v).sum(axis=1, keepdims=True))
        turn = rotation(dims, seed)
        links, a_all, b_all = np.zeros(len(rep), np.int64), [], []
        first, second = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        mine = [encode(unit[second], turn)]
        for at in range(0, len(first), 512):
            rows = first[at: at + 512]
            i, j = candidate_pairs(encode(unit[rows], turn), mine[0], threshold, epsilon)
            a, b = rows[i], second[j]
            if lo == hi:
                a, b = a[a < b], b[a < b]
            for s in range(0, len(a), 100_000):
                x, y = a[s: s + 100_000], b[s: s + 100_000]
                near = (unit[x] * unit[y]).sum(axis=1) >= threshold
                a_all.append(x[near])
                b_all.append(y[near])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a_all, b_all))
        np.add.at(links, a, weight[b])
        np.add.at(links, b, weight[a])
        root = forest(len(rep), a, b)
        some = np.flatnonzero(links > 0)
        return pa.table({"rep": pa.array(rep[some]), "links": pa.array(links[some]), "to": pa.array(rep[root[some]])})

    return link


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                    threshold: float = 0.93, epsilon: float = 6.0, block_rows: int = 2048, seed: int = 7) -> DataFrame:
    """``vectors`` with ``n_links``, ``component_id`` and ``kept``."""
    carried = Carried(vectors)
    v, label = carried.col(vector_col), carried.col(label_col)
    big = F.lit(float("inf"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == big)) | ~F.exists(v, lambda x: x != 0)
    valid = F.coalesce(~bad, F.lit(False)) & label.isNotNull() & carried.col(id_col).isNotNull()
    keys = {"__label": F.when(valid, label.cast("string")), "__h1": F.when(valid, F.xxhash64(v)), "__h2": F.when(valid, F.xxhash64(F.lit(1), v))}
    rows = carried.rows.withColumns(keys).withColumn("__id", carried.col(id_col).cast("long"))
    by = ["__label", "__h1", "__h2"]
    reps = stored(rows.filter("__h1 is not null").groupBy(*by).agg(
        F.min("__id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.first(v).alias("v")).withColumn("dims", F.size("v")), "vectors")
    blocks = reps.groupBy("__label", "dims").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(block_rows))).cast("int").alias("blocks"))
    dealt = reps.join(blocks, ["__label", "dims"]).withColumn("block", F.pmod(F.xxhash64("__h1", "__h2"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
    found = dealt.select("__label", "dims", "lo", "hi", "block", "rep", "weight", "v").groupBy("__label", "dims", "lo", "hi").applyInArrow(
        _linker(threshold, epsilon, seed), "rep long, links long, to long")
    found = stored(found, "links")
    groups = components(found.select(F.col("rep").alias("a"), F.col("to").alias("b")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    facts = reps.select(*by, "rep", "weight").join(links, "rep", "left").join(
        groups.withColumnsRenamed({"node": "rep", "component": "group"}), "rep", "left").select(
        *by, (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("__n"), F.coalesce("group", "rep").alias("__g"))
    out = rows.join(facts, by, "left").withColumns({"__n_links": F.coalesce("__n", F.lit(0)).cast("long"), "__component_id": F.coalesce("__g", "__id")})
    out = out.withColumn("__kept", F.col("__id").eqNullSafe(F.col("__component_id")))
    return carried.back(out, "n_links", "component_id", "kept")


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.93),
r AS (SELECT DISTINCT a AS node, a AS reach FROM l UNION SELECT r.node, l.b FROM r JOIN l ON r.reach = l.a),
c AS (SELECT node, min(reach) AS component FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(c.component, e.vec_id) AS component_id,
       coalesce(c.component, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN c ON c.node = e.vec_id
"""
