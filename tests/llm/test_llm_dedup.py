"""Substring dedup, MinHash forest and embedding dedup against brute force, and their edge cases."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from auralith.llm import embed_dedup, graphs, minhash_forest, substring_dedup
from auralith.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string"


def words_of(seed, n, kinds=12):
    rng = random.Random(seed)
    return [f"w{rng.randrange(kinds)}" for _ in range(n)]


def removed_by_brute_force(rows, window):
    seen, out = set(), {}
    for doc, text in sorted((d, t or "") for d, t in rows if d is not None):
        words = WORD.findall(text)
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            key = tuple(words[i: i + window])
            if key in seen:
                gone[i: i + window] = [True] * window
            seen.add(key)
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.setdefault(doc, []).append((len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("window,first", [(20, 5), (20, 10), (21, 5), (50, 5), (7, 10), (1, 5)])
def test_substring_dedup_equals_brute_force(spark, window, first):
    rng = random.Random(window)
    shared = [words_of(100 + i, rng.randrange(4, 60), 400) for i in range(8)]
    rows = []
    for doc in range(60):
        parts = [words_of(doc * 7 + k, rng.randrange(0, 30), 30) if rng.random() < 0.5 else rng.choice(shared) for k in range(rng.randrange(0, 6))]
        rows.append((doc * 3 % 61, " ".join(w for p in parts for w in p)))
    rows += [(1000, None), (1001, ""), (1002, "\x0b \t\n"), (1003, "a b é"), (1004, "same " * 5000), (1005, "same " * 5000)]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(5), window=window, first_level=first)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()}
    assert got == {d: v[0] for d, v in removed_by_brute_force(rows, window).items()}


def test_substring_levels_double_up_to_any_window():
    assert substring_dedup.levels_of(20, 5) == [5, 10, 20] and substring_dedup.levels_of(50, 5) == [5, 10, 20, 40, 50]
    assert substring_dedup.levels_of(21, 5) == [5, 10, 20, 21] and substring_dedup.levels_of(7, 10) == [3, 6, 7]
    assert [substring_dedup.levels_of(w, 5) for w in (1, 2, 3)] == [[1], [1, 2], [1, 2, 3]]


def test_substring_windows_of_one_hash_and_other_words_stay(spark, monkeypatch):
    whole = substring_dedup.blocks.span_hashes
    # every hash but the last level's second one is the same for all spans of one length
    blind = lambda values, start, end, base: whole(values, start, end, base) if base in substring_dedup._SECOND else (end - start).astype("uint64")
    pieces = substring_dedup.blocks.pa.array([" ".join(f"a{i}" for i in range(8)), " ".join(f"b{i}" for i in range(8)), " ".join(f"a{i}" for i in range(8))])
    monkeypatch.setattr(substring_dedup.blocks, "span_hashes", blind)
    frame = substring_dedup.blocks.pa.RecordBatch.from_arrays(
        [substring_dedup.blocks.pa.array([1, 2, 3]), pieces], ["__doc", "__text"])
    sent = list(substring_dedup._sender([8], 0, 4)(iter([frame])))
    settled = {int(d): f for batch in substring_dedup._gather(substring_dedup._settler(True, 4)(iter(sent)))
               for d, f in zip(batch.column("doc").to_pylist(), batch.column("found").to_pylist())}
    assert {d: np.frombuffer(f, np.uint64).tolist() for d, f in settled.items()} == {3: [0]}
    halves = [list(substring_dedup._sender([8], 0, 4)(iter([frame.slice(i, 1)])))[0] for i in range(3)]  # settled elsewhere
    settled = [d for batch in substring_dedup._gather(substring_dedup._settler(True, 4)(iter(halves))) for d in batch.column("doc").to_pylist()]
    assert settled == [3]


def test_substring_dedup_edges(spark):
    line = " ".join(words_of(1, 40, 999))
    rows = [(5, line, "x", 1), (5, line, "x", 1), (None, line, "y", 2), (7, "z " + line, "z", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string, `__c0` int")
    got = substring_dedup.remove_repeats(docs)
    assert got.columns == ["doc_id", "text", "__c0", "kept_text", "n_words", "n_removed", "kept_sha256", "removed_spans"]
    out = sorted((r.doc_id or -1, r.n_words, r.n_removed, r.kept_text, r.removed_spans) for r in got.collect())
    assert out[0] == (-1, 40, 0, line, [])  # a null id is never a copy
    assert out[1:3] == [(5, 40, 0, line, []), (5, 40, 40, "", [[0, 40]])] or out[1:3] == [(5, 40, 40, "", [[0, 40]]), (5, 40, 0, line, [])]
    assert out[3] == (7, 41, 40, "z", [[1, 41]])
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0


def sets_of(text, width=5):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    return frozenset(tuple(words[i: i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def components_by_brute_force(sets, linked):
    ids = list(sets)
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if linked(sets[a], sets[b]):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {d: find(d) for d in ids}


@pytest.mark.parametrize("percent", [80, 85])
def test_minhash_forest_equals_brute_force(spark, percent):
    rng = random.Random(percent)
    rows = []
    for group in range(12):  # chains: each copy changes a few words of the copy before
        words = words_of(500 + group, rng.randrange(30, 160), 2000)
        for _ in range(rng.randrange(1, 14)):
            rows.append(" ".join(words))
            words = list(words)
            for _ in range(rng.randrange(0, 3)):
                words[rng.randrange(len(words))] = f"n{rng.random()}"
    rows += ["", " \t", None, "one two", "ONE two", "one two three four five", "a b c d e f", "x " * 3000, "X " * 4000]
    table = [(i, t) for i, t in enumerate(rows)]
    got = minhash_forest.near_duplicates(spark.createDataFrame(table, SCHEMA), percent=percent)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got.collect()}
    sets = {i: sets_of(t) for i, t in table}
    want = components_by_brute_force(sets, lambda a, b: bool(a & b) and 100 * len(a & b) >= percent * len(a | b))
    assert got == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}


def test_minhash_round_two_keeps_links_of_crowded_regions(spark, monkeypatch):
    monkeypatch.setattr(minhash_forest, "CROWD", 2)  # round 1 passes most pairs over
    base = words_of(9, 120, 3000)
    rng = random.Random(4)
    rows = [(0, " ".join(base))]
    for i in range(1, 90):
        words = list(base)
        for _ in range(rng.randrange(1, 5)):
            words[rng.randrange(len(words))] = f"n{rng.random()}"
        rows.append((i, " ".join(words)))
    got = minhash_forest.near_duplicates(spark.createDataFrame(rows, SCHEMA), percent=85)
    sets = {i: sets_of(t) for i, t in rows}
    want = components_by_brute_force(sets, lambda a, b: 100 * len(a & b) >= 85 * len(a | b))
    assert {r.doc_id: r.component_id for r in got.collect()} == want


def test_minhash_round_two_sees_regions_whole_that_tasks_and_blocks_cut(spark, monkeypatch):
    monkeypatch.setattr(minhash_forest, "CROWD", 2)  # round 1 passes most pairs over
    monkeypatch.setattr(minhash_forest, "PIECE", 2)  # and cuts regions every few rows
    monkeypatch.setattr(minhash_forest, "BLOCK", 5, raising=False)
    monkeypatch.setattr(minhash_forest, "shuffle_partitions", lambda spark: 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    base, rng, rows = words_of(19, 364, 30000), random.Random(14), []
    for i in range(80):  # a common text with four words changed; only texts i and 40 + i have two changes in common
        words = list(base)
        for k in range(4):
            shared = random.Random(f"{i % 40} {k}") if k < 2 else rng
            words[shared.randrange(len(words))] = f"n{shared.random()}"
        rows.append((i, " ".join(words)))
    try:
        got = {r.doc_id: r.component_id for r in minhash_forest.near_duplicates(spark.createDataFrame(rows, SCHEMA), percent=85).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    sets = {i: sets_of(t) for i, t in rows}
    want = components_by_brute_force(sets, lambda a, b: 100 * len(a & b) >= 85 * len(a | b))
    assert len(set(want.values())) > 30 and got == want


def test_round_two_counts_whole_hashes_at_the_threshold():
    """85 of 100 shingles in common, two of them alike in their upper 32 bits; and a pair that only such bits would let in."""
    def crossing(a, b):
        sets = [np.sort(np.array(x, np.uint64)) for x in (a, b)]
        low, n = np.zeros((2, minhash_forest._HASHES), np.uint8), np.array([len(x) for x in sets])
        return list(minhash_forest._crossing(np.array([1, 2]), low, n, np.array([1, 2]), np.zeros(2, np.int64), sets, 85))

    def spread(numbers):
        return [(x << 40) + 7 for x in numbers]

    shared = spread(range(83)) + [(500 << 40) + 1, (500 << 40) + 2]
    a, b = shared + spread(range(1000, 1008)), shared + spread(range(2000, 2007))
    assert len({*a} & {*b}) == 85 and len({*a} | {*b}) == 100 and crossing(a, b) == [(1, 2)]
    alike = [x + 1 for x in spread(range(83))] + shared[83:]
    assert crossing(spread(range(83)) + shared[83:], alike) == []


def test_blocks_are_bounded_by_shingles(spark, monkeypatch):
    """Texts of many shingles take up several rows' room, so a block of them holds fewer."""
    monkeypatch.setattr(minhash_forest, "BLOCK", 64)
    rows = [(1, i, 20_000 if i % 2 else 10, i) for i in range(200)]
    df = spark.createDataFrame(rows, "key long, rep long, n long, component long")
    df = df.withColumn("size", F.lit(1e9))
    dealt = minhash_forest._dealt(df).select("block", "rep", "n").distinct().groupBy("block").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"))
    sizes = dealt.collect()
    assert sum(r.rows for r in sizes) == 200 and len(sizes) >= 17
    assert max(r.n for r in sizes) <= 3 * 64 * minhash_forest.HEAVY


def test_minhash_edges(spark):
    rows = [(3, "a b c d e f g", 1.5), (3, "a b c d e f g", 2.5), (None, "a b c d e f g", 0.5), (9, "A b C d e f g", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept double")
    got = minhash_forest.near_duplicates(docs)
    assert got.columns == ["doc_id", "text", "n_shingles", "component_id", "kept"]
    assert sorted((str(r.doc_id), r.n_shingles if r.doc_id else None, r.component_id, r.kept) for r in got.collect()) == [
        ("3", 3, 3, True), ("3", 3, 3, True), ("9", 3, 3, False), ("None", None, None, True)]
    assert minhash_forest.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (201, 200), (200, 201)]
    got = dict(map(tuple, graphs.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200}
    assert got == want
    assert graphs.components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def links_by_brute_force(rows, threshold):
    good = {}
    for i, v, label in rows:
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = (np.array(v, np.float64), label)
    near = {i: set() for i, _, _ in rows}
    for i, (x, a) in good.items():
        for j, (y, b) in good.items():
            if i < j and a == b and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= threshold:
                near[i].add(j)
                near[j].add(i)
    out = {}
    for i in near:
        seen, todo = {i}, [i]
        while todo:
            for k in near[todo.pop()] - seen:
                seen.add(k)
                todo.append(k)
        out[i] = (len(near[i]), min(seen), min(seen) == i)
    return out


@pytest.mark.parametrize("dims", [2, 16, 64])
def test_embedding_dedup_equals_brute_force(spark, dims):
    rng = np.random.default_rng(dims)
    centres = rng.standard_normal((6, dims))
    rows = []
    for i in range(260):
        v = centres[rng.integers(6)] + rng.standard_normal(dims) * rng.choice([0.05, 0.2, 0.35])
        rows.append((i, [float(x) for x in v.astype(np.float32)], int(rng.integers(3))))
    rows += [(300 + i, rows[5][1], rows[5][2]) for i in range(30)]  # one very common vector
    rows += [(400, None, 1), (401, [0.0] * dims, 1), (402, [None] + [1.0] * (dims - 1), 1), (403, [float("nan")] * dims, 1),
             (404, [float("inf")] * dims, 1), (405, rows[0][1], None), (406, [1.0] * (dims + 1), 1), (407, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = embed_dedup.near_duplicates(df, threshold=0.93, block_rows=20)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got.collect()}
    assert got == links_by_brute_force(rows, 0.93)
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def test_binary_code_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(0)
    dims, errors = 64, []
    a = rng.standard_normal((40, dims))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((40, dims))
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    for seed in range(60):
        turn = embed_dedup.rotation(dims, seed)
        assert np.allclose(turn @ turn.T, np.eye(dims))
        (_, code, factor), (turned, _, _) = embed_dedup.encode(a, turn), embed_dedup.encode(b, turn)
        estimate = (np.where(code, 1, -1) / np.sqrt(dims) * turned).sum(axis=1) / factor
        true = (a * b).sum(axis=1)
        bound = np.sqrt(1 / factor ** 2 - 1) * np.sqrt(1 - true ** 2) * 6 / np.sqrt(dims - 1)
        assert (np.abs(estimate - true) <= bound).all()
        errors.append(estimate - true)
    assert abs(np.mean(errors)) < 0.01


@pytest.mark.parametrize("name", ["op1_substring_dedup", "op8_minhash_forest"])
def test_queries_cover_every_document(spark, name):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in QUERIES[name](spark, SF).collect()}
    if name.startswith("op1"):
        assert got == {d: v[0] for d, v in removed_by_brute_force(docs, 20).items()}
    else:
        sets = {d: sets_of(t) for d, t in docs}
        want = components_by_brute_force(sets, lambda a, b: bool(a & b) and 100 * len(a & b) >= 85 * len(a | b))
        assert got == {d: (len(sets[d]), want[d], want[d] == d) for d in sets}
