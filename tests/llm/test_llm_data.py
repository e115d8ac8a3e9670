"""Packing, mixing, top-k search and WARC bundles against brute force, oracles and round trips, and their edge cases."""

import hashlib
import math
import struct
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from auralith.llm import mixing, packing, topk, warc
from auralith.llm.queries import ORACLE_SQL, QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"


def canon(v):
    return f"{v:.9g}" if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    rows = QUERIES[name](spark, SF)
    cur = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(rows.columns)
    want = sorted("|".join(map(canon, r)) for r in cur.fetchall())
    assert want == sorted("|".join(canon(r[c]) for c in columns) for r in rows.collect()) and want


TEXTS = ["", None, "Hello, WORLD.", "it's 42 don't <|endoftext|> x", "... ,,, a... b,. C.", "naïve Ünïcode Ⅻ 東京 😀   á J̌",
         "word " * 9000, "Zed.zed Zed zED. zed., !?", "a\x0bb\x1cc d"]


def test_pieces_equal_the_tokenizer(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "x y"), (3, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = packing.pieces(docs, tokenizer_path(), capacity=512, with_ids=True).collect()
    want = []
    for i, t in rows:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 512)):
            raw = struct.pack(f"<{len(ids[at: at + 512])}I", *ids[at: at + 512])
            want.append((i, k, at, len(raw) // 4, zlib.crc32(raw), raw))
    assert sorted(str((*r[:5], bytes(r[5]))) for r in got) == sorted(map(str, want))


def check_packed(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for bin_ in bins.values():
        at = 0
        for offset, length in sorted(bin_):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_is_gapless_tight_and_repeatable(spark):
    rng = np.random.default_rng(1)
    lengths = np.minimum(4096, rng.lognormal(6.5, 1.1, 6000).astype(int) + 1)
    cut = spark.createDataFrame([(i, 0, 0, int(n), i) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    rows = packing.pack(cut, group_pieces=2000).collect()
    assert sorted((r.doc_id, r.length) for r in rows) == list(enumerate(lengths.tolist()))
    assert check_packed(rows, 4096) <= 1.02 * math.ceil(lengths.sum() / 4096)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, packing.pack(cut.repartition(7), group_pieces=2000).collect()))
    assert packing.pack(cut.limit(0)).count() == 0


def naive_best_fit(lengths, capacity, limit):
    """Bins and offsets by looking at every open bin."""
    free, out, made = {}, [], 0
    for length in lengths:
        fitting = [(f, -b) for b, f in free.items() if f >= length]
        if fitting:
            space = min(fitting)[0]
            number = max((b for b, f in free.items() if f == space), key=lambda b: stamp[b])
        else:
            if length < capacity and len(free) >= limit:
                space = min(free.values())
                del free[max((b for b, f in free.items() if f == space), key=lambda b: stamp[b])]
            number, free[made], made = made, capacity, made + 1
        out.append((number, capacity - free[number]))
        stamp[number] = len(out)
        free[number] -= length
        if not free[number]:
            del free[number]
    return out


stamp: dict[int, int] = {}


@pytest.mark.parametrize("limit", [1, 3, 40])
def test_open_bins_equal_a_naive_replay(limit):
    rng = np.random.default_rng(limit)
    lengths = np.minimum(100, rng.lognormal(3, 0.9, 3000).astype(int) + 1).tolist()
    stamp.clear()
    bins = packing.OpenBins(100, limit)
    assert [bins.put(n) for n in lengths] == naive_best_fit(lengths, 100, limit)


def test_every_group_has_a_partition_of_its_own(spark):
    keys = spark.range(4000).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", "id % 90 + 1 AS length", "id AS ids_crc32", "id AS row")
    for groups in (1, 2, 8, 40):
        parts = packing.dealt(keys, groups, 3).selectExpr("spark_partition_id() AS p", "group").distinct().collect()
        assert sorted((r.p, r.group) for r in parts) == [(g, g) for g in range(groups)]


def test_ids_come_back_to_their_places(spark):
    rows = [(i % 50, 0, 0, 2, i % 50, struct.pack("<2I", i % 50, 1)) for i in range(900)]  # ids and pieces repeat
    cut = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")
    got = packing.pack(cut, capacity=16, group_pieces=300, task_bytes=1000).collect()
    assert check_packed(got, 16) <= 115 and sorted(bytes(r.ids) for r in got) == sorted(r[5] for r in rows)
    assert all(struct.unpack("<2I", r.ids)[0] == r.doc_id for r in got)


def test_open_bins_best_fit_and_limit():
    bins = packing.OpenBins(10, 2)
    assert bins.put(6) == (0, 0)  # 4 free
    assert bins.put(7) == (1, 0)  # 3 free
    assert bins.put(3) == (1, 7)  # the tightest fit, and bin 1 is full
    assert bins.put(8) == (2, 0)  # 2 free
    assert bins.put(9) == (3, 0)  # limit: bin 2, the fullest, closes
    assert bins.put(2) == (0, 6) and bins.put(10) == (4, 0) and bins.count == 2


def test_op3_covers_every_document(spark):
    rows = QUERIES["op3_best_fit_packing"](spark, SF).collect()
    ids = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in ids}
    assert check_packed(rows, 4096) <= math.ceil(sum(r.length for r in rows) / 4096) + 2


def targets_by_rounds(sizes):
    names = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    free, fixed, left = set(names), {}, sum(sizes.values())
    while True:
        total = sum(weight[s] for s in free)
        target = {s: left * weight[s] / total for s in free}
        over = [s for s in free if target[s] > 3 * sizes[s]]
        if not over:
            return target | fixed
        for s in over:
            fixed[s] = 3.0 * sizes[s]
            left -= fixed[s]
            free.discard(s)


def test_mixing_targets_copies_and_edges(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(3000):
        source = [None, "a", "b", "é", "big", "tiny", "zero"][min(6, int(rng.exponential(1.6)))]
        words = 0 if source == "zero" else int(rng.integers(1, 4 if source == "tiny" else 60))
        rows.append((i, " ".join(["w"] * words) if words else rng.choice(["", None]), source, "s", 1))
    rows = [(i, None if t is None else str(t), s, x, c) for i, t, s, x, c in rows] + [(0, "w w", "a", "s", 1)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string, copies int")
    out = mixing.mix(docs.repartition(6)).collect()
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again)) and len(out) == len(rows)
    sizes, taken, seen = defaultdict(int), defaultdict(int), {}
    for r in out:
        assert 0 <= r.copies <= 3 and r.taken == r["size"] * r.copies
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        seen[r.source] = (r.source_size, r.target)
    want = targets_by_rounds(sizes)
    for s in sizes:
        assert seen[s][0] == sizes[s] and seen[s][1] == pytest.approx(want[s])
        assert abs(taken[s] - want[s]) <= 61  # one longest document
    assert any(want[s] == 3 * sizes[s] > 0 for s in sizes)
    emitted = mixing.emitted(mixing.mix(docs), ["doc_id", "text"])
    assert emitted.columns == ["doc_id", "text"] and emitted.count() == sum(r.copies for r in out)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_topk_equals_brute_force_with_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=8).astype(np.float32)]) for i in range(600)]
    rows += [(700 + i, rows[3][1]) for i in range(40)] + [(700, rows[3][1])]  # ties and a repeated row
    rows += [(900, None), (901, [None] * 8), (902, [float("nan")] + [0.0] * 7), (903, [float("inf")] * 8), (None, rows[0][1]), (904, [1.0] * 3), (905, [2.0] * 3)]
    df = spark.createDataFrame(rows, "id long, v array<float>").select("id", topk.scaled(topk.F.col("v")).alias("v"))
    got = topk.top_k(df.filter("id % 50 = 0 or id = 904"), df, k=10, block_rows=100, block_queries=4)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in got.collect()}
    good = {i: [math.floor(1024 * x) for x in v] for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    want = {}
    for q in good:
        if q % 50 == 0 or q == 904:
            best = sorted((-sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
            want |= {(q, r): (i, -s) for r, (s, i) in enumerate(best[:10], 1)}
    assert got == want
    assert topk.top_k(df.limit(0), df).count() == 0 and topk.top_k(df, df.limit(0)).count() == 0


def test_nra_bounds_give_exact_results_for_huge_values():
    x = np.array([[2 ** 40, 3], [2 ** 40, 2], [-(2 ** 40), 9]], np.int64)
    got = topk.nra(x, np.array([5, 6, 7]), np.array([[2 ** 20, 1]], np.int64), np.array([1]), 2)
    assert got == [(1, 5, 2 ** 60 + 3), (1, 6, 2 ** 60 + 2)]


def test_warc_round_trip(spark, tmp_path):
    long, longer = "x" * 1000, "é" * 500  # 1000 bytes each
    rows = [(1, "http://a/", long), (2, "http://b/\r\nX: y", long), (9, None, long), (3, "http://c/", "short"), (4, "", "short"), (5, "u", None),
            (6, "u", longer), (-7, "u", longer), (8, "u", "WARC/1.1\r\n\r\n" * 200), (9, None, long), (None, "u", "n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    folder, index = warc.archive(pages, f"file://{tmp_path}/bundles", frame_bytes=900, bundle_bytes=2500)
    assert index.count() == len(rows) and len(list((tmp_path / "bundles").glob("*.warc.zst"))) > 1
    got = warc.read_archive(spark, folder, index).collect()
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        best = max([j for j, _, h in rows if h == html and j is not None], default=None) if len(raw) >= 1000 else None
        refers = best if best is not None and i < best else None
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if refers is not None else "response", refers, "" if refers is not None else raw.decode()))
    assert sorted(map(str, want)) == sorted(str((*tuple(r)[:5], r.payload)) for r in got)
    for entry in index.collect():
        head, body = warc.fetch(folder, entry.asDict())
        assert head["WARC-Record-ID"] == f"<{entry.record_id}>" and len(body) == int(head["Content-Length"])
    folder, index = warc.archive(pages.limit(0), f"file://{tmp_path}/none")
    assert warc.read_archive(spark, folder, index).count() == 0


def test_bundle_is_plain_zstandard_with_a_seek_table(spark, tmp_path):
    import io

    import zstandard

    out = io.BytesIO()
    bundle = warc.Bundle(out, 100)
    places = [bundle.add(bytes([65 + i]) * 60) for i in range(5)]
    bundle.close()
    assert places == [(i, 0) for i in range(5)]
    table = warc.seek_table(out)
    assert b"".join(warc.read_frame(out, e) for e in table) == b"".join(bytes([65 + i]) * 60 for i in range(5))
    out.seek(0)
    assert len(zstandard.ZstdDecompressor().stream_reader(out, read_across_frames=True).read()) == 300
