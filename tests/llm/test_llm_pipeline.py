"""The pipeline's stages on planted cases, and the whole run."""

import random
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline as pipeline

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n):
    rng = random.Random(seed)
    return [f"{rng.choice('bcdfgh')}{rng.choice('aeiou')}{rng.randrange(4000)}" for _ in range(n)]


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], SCHEMA)


def test_stages_and_registration():
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_duplicates", "substring_dedup", "source_mix", "packing"]
    assert entry.queries()["pipeline"] is pipeline.run and pipeline.ORACLE_SQL is None
    assert {f"op{n}" for n in range(1, 11)} <= {q.split("_")[0] for q in entry.queries()}


def test_toxicity_stage_drops_toxic_and_keeps_clean(spark, tmp_path):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(900):
        words, toxic = prose(i, rng.randrange(20, 90)), rng.random() < 0.15
        if toxic:
            words[3] = words[9] = rng.choice(["scoundrelous", "wretchedly"])
        rows.append((i, " ".join(words), "s"))
        labels.append((i, 1, int(toxic)))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").filter("doc_id % 2 = 0").write.parquet(f"{tmp_path}/labels.parquet")
    out = pipeline.drop_toxic(spark, documents(spark, rows), str(tmp_path))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept, toxic = {r.doc_id for r in out.collect()}, {i for i, _, t in labels if t}
    assert len(kept & toxic) <= 0.03 * len(toxic) and len(kept - toxic) >= 0.98 * (900 - len(toxic))


def test_near_duplicate_stage_keeps_one_of_each_group(spark):
    rows = [(i, " ".join(prose(i, 80)), "s") for i in range(30)]
    for i in range(10):
        near = prose(i, 80)
        near[40] = "changed"
        rows += [(100 + i, " ".join(near), "s"), (200 + i, rows[i][1], "t")]
    rows += [(5, rows[5][1], "s"), (300, None, "s"), (301, "", "s"), (None, "alone here", "s")]
    out = pipeline.drop_near_duplicates(spark, documents(spark, rows), SF)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted([*map(str, range(30)), "300", "301", "None"])


def test_near_duplicate_stage_keeps_unrelated_rows_of_one_id_and_drops_copies_without_ids(spark):
    texts = [" ".join(prose(i, 60)) for i in range(8)]
    rows = [(1, texts[0], "s"), (1, texts[1], "t"), (1, texts[2], "s"), (2, texts[1], "s"), (3, texts[3], "s"), (3, texts[3], "s"),
            (None, texts[4], "s"), (None, texts[4], "t"), (None, texts[5], "s"), (9, texts[5], "s"), (None, None, "s"), (None, None, "s"),
            (7, "", "s"), (7, " ", "s"), (8, texts[6], "s")]
    out = pipeline.drop_near_duplicates(spark, documents(spark, rows), SF).collect()
    assert sorted(str((r.doc_id, r.text)) for r in out) == sorted(str(x) for x in [
        (1, texts[0]), (1, texts[1]), (1, texts[2]), (3, texts[3]), (None, texts[4]), (None, texts[5]), (None, None), (None, None),
        (7, ""), (7, " "), (8, texts[6])])


def test_toxicity_stage_scores_rows_of_a_repeated_id_by_their_own_texts(spark, tmp_path):
    rows, labels = [], []
    for i in range(400):
        words = prose(i, 40)
        if i % 5 == 0:
            words[3] = words[9] = words[20] = "scoundrelous"
        rows.append((i, " ".join(words), "s"))
        labels.append((i, 1, int(i % 5 == 0)))
    rows += [(1, " ".join(["scoundrelous", *prose(900, 30), "scoundrelous"]), "s"), (1, None, "s"), (None, " ".join(prose(901, 30)), "s")]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = [(r.doc_id, r.text) for r in pipeline.drop_toxic(spark, documents(spark, rows), str(tmp_path)).collect()]
    assert {(1, rows[1][1]), (1, None), (None, rows[-1][1])} <= set(out) and (1, rows[400][1]) not in out


def test_substring_stage_cuts_long_passages_only(spark):
    passage, short = prose(77, 60), prose(78, 30)
    rows = [(i, "\n".join([" ".join(prose(i, 20)), " ".join(passage if i < 3 else short)]), "s") for i in range(6)] + [(9, None, "s")]
    got = {r.doc_id: r for r in pipeline.cut_repeated_passages(spark, documents(spark, rows), SF).collect()}
    assert got[0].text == rows[0][1] and got[3].text == rows[3][1] and got[5].text == rows[5][1] and got[9].text is None
    for i in (1, 2):
        assert got[i].text == " ".join(prose(i, 20)) and got[i].n_chars == len(got[i].text)


def test_mix_and_packing_stages(spark):
    rows = [(i, " ".join(prose(i, 30 + i % 7)), f"s{i % 3}") for i in range(300)]
    mixed = pipeline.mix(spark, documents(spark, rows), SF)
    assert mixed.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    words = {s: sum(len(r.text.split()) for r in mixed.filter(f"source = '{s}'").collect()) for s in ("s0", "s1", "s2")}
    total = sum(len(t.split()) for _, t, _ in rows)
    for s, weight in (("s0", 1), ("s1", 2), ("s2", 3)):
        assert words[s] == pytest.approx(total * weight / 6, abs=40)
    packed = pipeline.pack(spark, mixed, SF).collect()
    assert len(packed) == mixed.count()
    bins = {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert bins.get(r.sequence_id, 0) == r.offset
        bins[r.sequence_id] = r.offset + r.length
    assert max(bins.values()) <= 4096


def test_packing_stage_carries_the_tokens(spark):
    from tokenizers import Tokenizer

    rows = [(i, " ".join(prose(i, n)), "s") for i, n in enumerate((3, 40, 9000))] + [(7, None, "s")]
    tokenizer, got = Tokenizer.from_file(pipeline.tokenizer_path()), {}
    for r in sorted(pipeline.pack(spark, documents(spark, rows), SF).collect(), key=lambda r: (r.doc_id, r.start)):
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
        got[r.doc_id] = got.get(r.doc_id, []) + np.frombuffer(r.ids, "<u4").tolist()
    assert got == {d: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for d, t, _ in rows}


def test_whole_pipeline_equals_its_stages(spark):
    out = pipeline.run(spark, SF)
    rows = out.collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert rows and sorted(map(str, rows)) == sorted(map(str, docs.collect()))


def test_empty_documents(spark):
    docs = documents(spark, []) if False else spark.createDataFrame([], SCHEMA)
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0, name
