"""Sources and sinks on small files written by the tests."""

import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from auralith.sources import readers as R
from auralith.sources import sinks as K


def _write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def test_manifest_last_wins_and_arity(spark, tmp_path):
    p = _write(tmp_path / "t.tsv", "a\tfirst\nb\tonly\na\tsecond\n")
    got = sorted(tuple(r) for r in R.read_manifest_tsv(spark, str(p)).collect())
    assert got == [("a", "second"), ("b", "only")]
    bad = _write(tmp_path / "bad.tsv", "a\tb\tc\n")
    with pytest.raises(Exception):
        R.read_manifest_tsv(spark, str(bad)).collect()


def _tar(path, members):
    with tarfile.open(path, "w") as tf:
        for name, data in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tf.addfile(info, io.BytesIO(data))


def test_tar_shards_and_audit(spark, tmp_path):
    _tar(tmp_path / "000.tar", {"./x/a.flac": b"aaa", "b.flac": b"bb"})
    _tar(tmp_path / "001.tar", {"c.flac": b"c"})
    (tmp_path / "002.tar").write_bytes(b"this is not a tar file")
    with pytest.raises(Exception, match="broken shard"):
        R.read_tar_shards(spark, str(tmp_path)).collect()
    rows = R.read_tar_shards(spark, str(tmp_path), on_broken="report").collect()
    assert [r.shard[-7:] for r in rows if r.status != "ok"] == ["002.tar"]
    members = sorted((r.member, r.size) for r in rows if r.status == "ok")
    assert members == [("b.flac", 2), ("c.flac", 1), ("x/a.flac", 3)]
    expected = R.shard_catalog(spark, "small")  # 000.tar .. 00b.tar
    audit = {r.shard: (r.status, r.members) for r in R.audit_shards(spark, str(tmp_path), expected).collect()}
    assert audit["000.tar"] == ("ok", 2) and audit["001.tar"] == ("ok", 1)
    assert audit["002.tar"][0].startswith("unreadable") and audit["00b.tar"] == ("missing", 0)


def test_shard_catalog_names(spark):
    names = [r.shard for r in R.shard_catalog(spark, "all").orderBy("shard_idx").collect()]
    assert names[:2] == ["000.tar", "001.tar"] and names[-1] == "ffe.tar" and len(names) == 4095
    assert [r.shard for r in R.shard_catalog(spark, "all", 10, 12).orderBy("shard_idx").collect()] == ["00a.tar", "00b.tar"]


def test_config_roundtrip_dynamic_overwrite(spark, tmp_path):
    root = str(tmp_path / "tbl")
    K.write_config(spark.range(3).withColumn("v", F.lit("a")), root, "tiny")
    K.write_config(spark.range(2).withColumn("v", F.lit("b")), root, "small")
    K.write_config(spark.range(5).withColumn("v", F.lit("c")), root, "tiny")  # replaces only config=tiny
    df = R.read_config(spark, root, "tiny,small", "train")
    assert sorted((r.config, r.n) for r in df.groupBy("config").agg(F.count("*").alias("n")).collect()) == [("small", 2), ("tiny", 5)]
    K.write_chunks(spark.range(4).withColumn("chunk_id", F.col("id") % 2), str(tmp_path / "ch"), "all")
    assert spark.read.parquet(str(tmp_path / "ch")).select("chunk_id").distinct().count() == 2


def test_text_formats(spark, tmp_path):
    ami = _write(tmp_path / "ami.txt", "AMI_ES2004a_H00_MEE018_0000123_0000456  hello   there\n")
    r = R.read_ami(spark, str(ami), "train").first()
    assert (r.id, r.text, r.audio_filename, r.well_formed) == ("AMI_ES2004a_H00_MEE018_0000123_0000456", "hello there",
                                                               "train_ami_es2004a_h00_mee018_0000123_0000456.wav", True)
    libri = _write(tmp_path / "x.trans.txt", "84-121-0000 GO DO YOU HEAR\n")
    assert tuple(R.read_librispeech(spark, str(libri)).first()) == ("84-121-0000", "go do you hear")
    stm = _write(tmp_path / "a.stm", "talk 1 spk 0.5 1.5 <o,f0,male> it 's fine (k1)\n")
    s = R.read_stm(spark, str(stm)).first()
    assert (s.fn, s.start, s.transcript) == ("talk", "0.5", "it 's fine (k1)")
    spgi = _write(tmp_path / "s.csv", "wav_filename|wav_filesize|transcript\na.wav|12|Hello, world\n")
    assert R.read_spgispeech(spark, str(spgi)).first().transcript == "Hello, world"
    cv = _write(tmp_path / "cv.tsv", 'client_id\tpath\tsentence\naa\tclip1\t"quoted" text\n')
    c = R.read_common_voice(spark, str(cv), "clips").first()
    assert (c.path, c.sentence, c.accent) == ("clips/clip1.mp3", '"quoted" text', "")
    earn = _write(tmp_path / "e.csv", "file,sentence,source_id\nf1,<noise> yes,4420696\n")
    assert R.read_earnings22(spark, str(earn)).first().source_id == "4420696"
    vox = _write(tmp_path / "v.tsv", "id\traw_text\tnormalized_text\tspeaker_id\nv1\tHi\tHI THERE\ts\n")
    counts = _write(tmp_path / "n.json", json.dumps({"en": {"test": 3}}))
    meta, shards = R.read_voxpopuli(spark, str(vox), str(counts), "en", "test")
    assert meta.first().text == "hi there" and shards.count() == 3
    giga = _write(tmp_path / "g.csv", "sid,text_tn,begin_time,end_time\ns1,HELLO <COMMA> WORLD,0.0,1.0\n")
    assert R.read_gigaspeech(spark, str(giga)).first().shard.endswith("g.csv")


def test_metric_log_nan_and_compaction(spark, tmp_path):
    lines = [
        {"model": "m", "dataset": "d", "dataset_config": None, "dataset_split": "test", "chunk_length_s": 15,
         "language": "ja", "task": "transcribe", "punctuator": None, "stable_ts": None, "cer_raw": 1.0, "wer_raw": 2.0,
         "cer_norm": 3.0, "wer_norm": 4.0, "translation_model": "nan"},
        {"model": "m", "dataset": "d", "dataset_config": None, "dataset_split": "test", "chunk_length_s": 15,
         "language": "ja", "task": "transcribe", "punctuator": None, "stable_ts": None, "cer_raw": 9.0, "wer_raw": 9.0,
         "cer_norm": 9.0, "wer_norm": 9.0},
    ]
    p = _write(tmp_path / "metric.jsonl", "\n".join(json.dumps(x) for x in lines) + "\n\n")
    log = R.read_metric_log(spark, str(p))
    assert log.where(F.col("translation_model").isNull()).count() == 2
    from auralith.operators.board import compact_metric_log

    compacted = compact_metric_log(log, "ja", "transcribe")
    assert [r.cer_raw for r in compacted.collect()] == [1.0]
    out = K.compact_log(spark, compacted, str(tmp_path / "logs"))
    assert spark.read.json(out).count() == 1 and out != str(p)


def test_predictions_cache_and_upsert(spark, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        return spark.createDataFrame([("id1", "a", "a", "A", "A")], "id string, reference_norm string, prediction_norm string, reference_raw string, prediction_raw string")

    path = K.write_predictions(compute(), str(tmp_path / "pred"), {"model": "m", "stable_ts": "true", "punctuator": "false"})
    assert "punctuator=false/stable_ts=true" in path
    again = R.cached_or_compute(spark, path, compute)
    assert again.count() == 1 and len(calls) == 1
    existing = spark.createDataFrame([("a", 1)], "k string, v int")
    cand = spark.createDataFrame([("a",), ("b",)], "k string")
    up = K.upsert_report(existing, cand, "k", lambda todo: todo.withColumn("v", F.lit(2)))
    assert sorted(tuple(r) for r in up.collect()) == [("a", 1), ("b", 2)]


def test_config_names(spark, tmp_path):
    p = _write(tmp_path / "README.md", "use subset_10.0 and subset_2.0\nthen subset_10.0 again, also subset_1.1\n")
    got = sorted((r.name, r.idx) for r in R.config_names(spark, str(p), r"(subset_\d+\.\d+)").collect())
    assert got == [("subset_1.1", 0), ("subset_10.0", 1), ("subset_2.0", 2)]


def test_streamed_tar_reader_matches_binaryfile(spark, tmp_path):
    from auralith.sources.tarshards import read_tar_members, read_tar_shards_streamed

    _tar(tmp_path / "000.tar", {"./x/a.flac": b"aaa", "b.flac": b"bb"})
    _tar(tmp_path / "001.tar", {"c.flac": b"c"})
    (tmp_path / "002.tar").write_bytes(b"this is not a tar file")
    def got(rows):
        rows = rows.collect()
        assert [r.shard[-7:] for r in rows if r.member is None] == ["002.tar"]
        return sorted((r.member, r.size, bytes(r.bytes)) for r in rows if r.member is not None)

    a = got(R.read_tar_shards(spark, str(tmp_path), on_broken="report"))
    b = got(read_tar_shards_streamed(spark, str(tmp_path), on_broken="report"))
    c = got(read_tar_members(spark, str(tmp_path), task_bytes=600, on_broken="report"))
    assert a == b == c == [("b.flac", 2, b"bb"), ("c.flac", 1, b"c"), ("x/a.flac", 3, b"aaa")]


def test_manifest_last_wins_across_splits(spark, tmp_path):
    """A manifest split into many small input splits still resolves duplicates by file position."""
    lines = [f"k{i % 50}\tv{i}" for i in range(4000)]
    p = _write(tmp_path / "big.tsv", "\n".join(lines) + "\n")
    prev = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = dict(tuple(r) for r in R.read_manifest_tsv(spark, str(p)).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", prev)
    assert got == {f"k{k}": f"v{3950 + k}" for k in range(50)}


def test_route_corpus_and_additional(spark):
    a = lambda: spark.createDataFrame([("1", "hi", "/a.wav", "ami")], "id string, text string, audio_path string, dataset string")
    b = lambda: spark.createDataFrame([("/b.wav", "2", "ted", "yo", 7)], "audio_path string, id string, dataset string, text string, extra int")
    out = R.route_corpus({"ami": a, "tedlium": b}, ["ami", "tedlium"])
    assert out.columns == R.BENCHMARK_SCHEMA and sorted(r.dataset for r in out.collect()) == ["ami", "ted"]
    df = spark.createDataFrame([("s",), ("xl",), ("dev",)], "n string")
    assert [r.o for r in df.select(R.is_additional(F.col("n")).alias("o")).collect()] == ["_additional", "_additional", ""]


def test_half_broken_shards_keep_their_sound_members_and_say_so(spark, tmp_path):
    from auralith.sources import tarshards as TS

    _tar(tmp_path / "000.tar", {f"m{i}": bytes([i]) * 700 for i in range(5)})
    whole = (tmp_path / "000.tar").read_bytes()
    for name, size in (("001", 3000), ("002", 512 + 1024 + 512 + 300), ("003", 5 * 1536), ("004", 100), ("005", 0)):
        (tmp_path / f"{name}.tar").write_bytes(whole[:size])
    rows = TS.tar_index(spark, str(tmp_path)).collect()
    sound = {f"00{k}.tar": sorted(r.member for r in rows if r.shard.endswith(f"00{k}.tar") and r.status == "ok") for k in range(6)}
    assert [len(v) for v in sound.values()] == [5, 2, 1, 5, 0, 0]
    problems = {r.shard[-7:]: r.status.split(":")[0] for r in rows if r.status != "ok"}
    assert problems == {"001.tar": "truncated", "002.tar": "truncated", "003.tar": "truncated", "004.tar": "unreadable", "005.tar": "unreadable"}
    for read in (TS.read_tar_shards_streamed, TS.read_tar_members, R.read_tar_shards):
        with pytest.raises(Exception, match="broken shard"):
            read(spark, str(tmp_path)).collect()
    got = TS.read_tar_members(spark, str(tmp_path), task_bytes=2048, on_broken="report").collect()
    assert all(bytes(r.bytes) == bytes([int(r.member[1])]) * 700 for r in got if r.member) and len(got) == 18


def test_tar_writer_commits_whole_jobs_and_aborts_without_traces(spark, tmp_path):
    from auralith.sources import tarshards as TS

    folder = str(tmp_path / "out")
    rows = spark.range(100).selectExpr("concat('d/', id, '.txt') AS member", "cast(repeat('x', cast(id as int)) AS binary) AS bytes")
    TS.write_tar_shards(rows.repartition(4), folder, shard_bytes=400)
    names = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert "_SUCCESS" in names and sum(n.endswith(".tar") for n in names) > 8
    got = {r.member: len(r.bytes) for r in TS.read_tar_members(spark, folder, task_bytes=1000).collect()}
    assert got == {f"d/{i}.txt": i for i in range(100)}
    failing = rows.withColumn("bytes", F.when(F.col("member") == "d/99.txt", F.raise_error(F.lit("half-way"))).otherwise(F.col("bytes")).cast("binary"))
    with pytest.raises(Exception):
        TS.write_tar_shards(failing.repartition(4), folder)
    left = sorted(p.name for p in (tmp_path / "out").rglob("*") if p.is_file())
    assert left == names[:1] + [n for n in names if n.endswith(".tar")] or set(left) == {n for n in names if n != "_temporary"}
    TS.write_tar_shards(rows.limit(3), folder)  # appends
    assert TS.read_tar_members(spark, folder).count() == 103


def test_named_tar_shards(spark, tmp_path):
    from auralith.sources import tarshards as TS

    rows = spark.createDataFrame([("b", b"1", "x.tar"), ("a", b"22", "x.tar"), ("c", None, "y.tar")], "member string, bytes binary, shard string")
    TS.write_tar_shards(rows, str(tmp_path))
    index = [(r.shard.split("/")[-1], r.member, r.size) for r in TS.tar_index(spark, str(tmp_path)).orderBy("shard", "place").collect()]
    assert index == [("x.tar", "a", 2), ("x.tar", "b", 1), ("y.tar", "c", 0)]


def test_writes_do_not_touch_the_session_and_reads_prune_partitions(spark, tmp_path):
    before, root = spark.conf.get("spark.sql.sources.partitionOverwriteMode"), str(tmp_path / "t")
    K.write_config(spark.range(3), root, "a")
    K.write_config(spark.range(4), root, "b")
    K.write_config(spark.range(5), root, "b")
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == before
    got = R.read_config(spark, root, "b", "train")
    assert got.count() == 5 and R.read_config(spark, root, ["a", "b"]).count() == 8
    plan = spark._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "formatted")
    assert "PartitionFilters: [" in plan and "config" in plan.split("PartitionFilters: [")[1].split("]")[0]
