"""Sources (S1-S16, M5). Schemas are declared, never inferred; every reader returns a DataFrame.

Line order (needed by "duplicate key: last wins") is carried as ``(file, split offset, line_pos)``: Spark's text scan
emits the rows of one split in file order and ``monotonically_increasing_id`` increases within a partition, while
``input_file_block_start`` orders the splits of a file by byte offset, however splits are packed into partitions.
"""

from __future__ import annotations

import io
import tarfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auralith.operators import cleaning as C
from auralith.operators.joins import dedup_last
from auralith.sources.tarshards import sound, tar_index

# Files per subset of the sharded corpus catalog.
SUBSET_SHARDS = {"tiny": 1, "small": 12, "medium": 116, "large": 579, "all": 4095}

METRIC_SCHEMA = (
    "model STRING, dataset STRING, dataset_config STRING, dataset_split STRING, chunk_length_s INT, language STRING, "
    "task STRING, punctuator BOOLEAN, stable_ts BOOLEAN, cer_raw DOUBLE, wer_raw DOUBLE, cer_norm DOUBLE, "
    "wer_norm DOUBLE, translation_model STRING"
)
RUNTIME_SCHEMA = (
    "model STRING, attention STRING, device STRING, duration INT, translation_model STRING, "
    "`time (mean)` DOUBLE, `time (std)` DOUBLE, `time (all)` ARRAY<DOUBLE>"
)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(
        F.input_file_name().alias("file"), F.input_file_block_start().alias("block"),
        F.monotonically_increasing_id().alias("line_pos"), "value")


def read_manifest_tsv(spark: SparkSession, path: str, last_wins: bool = True) -> DataFrame:
    """``name<TAB>transcription`` lines; any other arity fails the job; duplicate name -> last line wins."""
    parts = F.split(F.col("value"), "\t")
    rows = _lines(spark, path).select(
        "file", "block", "line_pos",
        F.when(F.size(parts) == 2, parts.getItem(0)).otherwise(
            F.raise_error(F.concat(F.lit("manifest line without exactly two tab-separated fields: "), F.col("value")))
        ).alias("name"),
        parts.getItem(1).alias("transcription"),
    )
    if not last_wins:
        return rows.select("name", "transcription")
    ordered = rows.withColumn("_order", F.struct("file", "block", "line_pos"))
    return dedup_last(ordered, "name", "_order", ["transcription"])


def _tar_members(pdf_iter, with_bytes: bool):
    """Members of each shard, emitted one shard at a time (output memory is bounded by one shard)."""
    cols = ["shard", "member", "bytes", "size", "status"]
    for pdf in pdf_iter:
        for path, content in zip(pdf["path"], pdf["content"]):
            out = []
            try:
                with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as tf:
                    for m in tf:
                        if not m.isfile():
                            continue
                        data = tf.extractfile(m).read()
                        out.append((path, m.name.lstrip("./"), data if with_bytes else None, len(data), "ok"))
            except Exception as e:  # noqa: BLE001 - unreadable shard: reported (M5), the job goes on
                out.append((path, None, None, 0, f"unreadable: {type(e).__name__}"))
            yield pd.DataFrame(out, columns=cols)


TAR_SCHEMA = "shard STRING, member STRING, bytes BINARY, size LONG, status STRING"


def read_tar_shards(spark: SparkSession, directory: str, with_bytes: bool = True, on_broken: str = "fail") -> DataFrame:
    """Every member of every ``*.tar`` under ``directory``: (shard, member name without leading ``./``, bytes).

    One shard is one ``binaryFile`` row (Spark's per-file limit is 2 GB); Arrow batches carry one shard at a time. A shard that
    cannot be read, or breaks off, fails the read; with ``on_broken="report"`` it gives its sound members and a row without a
    member whose status names the problem. ``tarshards.read_tar_members`` reads shards of any size in byte ranges."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar").option("recursiveFileLookup", "true").load(directory)
    members = files.select("path", "content").mapInPandas(lambda it: _tar_members(it, with_bytes), TAR_SCHEMA)
    return sound(members.withColumnRenamed("path", "shard"), on_broken)


def audit_shards(spark: SparkSession, directory: str, expected: DataFrame) -> DataFrame:
    """M5 + F14 + J6: per expected shard name: missing / unreadable / truncated / ok with its number of sound members, from
    the headers alone."""
    seen = tar_index(spark, directory)
    per_shard = seen.groupBy(F.substring_index("shard", "/", -1).alias("shard")).agg(
        F.count("member").alias("members"), F.max(F.when(F.col("status") != "ok", F.col("status"))).alias("problem"))
    j = expected.join(per_shard, "shard", "left")
    status = F.when(F.col("members").isNull() & F.col("problem").isNull(), F.lit("missing")).when(
        F.col("problem").isNotNull(), F.col("problem")).otherwise(F.lit("ok"))
    return j.select("shard", status.alias("status"), F.coalesce("members", F.lit(0)).alias("members"))


def shard_catalog(spark: SparkSession, subset: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """S4 + O6: shard file names ``{:03x}.tar`` of a subset, optionally the positional window ``[start:end]``."""
    n = SUBSET_SHARDS[subset]
    ids = spark.range(n)
    if start is not None or end is not None:
        ids = ids.where((F.col("id") >= (start or 0)) & (F.col("id") < (end if end is not None else n)))
    h = F.lower(F.hex("id"))
    return ids.select(F.col("id").alias("shard_idx"),
                      F.concat(F.when(F.length(h) >= 3, h).otherwise(F.lpad(h, 3, "0")), F.lit(".tar")).alias("shard"))


def read_config(spark: SparkSession, root: str, configs: str | list[str], split: str | None = None) -> DataFrame:
    """S3: one named table stored as parquet partitioned by ``config``/``split``; a comma list selects several
    configs (partition pruning reads only those directories)."""
    names = configs.split(",") if isinstance(configs, str) else list(configs)
    df = spark.read.parquet(root).where(F.col("config").isin([c.strip() for c in names]))
    return df.where(F.col("split") == split) if split is not None else df


def read_ami(spark: SparkSession, path: str, split: str) -> DataFrame:
    """AMI annotation lines; the text is blanked for the eval split."""
    df = C.parse_ami_line(spark.read.text(path), split)
    text = F.lit("") if split == "eval" else F.col("text")
    return df.select("id", text.alias("text"), "audio_filename", "well_formed")


def read_spgispeech(spark: SparkSession, path: str) -> DataFrame:
    """Pipe-separated metadata with a header."""
    return spark.read.option("sep", "|").option("header", "true").schema(
        "wav_filename STRING, wav_filesize LONG, transcript STRING").csv(path)


def read_voxpopuli_meta(spark: SparkSession, meta_path: str) -> DataFrame:
    """TSV keyed by ``id``, text lower-cased."""
    meta = spark.read.option("sep", "\t").option("header", "true").schema(
        "id STRING, raw_text STRING, normalized_text STRING, speaker_id STRING").csv(meta_path)
    return meta.select("id", F.lower("normalized_text").alias("text"))


def read_voxpopuli(spark: SparkSession, meta_path: str, shard_counts_json: str, lang: str, split: str) -> tuple[DataFrame, DataFrame]:
    """TSV keyed by ``id`` (text lower-cased) plus the shard list from ``{lang: {split: n}}``."""
    meta = read_voxpopuli_meta(spark, meta_path)
    counts = spark.read.option("multiLine", "true").json(shard_counts_json)
    n = counts.select(F.col(f"`{lang}`.`{split}`").alias("n"))
    shards = n.select(F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("shard_idx"))
    return meta, shards


def read_librispeech(spark: SparkSession, path: str) -> DataFrame:
    """``.trans.txt`` lines ``<id> <text>``, text lower-cased."""
    return C.parse_librispeech_line(spark.read.text(path)).select("id", "text")


def read_common_voice(spark: SparkSession, path: str, clips_dir: str) -> DataFrame:
    """TSV without quoting; ``.mp3`` appended when missing; ``accents`` -> ``accent``; missing columns -> ''."""
    df = spark.read.option("sep", "\t").option("header", "true").option("quote", "").csv(path)
    for c in ("client_id", "path", "sentence", "up_votes", "down_votes", "age", "gender", "accents", "locale", "segment"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(""))
    df = df.withColumnRenamed("accents", "accent")
    df = df.fillna("")
    return df.withColumn("path", C.common_voice_path("path", clips_dir))


def read_stm(spark: SparkSession, path: str) -> DataFrame:
    """STM lines ``fn channel speaker start end label transcript``."""
    return C.parse_stm(spark.read.text(path)).drop("value")


def read_gigaspeech(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Per-shard CSV metadata keyed by ``sid``, with the shard file each row came from."""
    df = spark.read.option("header", "true").schema("sid STRING, text_tn STRING, begin_time DOUBLE, end_time DOUBLE").csv(paths)
    return df.withColumn("shard", F.input_file_name())


def read_earnings22(spark: SparkSession, path: str) -> DataFrame:
    """``file,sentence,source_id``."""
    return spark.read.option("header", "true").schema("file STRING, sentence STRING, source_id STRING").csv(path)


def _nan_to_null(df: DataFrame) -> DataFrame:
    """The metric log carries the *string* ``"nan"`` as well as real NaN/null: all become NULL."""
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            df = df.withColumn(f.name, F.when(F.lower(c) == "nan", F.lit(None)).otherwise(c))
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            df = df.withColumn(f.name, F.when(F.isnan(c), F.lit(None)).otherwise(c))
    return df


def read_metric_log(spark: SparkSession, path: str) -> DataFrame:
    """Metric JSONL (blank lines skipped) with a declared schema and a file position for stable ordering
    (``file_pos`` = (file, split offset, row): comparable, and robust to how splits are packed)."""
    df = spark.read.schema(METRIC_SCHEMA).json(path)
    pos = F.struct(F.input_file_name().alias("file"), F.input_file_block_start().alias("block"),
                   F.monotonically_increasing_id().alias("row"))
    return _nan_to_null(df).withColumn("file_pos", pos)


def read_runtime_log(spark: SparkSession, path: str) -> DataFrame:
    """Runtime JSONL, renamed to ``time_mean``/``time_std``/``time_all``."""
    df = spark.read.schema(RUNTIME_SCHEMA).json(path)
    return _nan_to_null(df).select(
        "model", "attention", "device", "duration", "translation_model",
        F.col("`time (mean)`").alias("time_mean"), F.col("`time (std)`").alias("time_std"), F.col("`time (all)`").alias("time_all"))


def cached_or_compute(spark: SparkSession, path: str, compute, fmt: str = "parquet") -> DataFrame:
    """S14 + K4: reuse a prediction table that was written to its end (it holds ``_SUCCESS``), otherwise compute, write
    and read it back; what a broken run left is replaced."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(jvm.org.apache.hadoop.fs.Path(hpath, "_SUCCESS")):
        compute().write.format(fmt).mode("overwrite").save(path)
    return spark.read.format(fmt).load(path)


def config_names(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """S15 + A10 + W2: distinct names matched by ``pattern`` (group 1) in a text file, densely numbered in
    lexicographic order."""
    names = spark.read.text(path).select(F.explode(F.regexp_extract_all("value", F.lit(pattern), F.lit(1))).alias("name")).distinct()
    from auralith.operators.ordering import dense_index

    return dense_index(names, ["name"], name="idx")


BENCHMARK_SCHEMA = ["id", "text", "dataset", "audio_path"]


def route_corpus(loaders: dict[str, callable], names: list[str]) -> DataFrame:
    """Each config name selects its loader; all return the benchmark schema and are unioned by name."""
    frames = []
    for n in names:
        df = loaders[n]()
        frames.append(df.select(*[F.col(c) for c in BENCHMARK_SCHEMA]))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def is_additional(name: Column) -> Column:
    """``_additional`` suffix for the s/m/l/xl subsets."""
    return F.when(name.isin("s", "m", "l", "xl"), F.lit("_additional")).otherwise(F.lit(""))


__all__ = [n for n in dir() if n.startswith("read_")] + [
    "audit_shards", "shard_catalog", "cached_or_compute", "config_names", "route_corpus", "is_additional"]
