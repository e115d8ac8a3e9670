"""Tar shard queries: documents written as shards, read back by member index in byte ranges (S2, X4), and an audit of
shards of which some are broken and some are not there (M5, F14)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auralith.plans.tables import table
from auralith.session import ensure_checkpoint_dir
from auralith.sources import readers as R
from auralith.sources import tarshards as TS

PER_SHARD = 100


def _folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def tar_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is a member ``./source/id.txt``; shards of about 1 MB, read in ranges of 256 KB."""
    folder = _folder(spark, "tars")
    docs = table(spark, sf_dir, "documents")
    member = F.concat(F.lit("./"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    TS.write_tar_shards(docs.select(member.alias("member"), F.col("text").cast("binary").alias("bytes")), folder, shard_bytes=1 << 20)
    members = TS.read_tar_members(spark, folder, task_bytes=1 << 18)
    return members.select("member", "size", F.sha2("bytes", 256).alias("sha256"))


def _halve(folder: str):
    def cut(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for name in frame.column("shard").to_pylist():
                store, root = TS._store(folder)
                with store.open_input_file(f"{root}/{name}") as whole, store.open_output_stream(f"{root}/{name}.half") as half:
                    left = whole.size() // 2
                    while left:
                        data = whole.read(min(left, 1 << 20))
                        half.write(data)
                        left -= len(data)
                store.move(f"{root}/{name}.half", f"{root}/{name}")
            yield frame

    return cut


def tar_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred documents (by id) to a shard ``{:03x}.tar``, members in order of their ids; every seventh shard is cut off
    half-way, and two more are expected than there are."""
    folder = _folder(spark, "tars")
    docs = table(spark, sf_dir, "documents").withColumn("number", F.floor(F.col("doc_id") / PER_SHARD))

    def named(number):
        digits = F.lower(F.hex(number))
        return F.concat(F.when(F.length(digits) < 3, F.lpad(digits, 3, "0")).otherwise(digits), F.lit(".tar"))

    member = F.concat(F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(".txt"))
    TS.write_tar_shards(docs.select(member.alias("member"), F.col("text").cast("binary").alias("bytes"), named(F.col("number")).alias("shard")), folder)
    shards = docs.select("number").distinct()
    broken = shards.filter("number % 7 = 3").select(named(F.col("number")).alias("shard"))
    broken.mapInArrow(_halve(folder), "shard string").write.format("noop").mode("overwrite").save()
    beyond = shards.agg(F.max("number").alias("most")).select(F.explode(F.array(F.col("most") + 1, F.col("most") + 2)).alias("number"))
    expected = shards.unionByName(beyond).select(named(F.col("number")).alias("shard"))
    return R.audit_shards(spark, folder, expected)


SQL = {
    "tar_round_trip": """SELECT source || '/' || doc_id || '.txt' AS member, octet_length(encode(text))::BIGINT AS size, sha256(text) AS sha256
FROM documents""",
    "tar_audit": f"""WITH d AS (SELECT doc_id // {PER_SHARD} AS number, doc_id, octet_length(encode(text)) AS size FROM documents),
p AS (SELECT *, sum(512 + (size + 511) // 512 * 512) OVER (PARTITION BY number ORDER BY doc_id) - (size + 511) // 512 * 512 AS place FROM d),
s AS (SELECT number, (sum(512 + (size + 511) // 512 * 512) + 1024 + 10239) // 10240 * 10240 // 2 AS half FROM d GROUP BY number),
a AS (SELECT p.number, CASE WHEN p.number % 7 = 3 THEN 'truncated: ReadError' ELSE 'ok' END AS status,
             count(*) FILTER (p.number % 7 <> 3 OR place + size <= half) AS members FROM p JOIN s ON p.number = s.number GROUP BY p.number),
m AS (SELECT max(number) AS most FROM d)
SELECT printf('%03x', number) || '.tar' AS shard, status, members::BIGINT AS members FROM a
UNION ALL SELECT printf('%03x', most + i) || '.tar', 'missing', 0 FROM m, (VALUES (1), (2)) v(i)""",
}
