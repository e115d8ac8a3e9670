"""Manifest/lookup queries on documents (the members) and labels (the transcripts manifest): J1, J2, J5, J6, A15.

Manifest lines: one per labels row (``line_no = 2 * doc_id``) plus, for toxic rows, a later re-labelled line
(``line_no = 2 * doc_id + 1``) that must win (A15). Members: ``./<source>/doc_<id>.flac`` for every document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auralith.operators import joins as J
from auralith.plans.tables import table


def _manifest_lines(spark, sf_dir) -> DataFrame:
    lab = table(spark, sf_dir, "labels")
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("name")
    base = lab.select(name, F.concat(F.lit("q"), F.col("quality").cast("string"), F.lit("/t"), F.col("toxic").cast("string")).alias("transcription"),
                      (F.col("doc_id") * 2).alias("line_no"))
    relabel = lab.where(F.col("toxic") == 1).select(
        name, F.concat(F.lit("q"), F.col("quality").cast("string"), F.lit("/relabelled")).alias("transcription"),
        (F.col("doc_id") * 2 + 1).alias("line_no"))
    return base.unionByName(relabel)


def _members(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("./"), F.col("source"), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".flac"))
    return docs.select(path.alias("path"), "n_chars").withColumn("name", J.member_key(F.col("path")))


def manifest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = J.dedup_last(_manifest_lines(spark, sf_dir), "name", "line_no", ["transcription"])
    return J.manifest_join(_members(spark, sf_dir), manifest, "name").select("name", "path", "n_chars", "transcription")


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = J.dedup_last(_manifest_lines(spark, sf_dir), "name", "line_no", ["transcription"])
    return J.orphans(_members(spark, sf_dir), manifest, "name")


def strict_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every labels row must find its document (lang, source); a missing one fails the job."""
    lab = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents")
    return J.strict_lookup(lab, docs, "doc_id", ["lang", "source"], what="labels -> documents")


def split_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the split whose ids are the labels rows of quality 1."""
    split_ids = table(spark, sf_dir, "labels").where(F.col("quality") == 1)
    return J.in_split(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), split_ids, "doc_id")


_MANIFEST_SQL = """m AS (SELECT 'doc_' || doc_id AS name, 'q' || quality || '/t' || toxic AS transcription, doc_id * 2 AS line_no FROM labels
      UNION ALL SELECT 'doc_' || doc_id, 'q' || quality || '/relabelled', doc_id * 2 + 1 FROM labels WHERE toxic = 1),
md AS (SELECT name, arg_max(transcription, line_no) AS transcription FROM m GROUP BY name),
mem AS (SELECT './' || source || '/doc_' || doc_id || '.flac' AS path, n_chars,
               regexp_replace(split_part(regexp_replace('./' || source || '/doc_' || doc_id || '.flac', '^[./]+', ''), '/', -1), '\\.[^.]*$', '') AS name
        FROM documents)"""

SQL = {
    "manifest_join": f"WITH {_MANIFEST_SQL} SELECT mem.name, path, n_chars, transcription FROM mem JOIN md USING (name)",
    "orphans": f"""WITH {_MANIFEST_SQL}
SELECT DISTINCT name, 'member_without_transcript' AS side FROM mem WHERE name NOT IN (SELECT name FROM md)
UNION ALL SELECT DISTINCT name, 'transcript_without_member' FROM md WHERE name NOT IN (SELECT name FROM mem)""",
    "strict_lookup": "SELECT l.doc_id, l.quality, l.toxic, d.lang, d.source FROM labels l JOIN documents d USING (doc_id)",
    "split_semi": "SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
}
