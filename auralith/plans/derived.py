"""Inputs derived from the driver tables, identically in Spark and in the DuckDB oracle.

* utterances: every line of every ``documents.text`` (the whole text, all lines) is one reference transcript.
* hypothesis: a deterministic text-corrupting predictor (stands in for the ASR model of the reference): for the
  1-based word position ``i`` of the line split on single spaces, drop the word when ``(i + doc_id) % 11 = 0``,
  replace it by ``zz`` when ``(i + doc_id) % 7 = 0``, repeat it when ``(i + line_no) % 13 = 0``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def utterances(documents: DataFrame) -> DataFrame:
    """One row per line of every document. Lines stay in their scan splits; only a table with fewer splits than the
    cluster's parallelism (a small single file) has its lines dealt out."""
    utts = documents.select(
        "doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "reference_raw")
    ).withColumn("line_no", F.col("line_no").cast("long"))
    from auralith.operators.ordering import balance

    return balance(utts, "doc_id", "line_no")


def corrupt_line(line: Column, doc_id: Column, line_no: Column) -> Column:
    def word(w: Column, i0: Column) -> Column:
        i = i0 + 1
        return (
            F.when((i + doc_id) % 11 == 0, F.lit(None).cast("string"))
            .when((i + doc_id) % 7 == 0, F.lit("zz"))
            .when((i + line_no) % 13 == 0, F.concat(w, F.lit(" "), w))
            .otherwise(w)
        )

    return F.array_join(F.filter(F.transform(F.split(line, " "), word), lambda x: x.isNotNull()), " ")


def with_hypothesis(utts: DataFrame) -> DataFrame:
    from auralith.operators.ordering import compute_once

    return compute_once(utts, prediction_raw=corrupt_line(F.col("reference_raw"), F.col("doc_id"), F.col("line_no")))


# ---- the same derivations in DuckDB SQL (oracle side) -----------------------------------------------------------
SQL_UTTERANCES = """
  SELECT doc_id, lang, source, unnest(range(len(parts))) AS line_no, unnest(parts) AS reference_raw
  FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS parts FROM documents)
"""

SQL_CORRUPT = """array_to_string(list_filter(list_transform(string_split(reference_raw, ' '), lambda w, i:
    CASE WHEN (i + doc_id) % 11 = 0 THEN NULL
         WHEN (i + doc_id) % 7 = 0 THEN 'zz'
         WHEN (i + line_no) % 13 = 0 THEN w || ' ' || w
         ELSE w END), lambda x: x IS NOT NULL), ' ')"""
