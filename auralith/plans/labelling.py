"""Training-label queries over ``conversations`` (batch = conversation, row = turn): prompt conditioning (W1/L1-L3),
timestamp dropping (L2/T14/T15), batch padding (L7/L8/A11) and the decoder collation (L4-L6).

Teacher output per row: ``[SOT, en, transcribe, <|notimestamps|>] + ids + [EOT]``; every third row
(``(conv_id + turn) % 3 = 0``) instead carries timestamps ``[SOT, en, transcribe, <|0.00|>] + ids + [<|t|>, EOT, EOT]``.
Text ids are longest matches over a vocabulary table (T17). Draws are md5-seeded per row (O8), so reruns and both engines agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auralith.functions import labels as L
from auralith.functions import text as T
from auralith.operators import labels as LO
from auralith.operators import vocabulary as V
from auralith.operators.ordering import unit_draw
from auralith.plans.tables import table

P_TIMESTAMP = 0.2
P_PREV = 0.2
MAX_LABEL_LENGTH = 448


def _teacher(spark, sf_dir) -> DataFrame:
    conv = table(spark, sf_dir, "conversations")
    conv = conv.withColumn("text_ids", V.Vocabulary(V.letter_vocabulary(spark)).ids(F.col("text")))
    ids = F.col("text_ids")
    with_ts = F.concat(
        F.array(*[F.lit(x) for x in (L.SOT, L.LANG["en"], L.TRANSCRIBE, L.TIMESTAMP_FIRST)]), ids,
        F.array((F.lit(L.TIMESTAMP_FIRST) + F.least(F.size(ids), F.lit(L.TIMESTAMP_COUNT - 1))).cast("int"), F.lit(L.EOT), F.lit(L.EOT)),
    )
    plain = F.concat(L.task_prefix("en", "transcribe", timestamps=False), ids, F.array(F.lit(L.EOT)))
    teacher = F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, with_ts).otherwise(plain)
    return conv.select("conv_id", "turn", teacher.alias("teacher_ids"))


def _unprompted(spark, sf_dir) -> DataFrame:
    t = _teacher(spark, sf_dir)
    keep_ts = unit_draw(F.col("conv_id"), F.col("turn"), F.lit("ts")) < F.lit(P_TIMESTAMP)
    return t.select("conv_id", "turn", L.maybe_drop_timestamps(L.with_single_eot("teacher_ids"), keep_ts).alias("ids"))


def _prompted(spark, sf_dir) -> DataFrame:
    u = _unprompted(spark, sf_dir)
    cond = unit_draw(F.col("conv_id"), F.col("turn"), F.lit("prev")) < F.lit(P_PREV)
    return LO.prompt_with_previous(u, "conv_id", "turn", "ids", cond, MAX_LABEL_LENGTH)


def prompt_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1 + L2 + W1/L3 + F3: final labels of every row whose label length is in range."""
    p = _prompted(spark, sf_dir)
    return p.where(L.labels_in_range("labels", MAX_LABEL_LENGTH)).select("conv_id", "turn", "labels")


def token_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T17 over every whole document: its number of ids, the first sixteen, and the digest of the text read back from all."""
    vocabulary = V.Vocabulary(V.letter_vocabulary(spark))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = docs.withColumns({"ids": vocabulary.ids(F.col("text")), "first_ids": vocabulary.ids(F.col("text"), max_length=16)})
    return ids.select("doc_id", F.size("ids").alias("n_ids"), "first_ids", F.sha2(vocabulary.text(F.col("ids")), 256).alias("sha256"))


def drop_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T14 + L1 + L2 + T15: ids serialised as ``"[1 2 3]"`` text are parsed back, EOT normalised, timestamps
    removed (the no-timestamp branch) and the first timestamp token of the row spelled from the 1501-token vocab."""
    t = _teacher(spark, sf_dir).withColumn("as_text", F.concat(F.lit("["), F.array_join("teacher_ids", " "), F.lit("]")))
    parsed = F.when(T.is_bracketed(F.col("as_text")), T.int_list_from_text(F.col("as_text")))
    ids = L.with_single_eot(parsed)
    first_ts = F.try_element_at(F.filter(ids, lambda x: x >= L.TIMESTAMP_FIRST), F.lit(1))
    vocab = LO.timestamp_vocab(spark)  # 1501 rows, a fixed-size dimension
    out = t.select("conv_id", "turn", L.drop_timestamp_ids(ids).alias("ids"), first_ts.alias("ts_id"))
    return out.join(F.broadcast(vocab), "ts_id", "left").select("conv_id", "turn", "ids", "ts_token")


def batch_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L7 + L4 + A11/L8: pad to the longest labels of the batch with -100; drop the first column of the whole batch
    only when every row of the batch starts with SOT."""
    return LO.pad_batch(_prompted(spark, sf_dir), "conv_id", "labels", L.PAD_LABEL, drop_leading=L.SOT).select(
        "conv_id", "turn", "labels_padded")


def packed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L4-L7 decoder collation: pad with EOT to the batch's longest, inputs = [:-1], targets = [1:] with padding as
    -100 and the prompt (everything up to the first SOT of the targets) masked."""
    return LO.decoder_batch(_prompted(spark, sf_dir), "conv_id", "labels").select(
        "conv_id", "turn", "decoder_input_ids", "targets")


# ---- oracles ------------------------------------------------------------------------------------------------------
def _draw(tag: str) -> str:
    return f"(('0x' || substr(md5(conv_id || ':' || turn || ':{tag}'), 1, 8))::BIGINT / 4294967296.0)"


_IDS = V.letter_ids_sql("text")
_TEACHER = f"""CASE WHEN (conv_id + turn) % 3 = 0
  THEN list_concat([{L.SOT}, {L.LANG['en']}, {L.TRANSCRIBE}, {L.TIMESTAMP_FIRST}], {_IDS},
                   [({L.TIMESTAMP_FIRST} + least(len({_IDS}), {L.TIMESTAMP_COUNT - 1}))::INTEGER, {L.EOT}, {L.EOT}])
  ELSE list_concat([{L.SOT}, {L.LANG['en']}, {L.TRANSCRIBE}, {L.NOTIMESTAMPS}], {_IDS}, [{L.EOT}]) END"""


def _one_eot(x: str) -> str:
    return f"list_concat(list_filter({x}, lambda v: v <> {L.EOT}), [{L.EOT}])"


def _drop_ts(x: str) -> str:
    k = f"list_filter({x}, lambda v: v < {L.NOTIMESTAMPS})"
    return f"list_concat(list_slice({k}, 1, 3), [{L.NOTIMESTAMPS}], list_slice({k}, 4, len({k})))"


def _has_ts(x: str) -> str:
    return f"(len(list_filter({x}, lambda v: v >= {L.TIMESTAMP_FIRST} AND v < {L.TIMESTAMP_FIRST + L.TIMESTAMP_COUNT})) > 0)"


_PROMPT = f"""(CASE WHEN len(list_filter(prev, lambda v: v < {L.NOTIMESTAMPS})) > 0
  THEN list_concat([{L.PREV}], list_slice(list_filter(prev, lambda v: v < {L.NOTIMESTAMPS}), 4,
                                           len(list_filter(prev, lambda v: v < {L.NOTIMESTAMPS})) - 1))
  ELSE []::INTEGER[] END)"""

_PROMPTED = f"""t AS (SELECT conv_id, turn, {_one_eot(_TEACHER)} AS e FROM conversations),
u AS (SELECT conv_id, turn, CASE WHEN {_has_ts('e')} AND NOT ({_draw('ts')} < {P_TIMESTAMP}) THEN {_drop_ts('e')} ELSE e END AS ids FROM t),
pv AS (SELECT a.conv_id, a.turn, a.ids, b.ids AS prev FROM u a LEFT JOIN u b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1),
p AS (SELECT conv_id, turn, CASE WHEN {_draw('prev')} < {P_PREV} AND prev IS NOT NULL AND len({_PROMPT}) + len(ids) < {MAX_LABEL_LENGTH}
                                 THEN list_concat({_PROMPT}, ids) ELSE ids END AS labels FROM pv)"""

SQL = {
    "token_round_trip": f"""SELECT doc_id, len(ids)::INTEGER AS n_ids, list_slice(ids, 1, 16) AS first_ids, sha256(text) AS sha256
FROM (SELECT doc_id, text, {V.letter_ids_sql("text")} AS ids FROM documents)""",
    "prompt_labels": f"WITH {_PROMPTED} SELECT * FROM p WHERE len(labels) > 0 AND len(labels) <= {MAX_LABEL_LENGTH}",
    "drop_timestamps": f"""WITH t AS (SELECT conv_id, turn, {_TEACHER} AS teacher FROM conversations),
x AS (SELECT conv_id, turn, '[' || array_to_string(teacher, ' ') || ']' AS as_text FROM t),
y AS (SELECT conv_id, turn, {_one_eot("CASE WHEN starts_with(as_text, '[') AND ends_with(as_text, ']') THEN list_transform(regexp_extract_all(as_text, '(\\d+)', 1), lambda s: s::INTEGER) END")} AS ids FROM x),
v AS (SELECT range + {L.TIMESTAMP_FIRST} AS ts_id, printf('<|%.2f|>', range * 0.02) AS ts_token FROM range({L.TIMESTAMP_COUNT}))
SELECT conv_id, turn, {_drop_ts('ids')} AS ids, v.ts_token FROM y LEFT JOIN v ON v.ts_id = list_filter(ids, lambda q: q >= {L.TIMESTAMP_FIRST})[1]""",
    "batch_pad": f"""WITH {_PROMPTED},
b AS (SELECT conv_id, max(len(labels)) AS m, bool_and(labels[1] = {L.SOT}) AS all_bos FROM p GROUP BY conv_id),
q AS (SELECT p.conv_id, turn, list_concat(labels, list_transform(range(m - len(labels)), lambda z: {L.PAD_LABEL})) AS padded, all_bos
      FROM p JOIN b USING (conv_id))
SELECT conv_id, turn, CASE WHEN all_bos THEN list_slice(padded, 2, len(padded)) ELSE padded END AS labels_padded FROM q""",
    "packed_labels": f"""WITH {_PROMPTED},
b AS (SELECT conv_id, max(len(labels)) AS m FROM p GROUP BY conv_id),
q AS (SELECT p.conv_id, turn, len(labels) AS n, list_concat(labels, list_transform(range(m - len(labels)), lambda z: {L.EOT})) AS padded
      FROM p JOIN b USING (conv_id)),
s AS (SELECT conv_id, turn, list_slice(padded, 1, len(padded) - 1) AS decoder_input_ids,
             list_transform(list_slice(padded, 2, len(padded)), lambda x, i: CASE WHEN i < n THEN x ELSE {L.PAD_LABEL} END) AS t FROM q)
SELECT conv_id, turn, decoder_input_ids,
       list_transform(t, lambda x, i: CASE WHEN coalesce(list_position(t, {L.SOT}), 0) - 1 > 0 AND i - 1 <= list_position(t, {L.SOT}) - 1
                                           THEN {L.PAD_LABEL} ELSE x END) AS targets FROM s""",
}
