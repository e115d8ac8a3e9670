"""DataFrame-level label operators: previous-row conditioning (W1), batch padding (L7/L8/A11), decoder collation
(L4-L6) and the timestamp vocabulary (T15).

"Previous row in the same batch" is a join of each row with the ids of the key before its own ``(batch, row)``, rather
than ``lag`` over a window partitioned by batch: everything is keyed by that pair, so one huge batch never lands in a
single task. Row numbers may have gaps and repeats; the order of the distinct keys alone is indexed.
Batch-level values (longest labels, all-start-with-SOT) are partial aggregates joined back on the batch key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auralith.functions import labels as L
from auralith.functions.edit import _bind
from auralith.operators.ordering import compute_once, dense_index, spread

KNOWN_TOKENS = 1 << 18
SLICE = 5000  # rows that a worker splits into words at a time


def _next_keys(df: DataFrame, batch: str, row: str) -> DataFrame:
    """(_b, _r, _next): every distinct key with the next row number of its batch."""
    keys = df.select(F.col(batch).alias("_b"), F.col(row).alias("_r")).distinct()
    keys = dense_index(keys, ["_b", "_r"], name="_i")
    after = keys.select(F.col("_b"), (F.col("_i") - 1).alias("_i"), F.col("_r").alias("_next"))
    return keys.join(after, ["_b", "_i"]).select("_b", "_r", "_next")


def prompt_with_previous(df: DataFrame, batch: str, row: str, ids: str, condition: Column, max_len: int,
                         position: int = L.MULTILINGUAL_PREFIX, dense: bool = False) -> DataFrame:
    """A row's prompt comes from the row before it in its batch, whatever the gap between their numbers. All rows
    are kept: rows that share a key get the same previous ids, and give the largest of theirs to the next. ``dense``
    promises that the numbers of a batch have no gaps, which saves ordering the keys."""
    given = df.groupBy(F.col(batch).alias("_b"), F.col(row).alias("_r")).agg(F.max(ids).alias("_prev"))
    if dense:
        given = given.withColumn("_r", F.col("_r") + 1)
    else:
        given = given.join(_next_keys(df, batch, row), ["_b", "_r"]).select("_b", F.col("_next").alias("_r"), "_prev")
    rows = df.join(given, (F.col(batch) == F.col("_b")) & (F.col(row) == F.col("_r")), "left").drop("_b", "_r")
    labels = L.with_prompt(F.col(ids), F.col("_prev"), condition, max_len, position)
    return compute_once(rows.drop("labels") if "labels" in df.columns else rows, labels=labels).drop("_prev")


def timestamp_vocab(spark) -> DataFrame:
    """``<|%.2f|>`` of i * 0.02 for the 1501 timestamp tokens, keyed by token id."""
    return spark.range(L.TIMESTAMP_COUNT).select(
        (F.col("id") + L.TIMESTAMP_FIRST).cast("int").alias("ts_id"),
        F.format_string("<|%.2f|>", F.col("id") * F.lit(0.02)).alias("ts_token"),
    )


class KnownTokens:
    """The tokens of a vocabulary that occur most, shared with the workers and looked up inside the rows; only the others have to be
    joined. Which tokens are known decides how many rows move, not what comes out."""

    def __init__(self, vocab: DataFrame, most: int = KNOWN_TOKENS):
        """``vocab``: (token_id, token, special, n occurrences), ids and ordinary tokens once each. Known are the tokens of ``least``
        occurrences or more, ``most`` of them at most, and besides the ids of all special tokens."""
        level = F.floor(F.log2("n") * 16)
        sizes = vocab.where("n > 0").groupBy(level.alias("k")).agg(F.count(F.lit(1)).alias("size"), F.min("n").alias("least"), F.max("n").alias("largest")).collect()
        self.least = max((row["largest"] for row in sizes), default=0) + 1
        for row in sorted(sizes, key=lambda row: -row["k"]):
            if (most := most - row["size"]) < 0:
                break
            self.least = row["least"]
        rows = vocab.where(F.col("special") | (F.col("n") >= self.least)).select(F.col("token_id").cast("long"), "token", "special").toArrow()
        self.shared = vocab.sparkSession.sparkContext.broadcast({"rows": rows})

    def unknown(self, vocab: DataFrame) -> DataFrame:
        return vocab.where(F.col("n") < self.least)


def _shared(known: KnownTokens | None):
    """For the workers: a function to the ids of words, printed (null: not known), and one to the tokens of printed ids (null: special or
    not known) with whether they are known."""
    shared = known.shared if known else None

    def made() -> tuple:
        held = shared.value if shared else {"rows": pa.table({"token_id": pa.array([], "int64"), "token": pa.array([], "string"), "special": pa.array([], "bool")})}
        if "made" not in held:
            rows = held.pop("rows").sort_by("token_id")
            ids, tokens, special = (c.combine_chunks().cast(kind) for c, kind in zip(rows.columns, ("int64", "string", "bool")))
            own = pc.invert(pc.or_(special, pc.is_in(tokens, value_set=tokens.filter(special))))  # a special token's name is always joined
            place = {token: i for i, token in zip(np.flatnonzero(own).tolist(), tokens.filter(own).to_pylist())}
            held["made"] = place, ids.cast("string"), np.append(ids.to_numpy(), np.iinfo(np.int64).max), pc.if_else(special, None, tokens)
        return held["made"]

    def ids_of(words: pa.Array) -> pa.Array:
        place, printed, _, _ = made()
        some = words.dictionary_encode()
        return printed.take(pa.array([place.get(x) for x in some.dictionary.to_pylist()], "int32").take(some.indices))

    def tokens_of(printed: pa.Array) -> tuple[pa.Array, np.ndarray]:
        _, _, ids, tokens = made()
        short = pc.less(pc.binary_length(printed), 19)  # others may be no long; the join casts them
        numbers = pc.if_else(short, printed, "0").cast("int64").to_numpy()
        at = np.searchsorted(ids, numbers)
        there = (ids[at] == numbers) & short.to_numpy(zero_copy_only=False)
        return tokens.take(pa.array(at, mask=~there)), there

    return ids_of, tokens_of


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), SLICE):
            yield batch.slice(at, SLICE)
    pa.default_memory_pool().release_unused()


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of the texts, split at blanks, with their texts' numbers and their places in them."""
    lists = pc.split_pattern(texts.cast("string"), " ")
    offsets = lists.offsets.to_numpy()
    row = np.repeat(np.arange(len(lists), dtype=np.int32), np.diff(offsets))
    return lists.values, row, np.arange(offsets[-1], dtype=np.int32) - offsets[row]


def _printed_ids(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """As ``_words``, the runs of digits."""
    words, row, place = _words(pc.ascii_trim(pc.replace_substring_regex(texts.cast("string"), "[^0-9]+", " "), " "))
    some = pc.not_equal(words, "")  # a list without ids is one empty word
    return words.filter(some), row[some], place[some]


def _lists(values: pa.Array, row: np.ndarray, rows: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(rows + 1)), "int32"), values)


def _ddl(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)


def printed_token_ids(df: DataFrame, keys: list[str], text: str, vocab: DataFrame, known: KnownTokens) -> DataFrame:
    """(*keys, ids): the words of a text, split at blanks, as their ids in ``vocab`` (token_id, token, special, n; every word is in
    it), printed with blanks between. ``keys`` identify a row; rows that share them give one list, by the words' places and then their
    ids; a row without a key or a text gives none. Only words that are not ``known`` are joined to their ids, the others take theirs where they stand."""
    ids_of, _ = _shared(known)

    def runs_of_known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            words, row, place = _words(batch.column(text))
            ids = ids_of(words)
            there = ids.is_valid().to_numpy(zero_copy_only=False)
            first = there.copy()  # a run begins where the word before is another text's or not known
            first[1:] &= ~(there[:-1] & (row[1:] == row[:-1]))
            begins = np.append((np.cumsum(there) - 1)[first], there.sum())
            runs = pc.binary_join(pa.ListArray.from_arrays(pa.array(begins, "int32"), ids.drop_null()), " ")
            at = pa.array(place[first], "int32")
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *(_lists(x, row[first], len(batch)) for x in (at, runs))], [*keys, "at", "runs"])

    def unknown_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            words, row, place = _words(batch.column(text))
            rest = np.flatnonzero(ids_of(words).is_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(row[rest])) for k in keys), pa.array(place[rest], "int32"), words.take(pa.array(rest))], [*keys, "_p", "token"])

    def part(p, token_id, ids):
        return F.struct(p.alias("_p"), token_id.alias("token_id"), ids.alias("ids"))

    texts = df.dropna(subset=[*keys, text]).select(*keys, text)
    words = texts.mapInArrow(unknown_words, f"{_ddl(df, keys)}, _p int, token string")
    found = words.join(known.unknown(vocab).select("token_id", "token"), "token")
    found = found.groupBy(*keys).agg(F.collect_list(F.struct("_p", "token_id")).alias("_found"))
    rows = spread(texts.mapInArrow(runs_of_known, f"{_ddl(df, keys)}, at array<int>, runs array<string>"), *keys)
    rows = rows.groupBy(*keys).agg(F.collect_list(F.struct("at", "runs")).alias("_rows"))
    whole = F.transform("_rows", lambda r: F.zip_with(r["at"], r["runs"], lambda p, ids: part(p, F.lit(0).cast("long"), ids)))
    single = F.transform("_rows", lambda r: F.flatten(F.zip_with(r["at"], r["runs"], lambda p, ids: F.transform(F.split(ids, " "), lambda x, i: part(p + i, x.cast("long"), x)))))
    parts = F.flatten(F.when(F.size("_rows") > 1, single).otherwise(whole))  # rows of one key mix id by id
    rows = compute_once(rows, _parts=parts).drop("_rows").join(found, keys, "left")
    joined = F.transform("_found", lambda x: part(x["_p"], x["token_id"], x["token_id"].cast("string")))
    every = F.sort_array(F.when(F.col("_found").isNull(), F.col("_parts")).otherwise(F.concat("_parts", joined)))
    return compute_once(rows, ids=F.array_join(F.transform(every, lambda x: x["ids"]), " ")).drop("_parts", "_found")


def decode_token_text(df: DataFrame, keys: list[str], text: str, vocab: DataFrame, joiner: str = " ", known: KnownTokens | None = None) -> DataFrame:
    """T14 + T17: a text that is a printed id list (``[12 7 50257]``, commas allowed) becomes its tokens by ``vocab``
    (token_id, token, special); special ids are dropped, an id that the vocabulary lacks fails the job, other texts stay
    as they are, in their tasks. ``keys`` identify a row; rows that share them share their tokens. Only ids that are not ``known`` are
    joined to their tokens, which meet again in one small group; the others become theirs inside the row."""
    _, tokens_of = _shared(known)

    def unknown_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            words, row, place = _printed_ids(batch.column(text))
            alone = batch.column("_alone").to_numpy(zero_copy_only=False)
            rest = np.flatnonzero(~(tokens_of(words)[1] & alone[row]))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(row[rest])) for k in keys), pa.array(place[rest], "int32"), words.take(pa.array(rest))], [*keys, "_p", "id"])

    @F.pandas_udf("string")
    def filled(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, alone, at, found in ([c.iloc[i:i + SLICE] for c in part] for part in parts for i in range(0, len(part[0]), SLICE)):
            words, row, place = _printed_ids(pa.array(texts, "string"))
            inside = tokens_of(words)[0]  # of rows that are alone the known tokens, of all rows those that the join found
            keep = inside.is_valid().to_numpy(zero_copy_only=False) & alone.to_numpy(dtype=bool)[row]
            sizes = [0 if x is None else len(x) for x in at]
            joined = pa.array([x for each in found if each is not None for x in each], "string")
            row = np.concatenate([row[keep], np.repeat(np.arange(len(texts)), sizes)])
            place = np.concatenate([place[keep], [p for each in at if each is not None for p in each]])
            order = np.lexsort((place, row))
            all_tokens = pa.concat_arrays([inside.filter(pa.array(keep)), joined]).take(pa.array(order))
            yield pd.Series(pc.binary_join(_lists(all_tokens, row[order], len(texts)), joiner).to_pylist(), dtype=object)

    columns = [*keys, *[c for c in df.columns if c not in keys]]
    printed = F.coalesce(F.col(text).rlike(r"^\s*\[[\d,\s]*\]\s*$"), F.lit(False))
    alone = F.count(F.lit(1)).over(Window.partitionBy(*keys)) == 1
    for k in keys:
        alone = alone & F.col(k).isNotNull()
    lists = df.where(printed).withColumn("_alone", alone)
    pieces = lists.mapInArrow(unknown_ids, f"{_ddl(df, keys)}, _p int, id string")  # reads all columns, so that both readings of lists share their exchanges
    pieces = pieces.select(*keys, "_p", F.col("id").cast("long").alias("token_id"))
    found = pieces.join(vocab.select("token_id", "token", "special"), "token_id", "left")
    token = F.when(F.col("special").isNull(), F.raise_error(F.concat(F.lit("no token for id "), F.col("token_id").cast("string")))).when(~F.col("special"), F.col("token"))
    packed = F.array_sort(F.collect_list(F.when(token.isNotNull(), F.struct(F.col("_p"), token.alias("token")))))
    lists = lists.join(found.groupBy(*keys).agg(packed.alias("_found")), keys, "left")
    lists = lists.withColumn(text, filled(text, "_alone", "_found._p", "_found.token")).select(*columns)
    return df.where(~printed).select(*columns).unionByName(lists)


def _batch_stats(df: DataFrame, batch: str, labels: str, sot: int | None) -> DataFrame:
    aggs = [F.max(F.size(labels)).alias("_m")]
    if sot is not None:
        aggs.append(F.bool_and(F.try_element_at(F.col(labels), F.lit(1)) == F.lit(sot)).alias("_all_bos"))
    return df.groupBy(batch).agg(*aggs)


def pad_batch(df: DataFrame, batch: str, labels: str, pad: int, drop_leading: int | None = None) -> DataFrame:
    stats = _batch_stats(df, batch, labels, drop_leading)
    j = df.join(stats, batch)
    padded = L.right_pad(F.col(labels), F.col("_m"), pad)
    if drop_leading is not None:
        padded = F.when(F.col("_all_bos"), F.slice(padded, 2, F.greatest(F.col("_m") - 1, F.lit(0)))).otherwise(padded)
    return j.withColumn("labels_padded", padded).drop("_m", "_all_bos")


def decoder_batch(df: DataFrame, batch: str, labels: str) -> DataFrame:
    stats = _batch_stats(df, batch, labels, None)
    j = df.join(stats, batch)
    padded = L.right_pad(F.col(labels), F.col("_m"), L.EOT)
    n = F.size(labels)
    targets = _bind(L.shift_targets(padded, n), lambda t: L.mask_prompt(t))
    return j.withColumn("decoder_input_ids", L.shift_inputs(padded)).withColumn("targets", targets).drop("_m")
