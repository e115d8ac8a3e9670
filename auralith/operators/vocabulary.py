"""Token ids by longest match over a vocabulary table.

A vocabulary is a table (token_id, token) with tokens as bytes. Texts are read as UTF-8: at each place the longest token that
matches is taken, found by walking a trie, so any text round-trips if every single byte is a token. The table is collected
only up to a checked size (a vocabulary is a dimension, not data) and shared with the workers as one broadcast value, whose
trie each worker builds once. Texts never leave their rows: there is no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def trie_of(tokens: dict[bytes, int]) -> dict:
    """Nested tables by byte; a token's id is under -1 of its last node."""
    root: dict = {}
    for token, number in tokens.items():
        node = root
        for byte in token:
            node = node.setdefault(byte, {})
        node[-1] = number
    return root


def longest_matches(data: bytes, root: dict, unknown: int | None, most: int | None) -> list[int]:
    """Ids of ``data`` from its beginning, ``most`` at most; bytes that no token begins with give ``unknown`` each."""
    out, at, size = [], 0, len(data)
    while at < size and (most is None or len(out) < most):
        node, place, best, end = root, at, unknown, at + 1
        while place < size and (node := node.get(data[place])) is not None:
            place += 1
            if -1 in node:
                best, end = node[-1], place
        if best is None:
            raise ValueError(f"no token for byte {data[at]} and no id for unknown bytes")
        out.append(best)
        at = end
    return out


def slices(parts: Iterator[pd.Series], rows: int = 256) -> Iterator[pd.Series]:
    """The batches in pieces of ``rows`` at most: a worker holds the ids of few texts at a time, however many Arrow sends together."""
    for part in parts:
        for at in range(0, len(part), rows):
            yield part.iloc[at:at + rows]


def ids_of(text: str, root: dict, unknown: int | None, most: int | None) -> np.ndarray:
    """``longest_matches`` of a text at four bytes an id (a Python list takes about forty)."""
    return np.array(longest_matches(text.encode(), root, unknown, most), dtype=np.int32)


class Vocabulary:
    def __init__(self, table: DataFrame, max_tokens: int = 1 << 20, unknown: int | None = None):
        """``table``: (token_id, token: binary or string). More than ``max_tokens`` rows, an empty token, or an id or token that
        occurs twice are errors."""
        rows = table.select(F.col("token_id").cast("int"), F.col("token").cast("binary")).limit(max_tokens + 1).collect()
        if len(rows) > max_tokens:
            raise ValueError(f"a vocabulary of more than {max_tokens} tokens")
        tokens = {bytes(token): number for number, token in rows}
        if b"" in tokens or len(tokens) < len(rows) or len(set(tokens.values())) < len(rows):
            raise ValueError("empty or repeated tokens, or repeated ids")
        self.size, self.unknown = len(rows), unknown
        self.shared = table.sparkSession.sparkContext.broadcast({"tokens": tokens})

    def ids(self, text: Column, max_length: int | None = None) -> Column:
        """Ids of a text, cut to ``max_length``; null stays null."""
        shared, unknown = self.shared, self.unknown

        @F.pandas_udf("array<int>")
        def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            held = shared.value
            root = held.get("trie") or held.setdefault("trie", trie_of(held["tokens"]))
            for texts in slices(parts):
                yield pd.Series([None if t is None else ids_of(t, root, unknown, max_length) for t in texts], dtype=object)

        return encode(text)

    def text(self, ids: Column) -> Column:
        """The text of an id list: the tokens' bytes read as UTF-8 (bytes that are no character, as after a cut, become U+FFFD).
        An id without a token fails the job; null stays null."""
        shared = self.shared

        @F.pandas_udf("string")
        def decode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            held = shared.value
            names = held.get("names") or held.setdefault("names", {n: t for t, n in held["tokens"].items()})
            for lists in slices(parts):
                yield pd.Series([None if x is None else b"".join(names[i] for i in x).decode(errors="replace") for x in lists], dtype=object)

        return decode(ids)


def read_ranks(spark: SparkSession, path: str) -> DataFrame:
    """A vocabulary file of lines ``base64 id`` as a table."""
    parts = F.split("value", " ")
    return spark.read.text(path).filter("value <> ''").select(parts[1].cast("int").alias("token_id"), F.unbase64(parts[0]).alias("token"))


def letter_vocabulary(spark: SparkSession) -> DataFrame:
    """A vocabulary by rule: every byte by its value, then all strings of two and of three letters a-z, then all of a blank and one
    or two letters, each in alphabetical order (19,210 tokens)."""
    def letter(place: int) -> Column:
        return F.substring(F.lit(LETTERS), (F.floor(F.col("id") / 26 ** place) % 26 + 1).cast("int"), F.lit(1))

    def strings(letters: int, blank: bool) -> DataFrame:
        token = F.concat(*([F.lit(" ")] if blank else []), *[letter(p) for p in reversed(range(letters))])
        return spark.range(26 ** letters).select(F.col("id"), token.cast("binary").alias("token"))

    out = spark.range(256).select(F.col("id").alias("token_id"), F.unhex(F.lpad(F.hex("id"), 2, "0")).alias("token"))
    first = 256
    for letters, blank in ((2, False), (3, False), (1, True), (2, True)):
        out = out.union(strings(letters, blank).select(F.col("id") + first, "token"))
        first += 26 ** letters
    return out.select(F.col("token_id").cast("int").alias("token_id"), "token")


def letter_ids_sql(text: str) -> str:
    """Ids by ``letter_vocabulary`` in DuckDB: its longest match is a greedy pattern, its ids are arithmetic."""
    def at(i: int) -> str:
        return f"(ascii(substr(p, {i}, 1)) - 97)"

    n = 256 + 26 ** 2 + 26 ** 3
    return f"""flatten(list_transform(regexp_extract_all({text}, ' [a-z]{{0,2}}|[a-z]{{1,3}}|(?s:.)'), lambda p: CASE
  WHEN regexp_full_match(p, '[a-z][a-z]') THEN [(256 + 26 * {at(1)} + {at(2)})::INTEGER]
  WHEN regexp_full_match(p, '[a-z]{{3}}') THEN [({256 + 26 ** 2} + 676 * {at(1)} + 26 * {at(2)} + {at(3)})::INTEGER]
  WHEN regexp_full_match(p, ' [a-z]') THEN [({n} + {at(2)})::INTEGER]
  WHEN regexp_full_match(p, ' [a-z][a-z]') THEN [({n + 26} + 26 * {at(2)} + {at(3)})::INTEGER]
  ELSE list_transform(range(octet_length(encode(p))), lambda i: ('0x' || substr(hex(encode(p)), (2 * i + 1)::INTEGER, 2))::INTEGER) END))"""
