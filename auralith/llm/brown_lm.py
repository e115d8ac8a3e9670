"""Language-model scoring with Brown class-based n-grams (operator 2).

The probability of a text is the product, over its words and one end token, of ``P(class | two classes before)`` and
``P(word | class)``. Classes come from exchange clustering: starting from classes dealt by frequency, every item in turn
moves to the class that raises the class-bigram likelihood most. The statistics behind the moves, each item's counts with
the classes left and right of it, are recounted over the whole training text's item pairs in every round.

This first clustering is of items. An item is a word that makes up at least ``item_share`` of the training tokens, or the spelling pattern (last three
bytes, stop mark, digit at either end) of all rarer words that share it and together make up as much; patterns below that fall back
to a coarse pattern. So every word, seen or not, has a class, and there are at most ``2 / item_share`` items whatever
the size of the corpus. Then every other word of at least ``word_count`` occurrences (an absolute count) is exchanged by itself: its
counts with the classes beside it are a Spark table, and tasks choose its best class against the broadcast class table.
Such words are as many as can be broadcast (``hot_share``, below); the likelihood must rise, or the words stay with their
patterns. Class transitions are trigrams with Witten-Bell smoothing down to single classes; within a class
a word has ``(count + 1) / (tokens + words + 1)`` and one unseen word ``1 / (tokens + words + 1)``, which is the
convention of the unigram base score, so the two compare.

Counts cover every training token: per-task partial counts are aggregated by word, and the table is stored. Words above
``hot_share`` of the tokens (at most ``1 / hot_share``: a million words, 24 MB) are broadcast; the other words of a text are joined to the
stored table by their hash and summed by document. The driver sees only tables bounded by the shares and the number of
classes. Words are identified by 64-bit hashes.

Defined cases: a null text is empty (its end token alone); a null id belongs to the training part; repeated rows are
scored and counted each; without training text every token is unknown; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auralith.llm import blocks
from auralith.llm.store import shuffle_partitions, stored

_STOPS = np.zeros(256, bool)
_STOPS[[ord("."), ord(",")]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
END_CLASS = 0


def patterns(words: blocks.Words, which: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
    """Spelling pattern and coarse pattern of every word (of those asked for)."""
    data, start, end = words.data, words.start[which], words.end[which]
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    core = end.copy()
    some = np.flatnonzero(_STOPS[data[end - 1]])
    while len(some):  # back over the stop marks
        core[some] -= 1
        some = some[core[some] > start[some]]
        some = some[_STOPS[data[core[some] - 1]]]
    digits = _DIGIT[data[start]] | _DIGIT[data[np.maximum(core, start + 1) - 1]]
    coarse = np.where(core < end, data[end - 1], 0).astype(np.int64) * 2 + digits + 1
    fine = coarse << 24
    for back in (1, 2, 3):
        at = core - back
        fine |= np.where(at >= start, data[np.maximum(at, 0)], 0).astype(np.int64) << (8 * (back - 1))
    return fine, coarse


def _counter(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts (word, fine, coarse, n, texts) of the training texts, one row per distinct word of some pieces."""
    held: list[tuple] = []
    texts = 0

    def flush() -> pa.RecordBatch:
        word, fine, coarse, n = (np.concatenate(x) for x in zip(*held))
        value, first, inverse = np.unique(word, return_index=True, return_inverse=True)
        total = np.bincount(inverse, weights=n, minlength=len(value)).astype(np.int64)
        held.clear()
        many = np.zeros(len(value) + 1, np.int64)
        many[-1] = texts
        columns = (np.append(value.view(np.int64), 0), np.append(fine[first], 0), np.append(coarse[first], 0), np.append(total, 0), many)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["word", "fine", "coarse", "n", "texts"])

    for piece in blocks.batches(frames):
        words = blocks.scan(piece.column("text"), lower=True)
        value, first, n = np.unique(words.hashes(), return_index=True, return_counts=True)
        held.append((value, *patterns(words, first), n))
        texts += piece.num_rows
        if sum(len(h[0]) for h in held) > 1_500_000:
            yield flush()
            texts = 0
    if held:
        yield flush()


@dataclass
class Items:
    """Sorted lookup tables: hot words (hash, count, item or -1) and patterns (key, item)."""

    word: np.ndarray
    count: np.ndarray
    item: np.ndarray
    pattern: np.ndarray
    pattern_item: np.ndarray
    size: int  # items, the end token (0) and the fallback (1) among them

    def plain(self) -> tuple:
        """Arrays only: what is broadcast must load without this package."""
        return self.word, self.count, self.item, self.pattern, self.pattern_item, self.size

    def place(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position of each hash among the hot words, and whether it is one: a direct look by the leading bits, and a
        search only where several hot words share them."""
        if not len(self.word):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        if "table" not in self.__dict__:
            self.bits = np.uint64(64 - min(22, max(8, len(self.word).bit_length() + 2)))
            slot = (self.word >> self.bits).astype(np.int64)
            self.table, self.crowded = np.zeros(1 << (64 - int(self.bits)), np.int32), np.zeros(1 << (64 - int(self.bits)), bool)
            self.table[slot[::-1]] = np.arange(len(slot) - 1, -1, -1, dtype=np.int32)
            self.crowded[slot[1:][slot[1:] == slot[:-1]]] = True
        slot = (hashes >> self.bits).astype(np.int64)
        at = self.table[slot].astype(np.int64)
        hit = self.word[at] == hashes
        more = np.flatnonzero(~hit & self.crowded[slot])
        if len(more):
            at[more] = np.minimum(np.searchsorted(self.word, hashes[more]), len(self.word) - 1)
            hit[more] = self.word[at[more]] == hashes[more]
        return at, hit

    def by_pattern(self, *keys: np.ndarray) -> np.ndarray:
        """Item of the first of the patterns that has one; 1, the fallback, if none has."""
        item = np.full(len(keys[0]), -1, np.int64)
        for some in keys if len(self.pattern) else ():
            at = np.minimum(np.searchsorted(self.pattern, some), len(self.pattern) - 1)
            item = np.where((item < 0) & (self.pattern[at] == some), self.pattern_item[at], item)
        return np.where(item < 0, 1, item)

    def find(self, words: blocks.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, training count (-1: not a hot word) and item of every word."""
        hashes = words.hashes()
        at, hit = self.place(hashes)
        if not len(self.word):
            count, item = np.full(len(hashes), -1, np.int64), np.full(len(hashes), -1, np.int64)
        else:
            count, item = np.where(hit, self.count[at], -1), np.where(hit, self.item[at], -1)
        rest = np.flatnonzero(item < 0)
        if len(rest):
            item[rest] = self.by_pattern(*patterns(words, rest))
        return hashes, count, item


def _sequences(piece: pa.RecordBatch, items: Items) -> tuple:
    """Item of every token (each text's end token is item 0), row of every token, and what ``find`` gives."""
    words = blocks.scan(piece.column("text"), lower=True)
    hashes, count, item = items.find(words)
    ends = words.first[1:]
    return np.insert(item, ends, 0), np.insert(words.row, ends, np.arange(piece.num_rows)), words, hashes, count, item


def _pairer(shared) -> Callable:
    def pair(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of neighbouring items; every text begins after an end token."""
        items, held = Items(*shared.value), []

        def flush() -> pa.RecordBatch:
            cell = np.concatenate([h[0] for h in held])
            value, inverse = np.unique(cell, return_inverse=True)
            n = np.bincount(inverse, weights=np.concatenate([h[1] for h in held]), minlength=len(value)).astype(np.int64)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(value // items.size), pa.array(value % items.size), pa.array(n)], ["left", "right", "n"])

        for piece in blocks.batches(frames):
            tokens = _sequences(piece, items)[0]
            before = np.concatenate([[0], tokens[:-1]])
            held.append(np.unique(before * items.size + tokens, return_counts=True))
            if sum(len(h[0]) for h in held) > 1_500_000:
                yield flush()
        if held:
            yield flush()

    return pair


def _neighbours(size: int, classes: int, shared) -> Callable:
    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of each item with the class after it (cells from 0) and before it (cells from size * classes)."""
        of = shared.value
        cells = np.zeros(2 * size * classes, np.int64)
        for frame in frames:
            left, right, n = (np.asarray(frame.column(c), np.int64) for c in ("left", "right", "n"))
            np.add.at(cells, left * classes + of[right], n)
            np.add.at(cells, (size + right) * classes + of[left], n)
        some = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(cells[some])], ["cell", "n"])

    return count


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(after: np.ndarray, of: np.ndarray, classes: int) -> float:
    """Class-bigram log likelihood (up to the words' own entropy)."""
    both = np.zeros((classes, classes))
    np.add.at(both, of, after)
    return table_likelihood(both)


def table_likelihood(both: np.ndarray) -> float:
    return float(_xlogx(both).sum() - _xlogx(both.sum(axis=1)).sum() - _xlogx(both.sum(axis=0)).sum())


def exchange(after: np.ndarray, before: np.ndarray, of: np.ndarray, classes: int, turn: int) -> np.ndarray:
    """One round: a third of the items, another in each turn, move in order of frequency to their best class (the end
    token keeps its own). ``after`` and ``before`` are items x classes; the class table follows each move, and what the
    moves change in other items' counts is seen in the next round, which is why not all items move at once."""
    of = of.copy()
    both = np.zeros((classes, classes))
    np.add.at(both, of, after)
    total = after.sum(axis=1)
    mine = (blocks.mix(np.arange(len(of), dtype=np.uint64)) % np.uint64(3)).astype(int) == turn % 3
    for w in np.argsort(-total, kind="stable"):
        if w == 0 or not total[w] or not mine[w]:
            continue
        r, l = after[w], before[w]
        both[of[w]] -= r
        both[:, of[w]] -= l
        np.maximum(both, 0, out=both)  # counts of moved neighbours are refreshed in the next round
        row, column = both.sum(axis=1), both.sum(axis=0)
        gain = (_xlogx(both + r) - _xlogx(both)).sum(axis=1) + (_xlogx(both + l[:, None]) - _xlogx(both)).sum(axis=0)
        gain -= _xlogx(row + r.sum()) - _xlogx(row) + _xlogx(column + l.sum()) - _xlogx(column)
        gain[END_CLASS] = -np.inf
        of[w] = int(gain.argmax())
        both[of[w]] += r
        both[:, of[w]] += l
    return of


def best_classes(after: np.ndarray, before: np.ndarray, own: np.ndarray, both: np.ndarray) -> np.ndarray:
    """The class that raises the likelihood most for each of some words, each moved alone: ``after`` and ``before`` are words x
    classes, ``own`` their classes now, ``both`` the class table that holds them there."""
    rows = np.arange(len(own))
    table = np.repeat(both[None], len(own), axis=0)
    table[rows, own] -= after
    table[rows, :, own] -= before
    table = np.maximum(table, 0)
    gain = (_xlogx(table + after[:, None, :]) - _xlogx(table)).sum(axis=2) + (_xlogx(table + before[:, :, None]) - _xlogx(table)).sum(axis=1)
    same = np.arange(table.shape[1])
    inner = table[:, same, same]  # takes both a class's followers and its predecessors
    gain += _xlogx(inner + after + before) - _xlogx(inner + after) - _xlogx(inner + before) + _xlogx(inner)
    row, column = table.sum(axis=2) + before, table.sum(axis=1) + after  # whichever class the word joins
    gain -= _xlogx(row + after.sum(axis=1, keepdims=True)) - _xlogx(row) + _xlogx(column + before.sum(axis=1, keepdims=True)) - _xlogx(column)
    gain[:, END_CLASS] = -np.inf
    return gain.argmax(axis=1)


def _contexts(classes: int, first: int, shared) -> Callable:
    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of each item from ``first`` on with the class after it (cells from 0) and before it (cells from ``classes``)."""
        items, of, held = Items(*shared.value[0]), shared.value[1], []

        def flush() -> pa.RecordBatch:
            value, inverse = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            n = np.bincount(inverse, weights=np.concatenate([h[1] for h in held]), minlength=len(value)).astype(np.int64)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(value // (2 * classes)), pa.array(value % (2 * classes)), pa.array(n)], ["item", "cell", "n"])

        for piece in blocks.batches(frames):
            tokens = _sequences(piece, items)[0]
            now = of[tokens]
            at = np.flatnonzero(tokens >= first)  # never a text's end: there is a token after each
            left = now[np.maximum(at - 1, 0)]
            left[at == 0] = END_CLASS
            cells = np.concatenate([tokens[at] * 2 * classes + now[np.minimum(at + 1, len(now) - 1)], (tokens[at] * 2 + 1) * classes + left])
            held.append(np.unique(cells, return_counts=True))
            if sum(len(h[0]) for h in held) > 1_500_000:
                yield flush()
        if held:
            yield flush()

    return count


def _chooser(classes: int, tasks: int, shared) -> Callable:
    def choose(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Best class of each item, from its cells (rows sorted by item). The task's class table follows every move, as if
        each of the other tasks made the like of it: else all would crowd into the same class."""
        of, both = shared.value
        both = both.copy()
        held = [np.zeros(0, np.int64)] * 3

        def done(item: np.ndarray, cell: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            names, first = np.unique(item, return_index=True)
            found = np.empty(len(names), np.int64)
            for k, (lo, hi) in enumerate(zip(first, np.append(first[1:], len(item)))):
                cells = np.zeros((2, classes))
                cells.ravel()[cell[lo:hi]] = n[lo:hi]
                own = of[names[k]]
                found[k] = c = best_classes(cells[:1], cells[1:], np.array([own]), both)[0]
                if c != own:
                    for to, sign in ((own, -tasks), (c, tasks)):
                        both[to] += sign * cells[0]
                        both[:, to] += sign * cells[1]
                    np.maximum(both, 0, out=both)
            return pa.RecordBatch.from_arrays([pa.array(names), pa.array(found)], ["item", "class"])

        for frame in frames:
            held = [np.concatenate([h, np.asarray(frame.column(c), np.int64)]) for h, c in zip(held, ("item", "cell", "n"))]
            if len(held[0]) > 200_000:
                last = np.searchsorted(held[0], held[0][-1])  # the last item may go on
                yield done(*(h[:last] for h in held))
                held = [h[last:] for h in held]
        yield done(*held)

    return choose


def _own_classes(texts: DataFrame, items: Items, of: np.ndarray, both: np.ndarray, mid: np.ndarray, pattern_item: np.ndarray, classes: int) -> tuple[Items, np.ndarray]:
    """``items`` and their classes with an item of its own for each hot word in ``mid``, in its best class."""
    spark, item = texts.sparkSession, items.item.copy()
    item[mid] = items.size + np.arange(len(mid))
    more = Items(items.word, items.count, item, items.pattern, items.pattern_item, items.size + len(mid))
    of = np.concatenate([of, of[pattern_item]])
    counted = texts.mapInArrow(_contexts(classes, items.size, spark.sparkContext.broadcast((more.plain(), of))), "item long, cell long, n long")
    counted = counted.groupBy("item", "cell").agg(F.sum("n").alias("n"))
    parts = shuffle_partitions(spark)
    rows = counted.repartition(parts, "item").sortWithinPartitions("item")
    chosen = rows.mapInArrow(_chooser(classes, parts, spark.sparkContext.broadcast((of, both))), "item long, class long").toArrow()  # hot words only
    of = of.copy()
    of[np.asarray(chosen.column("item"), np.int64)] = np.asarray(chosen.column("class"), np.int64)
    return more, of


def _trigrams(classes: int, shared) -> Callable:
    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, of = Items(*shared.value[0]), shared.value[1]
        cells = np.zeros(classes ** 3, np.int64)
        for piece in blocks.batches(frames):
            tokens = of[_sequences(piece, items)[0]]
            one = np.concatenate([[END_CLASS], tokens[:-1]])
            two = np.where(one == END_CLASS, END_CLASS, np.concatenate([[END_CLASS, END_CLASS], tokens[:-2]])[: len(tokens)])
            cells += np.bincount((two * classes + one) * classes + tokens, minlength=classes ** 3)
        some = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(cells[some])], ["cell", "n"])

    return count


def _totals(shared) -> Callable:
    def total(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tokens and distinct words of each class, from the stored word counts."""
        items, of = Items(*shared.value[0]), shared.value[1]
        cells = np.zeros((2, int(of.max()) + 1), np.int64)
        for frame in frames:
            word, fine, coarse, n = (np.asarray(frame.column(c), np.int64) for c in ("word", "fine", "coarse", "n"))
            at, hit = items.place(word.view(np.uint64))
            item = np.where(hit, items.item[at], -1) if len(items.word) else np.full(len(word), -1, np.int64)
            c = of[np.where(item < 0, items.by_pattern(fine, coarse), item)]
            np.add.at(cells[0], c, n)
            np.add.at(cells[1], c, 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells.shape[1])), pa.array(cells[0]), pa.array(cells[1])], ["class", "n", "words"])

    return total


def witten_bell(counts: np.ndarray) -> np.ndarray:
    """P(c3 | c1, c2) from trigram counts (classes x classes x classes), smoothed through bigrams to single classes."""
    one = counts.sum(axis=(0, 1)) + 1.0
    p = one / one.sum()
    for table in (counts.sum(axis=0), counts):
        kinds = (table > 0).sum(axis=-1, keepdims=True)
        total = table.sum(axis=-1, keepdims=True)
        p = np.where(total > 0, (table + kinds * p) / np.maximum(total + kinds, 1), p)
    return p


@dataclass
class Model:
    items: Items
    class_of: np.ndarray
    transition: np.ndarray  # log10 P(c3 | c1, c2)
    norm: np.ndarray  # log10(tokens + words + 1) of each class
    tokens: int
    words: int
    texts: int
    counts: DataFrame  # word, n: every training word


def _cells(df: DataFrame, size: int) -> np.ndarray:
    """A dense table from (cell, n) partial counts; ``size`` is bounded by items and classes."""
    out = np.zeros(size, np.int64)
    got = df.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out[np.asarray(got.column("cell"), np.int64)] = np.asarray(got.column("n"), np.int64)
    return out


def fit(train: DataFrame, text_col: str = "text", classes: int = 48, rounds: int = 9, item_share: float = 5e-5, hot_share: float = 1e-6,
        word_count: int = 50) -> Model:
    spark = train.sparkSession
    texts = train.select(F.col(text_col).cast("string").alias("text"))
    partial = texts.mapInArrow(_counter, "word long, fine long, coarse long, n long, texts long")
    counts = stored(partial.groupBy("word").agg(F.first("fine").alias("fine"), F.first("coarse").alias("coarse"), F.sum("n").alias("n"),
                                                F.sum("texts").alias("texts")), "words")
    head = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("texts"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1))).first()
    tokens, many, distinct = int(head[0] + head[1]), int(head[1]), int(head[2]) + (head[1] > 0)
    words = counts.filter("n > 0").drop("texts")
    hot = words.filter(F.col("n") >= hot_share * tokens).select("word", "n", "fine", "coarse").toArrow()
    frequent = item_share * tokens
    rare = words.filter(F.col("n") < frequent)
    fine = rare.groupBy("fine").agg(F.sum("n").alias("n")).filter(F.col("n") >= frequent).toArrow()
    coarse = rare.select("coarse").distinct().toArrow()  # at most 512 kinds
    word, n = np.asarray(hot.column("word"), np.int64).view(np.uint64), np.asarray(hot.column("n"), np.int64)
    order = np.argsort(word)
    word, n = word[order], n[order]
    spelling = [np.asarray(hot.column(c), np.int64)[order] for c in ("fine", "coarse")]
    item = np.full(len(word), -1, np.int64)
    item[n >= frequent] = 2 + np.arange(int((n >= frequent).sum()))
    size = 2 + int((n >= frequent).sum())
    pattern = np.sort(np.concatenate([np.asarray(fine.column("fine"), np.int64), np.asarray(coarse.column("coarse"), np.int64)]))
    items = Items(word, n, item, pattern, size + np.arange(len(pattern)), size + len(pattern))

    pairs = texts.mapInArrow(_pairer(spark.sparkContext.broadcast(items.plain())), "left long, right long, n long")
    pairs = stored(pairs.groupBy("left", "right").agg(F.sum("n").alias("n")), "pairs")
    total = np.zeros(items.size, np.int64)
    got = pairs.groupBy("left").agg(F.sum("n").alias("n")).toArrow()
    total[np.asarray(got.column("left"), np.int64)] = np.asarray(got.column("n"), np.int64)
    of = np.empty(items.size, np.int64)
    of[np.argsort(-total, kind="stable")] = 1 + np.arange(items.size) % (classes - 1)
    of[0] = END_CLASS
    best, best_of, best_both = -np.inf, of, np.zeros((classes, classes))
    for turn in range(rounds + 1):
        cells = _cells(pairs.mapInArrow(_neighbours(items.size, classes, spark.sparkContext.broadcast(of)), "cell long, n long"), 2 * items.size * classes)
        after, before = cells.reshape(2, items.size, classes).astype(float)
        value = likelihood(after, of, classes)
        if value > best:
            best, best_of, best_both = value, of, np.zeros((classes, classes))
            np.add.at(best_both, of, after)
        if turn < rounds:
            of = exchange(after, before, of, classes, turn)
    mid = np.flatnonzero((item < 0) & (n >= word_count))
    choices = [(items, best_of)]
    if len(mid):
        choices.append(_own_classes(texts, items, best_of, best_both, mid, items.by_pattern(*(x[mid] for x in spelling)), classes))
    for items, best_of in reversed(choices):
        shared = spark.sparkContext.broadcast((items.plain(), best_of))
        trigrams = _cells(texts.mapInArrow(_trigrams(classes, shared), "cell long, n long"), classes ** 3).reshape((classes,) * 3)
        if table_likelihood(trigrams.sum(axis=0).astype(float)) >= best:
            break
    got = words.mapInArrow(_totals(shared), "class long, n long, words long").groupBy("class").agg(F.sum("n"), F.sum("words")).toArrow()
    norm = np.ones(classes)
    norm[np.asarray(got.column(0), np.int64)] += np.asarray(got.column(1), np.int64) + np.asarray(got.column(2), np.int64)
    return Model(items, best_of, np.log10(witten_bell(trigrams)), np.log10(norm), tokens, distinct, many, words.select("word", "n"))


def _scorer(shared) -> Callable:
    def score(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, of, transition, norm = Items(*shared.value[0]), *shared.value[1:]
        for piece in blocks.batches(frames):
            tokens, rows, words, hashes, count, item = _sequences(piece, items)
            many = piece.num_rows
            now = of[tokens]
            one = np.concatenate([[END_CLASS], now[:-1]])[: len(now)]
            two = np.where(one == END_CLASS, END_CLASS, np.concatenate([[END_CLASS, END_CLASS], now[:-2]])[: len(now)])
            path = np.bincount(rows, weights=transition[two, one, now], minlength=many).astype(float)
            path -= np.bincount(words.row, weights=norm[of[item]], minlength=many)
            known = np.bincount(words.row, weights=count > 0, minlength=many).astype(np.int64)
            logs = np.bincount(words.row, weights=np.log10(np.maximum(count, 0) + 1.0), minlength=many).astype(float)
            rare = np.flatnonzero(count < 0)
            cut = np.searchsorted(words.row[rare], np.arange(many + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([piece.column("doc"), piece.column("key"), pa.array(np.diff(words.first) + 1), pa.array(known), pa.array(logs),
                                              pa.array(path), pa.ListArray.from_arrays(pa.array(cut), pa.array(hashes[rare].view(np.int64)))],
                                             ["doc", "key", "n_tokens", "known", "logs", "path", "rare"])

    return score


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score, perplexity): one row per row of ``docs``."""
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    source = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("key"), text.alias("text"))
    shared = spark.sparkContext.broadcast((model.items.plain(), model.class_of, model.transition, model.norm))
    schema = "doc long, key long, n_tokens long, known long, logs double, path double, rare array<long>"
    scored = stored(source.mapInArrow(_scorer(shared), schema), "scored")  # one pass over the texts
    none = F.lit(0).cast("long")
    whole = scored.select("doc", "key", F.lit(1).cast("long").alias("rows"), "n_tokens", "known", "logs", "path")
    seldom = scored.select("doc", "key", F.explode("rare").alias("word")).join(model.counts, "word")
    seldom = seldom.select("doc", "key", none.alias("rows"), none.alias("n_tokens"), F.lit(1).cast("long").alias("known"),
                           F.log10(F.col("n") + 1.0).alias("logs"), F.lit(0.0).alias("path"))
    sums = whole.union(seldom).groupBy("doc", "key").agg(*[F.sum(c).alias(c) for c in ("rows", "n_tokens", "known", "logs", "path")])
    each = [(F.col(c) / F.col("rows")).alias(c) for c in ("n_tokens", "known", "logs", "path")]  # equal rows were summed together
    sums = sums.select("doc", *each, F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    base = F.col("logs") + float(np.log10(model.texts + 1)) - F.col("n_tokens") * float(np.log10(model.tokens + model.words + 1))
    total = F.col("path") + F.col("logs")
    return sums.select(F.col("doc").alias(id_col), F.col("n_tokens").cast("long").alias("n_tokens"),
                       (F.col("known") + F.lit(int(model.texts > 0))).cast("long").alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
                       base.alias("base_score"), total.alias("score"), F.pow(F.lit(10.0), -total / F.col("n_tokens")).alias("perplexity"))
