"""Conversation structure repair (operator 13).

The cheapest edits that turn each conversation's rows into the role pattern ``(s?(ua)+)?`` (initials of system, user,
assistant). Keep costs 0, Rerole to user or assistant 1, Delete 2 (required for blank rows and for rows whose role and
text were seen before), Insert of an empty row 5; a truncated row that stays adds 5. Of the cheapest edit sequences the one
whose initials (D, I, K, R) are least in ASCII is taken.

A conversation's rows are sorted by turn (nulls first; rows of one turn by a hash of role and text, so copies are adjacent)
by range partitioning, as one class byte per row, and cut into fragments of at most ``fragment`` rows, so a conversation of any
length is no single group. A fragment's edit graph has a node per row border and state of the pattern (nothing yet,
after system, after user, after assistant). A cost DP runs backwards over all fragments of a batch at once. The optimal
arcs are those that meet the DP's costs. Nodes are ranked by the least audits of 1, 2, 4, ... letters that leave them: the
rank at twice a length comes from a node's rank and that of the node its doubled pointer reaches. A letter and a node
fix the next node, so one pointer per node is enough, and the arc of least letter and rank is the least path's. The path
itself is read off through the doubled pointers, all its places at once.

Conversations of more than one fragment (long ones, and those that cross the border of a range partition) meet through
joins of neighbours at distances 1, 2, 4, ...: min-plus products of 4 x 4 cost matrices give each fragment the costs behind
it, and compositions of state maps give the state in which the least path enters it. No task holds more than a
fragment's letters. At the end texts are shuffled once, by conversation, next to their letters, and each conversation
is streamed through one SHA-256 (which has to read it in order) or written out as repaired rows.

Defined cases: null roles and texts are one space; a null conversation id is a conversation; rows with a null turn come
first and count for no gap; a role with another initial (or none) fits nowhere and is reroled or deleted; a conversation
without rows gives zeros, an empty audit and the hash of the empty string if its id is named in ``every``; an empty
table gives an empty result; columns other than the four are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auralith.llm.store import shuffle_partitions, stored

FRAGMENT = 4096
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5  # costs
_INF = 1 << 40
_LETTERS = np.frombuffer(b"DIKR", np.uint8)  # in ASCII order
_START, _SYSTEM, _USER, _ASSISTANT = range(4)  # states of the pattern
_INITIAL = "sua"  # classes 0, 1, 2; anything else is 3
_BLANK, _DUPLICATE, _CUT = 1, 2, 3  # a class byte is its initial's class plus 4 times its fault
_TURN = np.array([_USER, _USER, _ASSISTANT, _USER])  # the state that a user or assistant row leads to
_NEXT = np.array([[_SYSTEM, -1, -1, -1], [_USER, _USER, -1, _USER], [-1, -1, _ASSISTANT, -1], [-1] * 4])  # of a kept row, by class and state
_LEGAL = np.zeros((4, 4), bool)
_LEGAL[[0, 1, 2], [1, 2, 1]] = True  # su, ua, au
_ACCEPT = np.array([0, _INF, _INF, 0])
_SPACE = r"\x20\x09-\x0D"


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (conv_id, turn, role, text) with faults drawn from crc32 of ``conversation:turn``: one in twenty is dropped,
    emptied, robbed of its ``.!?``, repeated, or given the role user. Nulls (but for the ids themselves) are one space."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv_col, turn_col)])
    draw = F.crc32(key) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (role_col, text_col))
    text = F.when(draw == 1, "").when(draw == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    copies = F.when(draw == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.filter(draw != 0).select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
                                         F.when(draw == 4, "user").otherwise(role).alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def _states(column: np.ndarray) -> np.ndarray:
    """Columns of (n, 4) costs at the state each state's user-or-assistant row leads to."""
    return column[:, _TURN]


def _closed(cost: np.ndarray) -> np.ndarray:
    """Costs at a border once inserts there are counted: two are enough to reach any state that can be reached."""
    once = INSERT + _states(cost)
    return np.minimum(np.minimum(cost, once), INSERT + _states(once))


class Graph:
    """The edit graphs of some fragments (arrays of class bytes). Node ``4 * (first[f] + f + t) + q`` is fragment f's border before
    its row t (the last one: its end) in state q. ``ends``: (fragments, 4) costs behind the fragments' ends; ``last``:
    whether a fragment ends its conversation, so that rows may be inserted at its end."""

    def __init__(self, fragments: list[np.ndarray], ends: np.ndarray, last: np.ndarray):
        self.size = np.array([len(x) for x in fragments], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        self.border = self.first + np.arange(len(fragments))  # of each fragment's first row
        self.rows = np.concatenate(fragments).astype(np.int64) if fragments else np.zeros(0, np.int64)
        self.last = last
        self.cost = np.full((len(self.rows) + len(fragments), 4), _INF, np.int64)
        self._costs(ends)

    def _arcs(self, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Costs and allowed states of keeping, and costs of reroling, rows of the given class bytes."""
        initial, fault = kind & 3, kind >> 2
        stays = fault == _CUT
        free = ((fault == _BLANK) | (fault == _DUPLICATE)) * _INF
        return _NEXT[initial], KEEP + TRUNCATED * stays + free, REROLE + TRUNCATED * stays + free

    def _costs(self, ends: np.ndarray) -> None:
        order = np.argsort(-self.size, kind="stable")
        now = np.where(self.last[:, None], _closed(ends), ends)[order]
        self.cost[(self.border + self.size)[order]] = now
        for back in range(1, int(self.size.max(initial=0)) + 1):
            active = order[: int(np.searchsorted(-self.size[order], -back, side="right"))]
            now, at = now[: len(active)], self.size[active] - back
            to, keep, rerole = self._arcs(self.rows[self.first[active] + at])
            kept = np.where(to >= 0, np.take_along_axis(now, np.maximum(to, 0), axis=1), _INF) + keep[:, None]
            best = np.minimum(np.minimum(DELETE + now, kept), rerole[:, None] + _states(now))
            now = np.minimum(_closed(best), _INF)
            self.cost[self.border[active] + at] = now

    def starts(self) -> np.ndarray:
        """(fragments, 4): costs from each fragment's beginning, by entry state."""
        return self.cost[self.border]

    def rank(self) -> None:
        """Optimal arcs, ranks of the nodes at doubling audit lengths, and the doubled pointers."""
        n = len(self.cost)
        end = np.zeros(n, bool)
        end[self.border + self.size] = True
        row = np.cumsum(~end) - 1  # of the border's own row
        kind = self.rows[np.minimum(row, max(0, len(self.rows) - 1))] if len(self.rows) else np.zeros(n, np.int64)
        to, keep, rerole = self._arcs(kind)
        inserts = np.ones(n, bool)
        inserts[(self.border + self.size)[~self.last]] = False
        border, state = np.arange(n)[:, None], np.arange(4)[None, :]
        after = np.minimum(border + 1, n - 1)
        target = np.stack([np.broadcast_to(4 * after + state, (n, 4)), 4 * border + _TURN, 4 * after + np.maximum(to, 0), 4 * after + _TURN], axis=2)
        price = np.stack(np.broadcast_arrays(
            np.where(end, _INF, DELETE)[:, None], np.where(inserts, INSERT, _INF)[:, None],
            np.where((to >= 0) & ~end[:, None], keep[:, None], _INF), np.where(end, _INF, rerole)[:, None]), axis=2)
        target, flat = target.reshape(4 * n, 4), self.cost.ravel()
        optimal = (flat[:, None] == price.reshape(4 * n, 4) + flat[target]) & (flat < _INF)[:, None]
        some = optimal.any(axis=1)
        letter = np.where(some, optimal.argmax(axis=1), -1)
        pointer = np.where(some, target[np.arange(4 * n), np.maximum(letter, 0)], np.arange(4 * n))
        rank, self.steps, self.pointers = letter + 1, some.astype(np.int64), [pointer]
        while (pointer[pointer] != pointer).any():
            pairs = rank * (int(rank.max()) + 1) + rank[pointer]
            rank = np.unique(pairs, return_inverse=True)[1]
            self.steps = self.steps + self.steps[pointer]
            pointer = pointer[pointer]
            self.pointers.append(pointer)
        places = np.where(optimal, np.arange(4) * (int(rank.max(initial=0)) + 1) + rank[target], np.iinfo(np.int64).max)
        self.letter = _LETTERS[places.argmin(axis=1)]  # least letter, then least rank behind it

    def paths(self, entries: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """The least audit of each fragment entered in the given state, and the state it leaves in."""
        start = 4 * self.border + entries
        steps = self.steps[start]
        node = np.repeat(start, steps)
        place = np.arange(len(node)) - np.repeat(np.cumsum(steps) - steps, steps)
        for k, pointer in enumerate(self.pointers):
            node = np.where(place >> k & 1, pointer[node], node)
        letters, stop = self.letter[node].tobytes(), np.cumsum(steps)
        return [letters[a:b] for a, b in zip(np.concatenate([[0], stop[:-1]]).tolist(), stop.tolist())], self.pointers[-1][start] & 3


def _graphs(frames: Iterator[pa.RecordBatch], ends: Callable, limit: int = 100_000) -> Iterator[tuple[pa.RecordBatch, Graph]]:
    """Batches of fragments of about ``limit`` rows with their graphs; ``ends`` gives a batch's costs behind its ends."""
    for frame in frames:
        kinds = [np.frombuffer(x, np.uint8) for x in frame.column("kinds").to_pylist()]
        total, at = np.cumsum([len(x) for x in kinds]), 0
        while at < len(kinds):
            stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + limit, side="right")))
            piece = frame.slice(at, stop - at)
            last = np.asarray(piece.column("last").to_pylist(), bool)
            yield piece, Graph(kinds[at:stop], ends(piece, last), last)
            at = stop


def _cutter(size: int) -> Callable:
    """Fragments of sorted rows (void, conv, turn, h1, h2, first and further class byte, times)."""

    def cut(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, out = 0, [], []  # held: pieces of the open fragment, as (turn, h1, h2, class bytes)

        def close() -> None:
            nonlocal number, held
            turns = [t for t, *_ in held if t is not None]
            distinct = sum(1 for i, t in enumerate(turns) if not i or t != turns[i - 1])
            out.append((*owner, number, *held[0][:3], b"".join(x[3] for x in held), turns[0] if turns else None, turns[-1] if turns else None, distinct))
            number, held = number + 1, []

        owner, open_rows = None, 0
        names = ["void", "conv", "number", "turn", "h1", "h2", "kinds", "least_turn", "most_turn", "turns"]
        types = [pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        for frame in frames:
            for void, conv, turn, h1, h2, kind, more, times in zip(*(c.to_pylist() for c in frame.columns)):
                if held and owner != (void, conv):
                    close()
                    open_rows = 0
                owner, left, lead = (void, conv), times, kind
                while left:
                    take = min(left, size - open_rows)
                    held.append((turn, h1, h2, bytes([lead]) + bytes([more]) * (take - 1)))
                    left, lead, open_rows = left - take, more, open_rows + take
                    if open_rows == size:
                        close()
                        open_rows = 0
                if len(out) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                    out.clear()
        if held:
            close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return cut


def _costs_behind(piece: pa.RecordBatch, last: np.ndarray) -> np.ndarray:
    """The column ``behind`` where it is given, the pattern's own end elsewhere."""
    return np.array([_ACCEPT if x is None else x for x in piece.column("behind").to_pylist()], np.int64).reshape(-1, 4)


def _matrices(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fragment's 4 x 4 costs from entry to exit state (row by row)."""
    def exit_at(j: int) -> Callable:
        return lambda piece, last: np.broadcast_to(np.where(np.arange(4) == j, 0, _INF), (piece.num_rows, 4))

    for frame in frames:
        frame = frame.set_column(frame.schema.get_field_index("last"), "last", pa.array([False] * frame.num_rows))
        columns = [np.concatenate([g.starts() for _, g in _graphs(iter([frame]), exit_at(j))]) for j in range(4)] if frame.num_rows else []
        if columns:
            m = np.stack(columns, axis=2).reshape(-1, 16)
            yield pa.RecordBatch.from_arrays([frame.column(c) for c in ("void", "conv", "at")] + [pa.array(m.tolist(), pa.list_(pa.int64()))], ["void", "conv", "at", "m"])


def _exits(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state in which the least path leaves each fragment, for each entry state."""
    for piece, graph in _graphs(frames, _costs_behind):
        graph.rank()
        to = np.stack([graph.paths(np.full(piece.num_rows, q))[1] for q in range(4)], axis=1)
        yield pa.RecordBatch.from_arrays([piece.column(c) for c in ("void", "conv", "at")] + [pa.array(to.tolist(), pa.list_(pa.int64()))], ["void", "conv", "at", "to"])


def _audits(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fragment's letters, its cost to the conversation's end, and the counts of its faults and illegal pairs."""
    for piece, graph in _graphs(frames, _costs_behind):
        graph.rank()
        entries = np.asarray(piece.column("entry"), np.int64)
        letters, _ = graph.paths(entries)
        initial, fault = graph.rows & 3, graph.rows >> 2
        pair = np.append(~_LEGAL[initial[:-1], initial[1:]], False).astype(np.int64)
        pair[graph.first + graph.size - 1] = 0
        counts = [np.add.reduceat((fault == k).astype(np.int64), graph.first) for k in (_BLANK, _DUPLICATE, _CUT)] + [np.add.reduceat(pair, graph.first)]
        facts = [graph.starts()[np.arange(len(entries)), entries], *counts, initial[graph.first], initial[graph.first + graph.size - 1]]
        keep = ["void", "conv", "part", "number", "turn", "h1", "h2", "least_turn", "most_turn", "turns"]
        yield pa.RecordBatch.from_arrays([piece.column(c) for c in keep] + [pa.array(letters, pa.binary())] + [pa.array(x, pa.int64()) for x in facts],
                                         [*keep, "letters", "cost", "blank", "duplicate", "truncated", "illegal", "head", "tail"])


def _plus(a: Column, b: Column) -> Column:
    """Min-plus product of two 4 x 4 matrices (arrays of 16)."""
    cell = [F.least(F.lit(_INF), *[a[4 * i + k] + b[4 * k + j] for k in range(4)]) for i in range(4) for j in range(4)]
    return F.array(*cell)


def _entered(fragments: DataFrame) -> DataFrame:
    """``fragments`` of conversations of more than one, with the costs ``behind`` each (null: the last one) and the state of ``entry``."""
    key = ["void", "conv"]
    place = F.row_number().over(Window.partitionBy(*key).orderBy("part", "number")) - 1  # fragments, not rows
    numbered = stored(fragments.withColumn("at", place.cast("long")), "fragments")
    longest = numbered.agg(F.max("at")).first()[0] or 0

    def beside(df: DataFrame, distance: int, column: str) -> DataFrame:
        """``df`` with ``other``: ``column`` of the fragment ``distance`` further on (null: none)."""
        other = df.select(*key, (F.col("at") - distance).alias("at"), F.col(column).alias("other"))
        return df.join(other, [*key, "at"], "left")

    after = stored(numbered.select(*key, "at", "kinds", F.lit(False).alias("last")).mapInArrow(_matrices, "void boolean, conv long, at long, m array<long>"), "matrices")
    distance = 1
    while distance <= longest:
        joined = F.when(F.col("other").isNull(), F.col("m")).otherwise(_plus(F.col("m"), F.col("other")))
        after, distance = stored(beside(after, distance, "m").select(*key, "at", joined.alias("m")), "matrices"), 2 * distance
    end = _closed(_ACCEPT[None, :])[0].tolist()
    behind = F.array(*[F.least(*[F.col("m")[4 * q + j] + end[j] for j in range(4)]) for q in range(4)])
    behind = after.select(*key, (F.col("at") - 1).alias("at"), behind.alias("behind"))
    numbered = stored(numbered.join(behind, [*key, "at"], "left").withColumn("last", F.col("behind").isNull()), "fragments")
    before = stored(numbered.select(*key, "at", "kinds", "last", "behind").mapInArrow(_exits, "void boolean, conv long, at long, to array<long>"), "exits")
    distance = 1
    while distance <= longest:
        chained = F.when(F.col("other").isNull(), F.col("to")).otherwise(F.transform("other", lambda x: F.get(F.col("to"), x.cast("int"))))
        before, distance = stored(beside(before, -distance, "to").select(*key, "at", chained.alias("to")), "exits"), 2 * distance
    entry = before.select(*key, (F.col("at") + 1).alias("at"), F.col("to")[_START].alias("entry"))
    return numbered.join(entry, [*key, "at"], "left").withColumn("entry", F.coalesce("entry", F.lit(_START).cast("long"))).drop("at")


class _Report:
    """Folds one conversation's fragments and rows, in order, into the report's row."""

    fields = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    schema = "void boolean, conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

    def __init__(self, owner: tuple):
        self.owner, self.counts, self.cost, self.audit = owner, [0, 0, 0, 0], None, []
        self.least = self.most = self.tail = None
        self.turns, self.lines, self.digest = 0, 0, hashlib.sha256()

    def fragment(self, letters: bytes, cost: int, counts: list[int], head: int, tail: int, least: int | None, most: int | None, turns: int) -> None:
        self.cost = cost if self.cost is None else self.cost
        self.counts = [a + b for a, b in zip(self.counts, counts)]
        self.counts[3] += self.tail is not None and not _LEGAL[self.tail, head]
        self.tail = tail
        self.audit.append(letters)
        if least is not None:
            self.turns += turns - (least == self.most)
            self.least, self.most = least if self.least is None else self.least, most

    def line(self, edit: str, turn: int | None, role: str, text: str) -> Iterator[tuple]:
        if edit != "D":
            self.digest.update((b"\n" if self.lines else b"") + f"{role}:{text}".encode())
            self.lines += 1
        return iter(())

    def close(self) -> Iterator[tuple]:
        gaps = 0 if self.least is None else min(self.most - self.least + 1 - self.turns, (1 << 63) - 1)
        yield (*self.owner, gaps, *self.counts, self.cost or 0, b"".join(self.audit).decode(), self.digest.hexdigest())


class _Lines(_Report):
    """Writes one row per edit instead."""

    fields = ["line", "edit", "turn", "role", "text"]
    schema = "void boolean, conv long, line long, edit string, turn long, role string, text string"

    def line(self, edit: str, turn: int | None, role: str, text: str) -> Iterator[tuple]:
        self.lines += edit != "D"
        yield (*self.owner, None if edit == "D" else self.lines, edit, turn, role, text)

    def close(self) -> Iterator[tuple]:
        return iter(())


def _streamer(fold: type[_Report]) -> Callable:
    """Applies letters to the rows that follow them (sorted by conversation, place, letters before texts)."""
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(fold.schema).fields
    types = [{"boolean": pa.bool_(), "bigint": pa.int64(), "string": pa.string()}[f.dataType.simpleString()] for f in fields]
    names = [f.name for f in fields]

    def walk(frames: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, letters, state = None, iter(b""), _START
        waiting: list[bytes] = []

        def edits(rest: bool) -> Iterator[int]:
            """The next letters up to and with the one of a row; with ``rest``, all that are left."""
            nonlocal letters
            while True:
                one = next(letters, None)
                if one is None:
                    if not waiting:
                        return
                    letters = iter(waiting.pop(0))
                    continue
                yield one
                if one != 73 and not rest:  # I
                    return

        def applied(rest: bool, turn: int | None = None, role: str = "", text: str = "") -> Iterator[tuple]:
            nonlocal state
            for one in edits(rest):
                edit = chr(one)
                if edit == "D":
                    yield from now.line(edit, turn, role, text)
                    continue
                state = int(_NEXT[_INITIAL.find(role[:1]) if role[:1] else 3, state]) if edit == "K" else int(_TURN[state])
                mine = role if edit == "K" else "user" if state == _USER else "assistant"
                yield from now.line(edit, turn if edit != "I" else None, mine, text if edit != "I" else "")

        for frame in frames:
            for void, conv, kind, turn, role, text, letter, cost, blank, duplicate, truncated, illegal, head, tail, least, most, turns in zip(*(c.to_pylist() for c in frame.columns)):
                if now is None or now.owner != (void, conv):
                    if now is not None:
                        yield from applied(True)
                        yield from now.close()
                    now, state = fold((void, conv)), _START
                    letters, waiting = iter(b""), []
                if kind == 1:
                    waiting.append(letter)
                    now.fragment(letter, cost, [blank, duplicate, truncated, illegal], head, tail, least, most, turns)
                elif kind == 2:
                    yield from applied(False, turn, role, text)
        if now is not None:
            yield from applied(True)
            yield from now.close()

    def stream(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for row in walk(frames):
            out.append(row)
            size += len(row[-1] or "") + 64
            if size > 1 << 21:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return stream


def _repaired(rows: DataFrame, every: DataFrame | None, conv_col: str, turn_col: str, role_col: str, text_col: str, fragment: int, fold: type[_Report]) -> DataFrame:
    parts = shuffle_partitions(rows.sparkSession)
    conv = F.col(conv_col).cast("long")
    owner = [conv.isNull().alias("void"), F.coalesce(conv, F.lit(0)).alias("conv")]
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(n) for c, n in ((role_col, "role"), (text_col, "text")))
    source = rows.select(*owner, F.col(turn_col).cast("long").alias("turn"), role, text)
    source = source.withColumns({"h1": F.xxhash64("role", "text"), "h2": F.xxhash64(F.lit(13), "role", "text")})
    initial, place = F.substring("role", 1, 1), ["void", "conv", "turn", "h1", "h2"]
    initial = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    blank, whole = ~F.col("text").rlike(f"[^{_SPACE}]"), F.col("text").rlike(f"[.!?][{_SPACE}]*\\z")
    facts = source.select(*place, initial.alias("initial"), F.when(blank, _BLANK).when(~whole, _CUT).otherwise(0).alias("fault"))
    facts = facts.groupBy(*place, "initial", "fault").agg(F.count(F.lit(1)).alias("times"))
    turn = F.struct(F.col("turn").isNotNull().alias("known"), "turn")  # nulls first
    firsts = facts.groupBy("void", "conv", "h1", "h2").agg(F.min(turn)["turn"].alias("first"))
    facts = facts.join(firsts, ["void", "conv", "h1", "h2"])
    fault = F.when(F.col("fault") == _BLANK, _BLANK).when(~F.col("turn").eqNullSafe(F.col("first")), _DUPLICATE).otherwise(F.col("fault"))
    more = F.when(F.col("fault") == _BLANK, _BLANK).otherwise(_DUPLICATE)
    facts = facts.select(*place, (F.col("initial") + 4 * fault).alias("kind"), (F.col("initial") + 4 * more).alias("more"), "times")
    ordered = facts.repartitionByRange(parts, *place).sortWithinPartitions(*place)
    cut = ordered.mapInArrow(_cutter(fragment), "void boolean, conv long, number long, turn long, h1 long, h2 long, kinds binary, least_turn long, most_turn long, turns long")
    fragments = stored(cut.withColumn("part", F.spark_partition_id()), "fragments")
    many = fragments.groupBy("void", "conv").agg(F.count(F.lit(1)).alias("many")).filter("many > 1").select("void", "conv")
    single = fragments.join(many, ["void", "conv"], "left_anti").withColumns(
        {"behind": F.lit(None).cast("array<long>"), "last": F.lit(True), "entry": F.lit(_START).cast("long")})
    if many.head(1):
        single = single.unionByName(_entered(fragments.join(many, ["void", "conv"], "left_semi")))
    audits = single.mapInArrow(_audits, "void boolean, conv long, part int, number long, turn long, h1 long, h2 long, least_turn long, most_turn long, turns long, letters binary, "
                                        "cost long, blank long, duplicate long, truncated long, illegal long, head long, tail long")
    stream = audits.withColumn("kind", F.lit(1)).unionByName(source.withColumn("kind", F.lit(2)), allowMissingColumns=True)
    if every is not None:
        stream = stream.unionByName(every.select(*owner).distinct().withColumn("kind", F.lit(0)), allowMissingColumns=True)
    stream = stream.withColumn("named", F.col("kind") > 0).repartition(parts, "void", "conv")
    stream = stream.sortWithinPartitions("void", "conv", "named", "turn", "h1", "h2", "kind", "part", "number").select(
        "void", "conv", "kind", "turn", "role", "text", "letters", "cost", "blank", "duplicate", "truncated", "illegal", "head", "tail", "least_turn", "most_turn", "turns")
    out = stream.mapInArrow(_streamer(fold), fold.schema)
    return out.select(F.when(~F.col("void"), F.col("conv")).alias(conv_col), *fold.fields)


def report(rows: DataFrame, every: DataFrame | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text", fragment: int = FRAGMENT) -> DataFrame:
    """One row per conversation: its id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 (of
    ``role:text`` lines). ``every``: rows that name conversations which are reported even without rows."""
    return _repaired(rows, every, conv_col, turn_col, role_col, text_col, fragment, _Report)


def repaired(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
             fragment: int = FRAGMENT) -> DataFrame:
    """One row per edit: conversation id, line (from 1 among the rows that stay; null: deleted), edit (K, R, D, I), turn (null:
    inserted), role, text."""
    return _repaired(rows, None, conv_col, turn_col, role_col, text_col, fragment, _Lines)


def _oracle() -> str:
    """The report in SQL: crc32 bit by bit, then one row per recursion step from each conversation's end, keeping for each
    state the least string of cost (12 digits) and audit."""
    def plus(value: str, cost: str, letters: str) -> str:
        return f"lpad(CAST(CAST(left({value}, 12) AS BIGINT) + {cost} AS VARCHAR), 12, '0') || '{letters}' || substr({value}, 13)"

    worst = "'" + str(10 ** 11) + "~'"
    row = []
    for q, (turn, opens) in enumerate(((2, "su"), (2, "u"), (3, "a"), (2, "u"))):
        keep = " ".join(f"WHEN i = '{x}' THEN {plus(f'w{dict(s=1, u=2, a=3)[x]}', 'extra', 'K')}" for x in opens)
        row.append(f"least({plus(f'w{q}', '2', 'D')}, CASE WHEN fault IN (1, 2) THEN {worst} ELSE least(CASE {keep} ELSE {worst} END, "
                   f"{plus(f'w{turn}', '1 + extra', 'R')}) END) AS b{q}")
    closed = [f"least(b{q}, {plus(f'b{a}', '5', 'I')}, {plus(f'b{b}', '10', 'II')}) AS w{q}" for q, (a, b) in enumerate(((2, 3), (2, 3), (3, 2), (2, 3)))]
    ends = [f"lpad('{c}', 12, '0') || '{a}'" for c, a in ((0, ""), (10, "II"), (5, "I"), (0, ""))]
    space, text = "[^\\x20\\x09-\\x0D]", "CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(t, '[.!?]', '', 'g') ELSE t END"
    bits = "flatten(list_transform(string_split(k, ''), lambda c: list_transform(range(8), lambda j: (ascii(c) >> j) & 1)))"
    xor = "lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))"
    return f"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS r, coalesce(text, ' ') AS t,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
d AS (SELECT conv_id, turn, r, t, xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), {xor}), 4294967295::BIGINT) % 20 AS draw FROM k),
m AS (SELECT conv_id, turn, CASE draw WHEN 4 THEN 'user' ELSE r END AS role, {text} AS text, unnest(CASE draw WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
      FROM d WHERE draw <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n,
             row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen FROM m),
f AS (SELECT *, left(role, 1) AS i, CASE WHEN NOT regexp_matches(text, '{space}') THEN 1 WHEN seen > 1 THEN 2
             WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 3 ELSE 0 END AS fault,
             lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) || left(role, 1) AS pair FROM o),
g AS (SELECT conv_id, max(n) AS n, CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps,
             count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
             count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
w AS (SELECT conv_id, n, {", ".join(f"{e} AS w{q}" for q, e in enumerate(ends))} FROM g
      UNION ALL
      SELECT conv_id, n, {", ".join(closed)} FROM (
        SELECT w.conv_id, w.n - 1 AS n, {", ".join(row)}
        FROM w JOIN (SELECT *, CASE fault WHEN 3 THEN 5 ELSE 0 END AS extra FROM f) f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.n = w.n)),
a AS (SELECT conv_id, left(w0, 12)::BIGINT AS cost, substr(w0, 13) AS audit FROM w WHERE n = 0),
e AS (SELECT conv_id, unnest(string_split(audit, '')) AS edit, generate_subscripts(string_split(audit, ''), 1) AS pos FROM a WHERE audit <> ''),
p AS (SELECT *, count(*) FILTER (edit <> 'I') OVER x AS n, count(*) FILTER (edit <> 'D') OVER x AS line FROM e
      WINDOW x AS (PARTITION BY conv_id ORDER BY pos)),
l AS (SELECT p.conv_id, p.pos, p.edit, p.line, f.i, f.role, f.text,
             max(CASE WHEN p.line = 1 AND p.edit = 'K' AND f.i = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY p.conv_id) AS opens
      FROM p LEFT JOIN f ON p.edit <> 'I' AND f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.n = p.n WHERE p.edit <> 'D'),
t AS (SELECT conv_id, string_agg(CASE edit WHEN 'K' THEN role ELSE CASE WHEN (line - opens) % 2 = 1 THEN 'user' ELSE 'assistant' END END
             || ':' || CASE edit WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY pos) AS body FROM l GROUP BY conv_id)
SELECT c.conv_id, coalesce(g.gaps, 0)::BIGINT AS gaps, coalesce(g.blank, 0)::BIGINT AS blank, coalesce(g.duplicate, 0)::BIGINT AS duplicate,
       coalesce(g.truncated, 0)::BIGINT AS truncated, coalesce(g.illegal, 0)::BIGINT AS illegal, coalesce(a.cost, 0)::BIGINT AS cost,
       coalesce(a.audit, '') AS audit, sha256(coalesce(t.body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM c.conv_id
"""


SQL = _oracle()
