"""Conversation repair against a plain dynamic program over whole audits, and its edge cases."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from auralith.llm import conversation_repair as repair


def kind(role, text, seen):
    if not re.search(r"[^\x20\x09-\x0D]", text):
        return "blank"
    if seen:
        return "duplicate"
    return "" if re.search(r"[.!?][\x20\x09-\x0D]*\Z", text) else "truncated"


def plain_repair(rows):
    """(audit, cost, lines) of one conversation's sorted rows (role, text): least (cost, audit) by recursion from the end."""
    seen, faults = set(), []
    for role, text in rows:
        faults.append(kind(role, text, (role, text) in seen))
        seen.add((role, text))
    follow = {"": "user", "s": "user", "u": "assistant", "a": "user"}
    best = {q: (0, "", []) if q in ("", "a") else None for q in follow}  # behind the last row

    def with_inserts(table):
        out = {}
        for q in follow:
            options, now, letters, lines = [], q, "", []
            for _ in range(4):
                if table[now] is not None:
                    c, a, rest = table[now]
                    options.append((c + 5 * len(letters), letters + a, lines + rest))
                lines, letters, now = [*lines, (follow[now], "")], letters + "I", follow[now][0]
            out[q] = min(options, key=lambda x: x[:2]) if options else None
        return out

    best = with_inserts(best)
    for (role, text), fault in reversed(list(zip(rows, faults))):
        stay, table = 5 * (fault == "truncated"), {}
        for q in follow:
            options = [(best[q][0] + 2, "D" + best[q][1], best[q][2])] if best[q] else []
            if fault not in ("blank", "duplicate"):
                initial = role[:1]
                if (initial == "s" and q == "") or (initial and initial == follow[q][0]):
                    options += [(b[0] + stay, "K" + b[1], [(role, text), *b[2]]) for b in [best[initial]] if b]
                options += [(b[0] + 1 + stay, "R" + b[1], [(follow[q], text), *b[2]]) for b in [best[follow[q][0]]] if b]
            table[q] = min(options, key=lambda x: x[:2]) if options else None
        best = with_inserts(table)
    cost, audit, lines = best[""]
    return audit, cost, lines, faults


def plain_report(conv, rows):
    """``rows``: (turn, role, text) in order."""
    audit, cost, lines, faults = plain_repair([r[1:] for r in rows])
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
    return (conv, gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha)


def plain_reports(rows):
    convs = defaultdict(list)
    for conv, *row in rows:
        convs[conv].append(tuple(row))
    return sorted((plain_report(c, sorted(r, key=lambda x: (x[0] is not None, x[0] or 0))) for c, r in convs.items()), key=str)


def reports(spark, rows, parts=3, **options):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, cost string, void int").repartition(parts)
    return sorted((tuple(r) for r in repair.report(df, **options).collect()), key=str)


def random_rows(seed, conversations, longest, roles=("system", "user", "assistant", "tool", "u", "")):
    rng, rows = random.Random(seed), []
    for conv in range(conversations):
        turn = 0
        for _ in range(rng.randrange(1, longest + 1)):
            text = rng.choice(["Yes.", "No", " ", "", f"Line {rng.randrange(30)}.", f"cut {rng.randrange(30)} ", f"ok {rng.randrange(99)}!\n"])
            rows.append((conv, turn, rng.choices(roles, [1, 6, 6, 1, 1, 1])[0], text))
            turn += rng.choice([1, 1, 1, 2, 7])
    return rows


@pytest.mark.parametrize("fragment", [4096, 1, 3])
def test_reports_equal_the_plain_program(spark, fragment):
    rows = random_rows(fragment, 60, 12)
    assert reports(spark, rows, fragment=fragment) == plain_reports(rows)


def test_a_conversation_that_holds_a_third_of_all_rows(spark):
    rows = random_rows(5, 40, 10)
    rows += [(77, t, random.Random(t).choice(["user", "assistant", "assistant"]), f"t{t}" + ".?x"[t % 3]) for t in range(len(rows) // 2)]
    assert reports(spark, rows, fragment=8) == plain_reports(rows)


def test_copies_nulls_and_turns_without_a_number(spark):
    rows = [(1, None, "user", "Hi."), (1, 3, "user", "Hi."), (1, 3, "user", "Hi."), (1, 9, "assistant", "So."), (None, 2, "user", "x."),
            (None, 3, "assistant", "y."), (2, None, "system", "z."), (3, 5, None, None), (4, 1, "user", None), (5, 1, "system", "S.")]
    shown = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert reports(spark, rows, fragment=2) == plain_reports(shown)


def test_many_copies_of_one_row_cross_fragments(spark):
    rows = [(6, 0, "user", "Same.")] * 50 + [(6, 1, "assistant", "End.")] + [(7, 0, "user", "Other.")]
    got = reports(spark, rows, fragment=7)
    assert got == plain_reports(rows)
    assert [r for r in got if r[0] == 6][0][7] == "K" + "D" * 49 + "K"


def test_empty_table_and_conversations_without_rows(spark):
    assert reports(spark, []) == []
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    every = spark.createDataFrame([(3,), (3,), (None,)], "conv_id long")
    sha = hashlib.sha256(b"").hexdigest()
    assert sorted(map(tuple, repair.report(empty, every).collect()), key=str) == [(3, 0, 0, 0, 0, 0, 0, "", sha), (None, 0, 0, 0, 0, 0, 0, "", sha)]


def test_repaired_rows_follow_the_pattern(spark):
    rows = random_rows(9, 30, 9)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    convs = defaultdict(list)
    for r in repair.repaired(df, fragment=4).collect():
        convs[r.conv_id].append(r)
    want = {r[0]: r for r in plain_reports(rows)}
    for conv, got in convs.items():
        assert "".join(r.edit for r in got) == want[conv][7]
        stay = [r for r in got if r.line is not None]
        assert [r.line for r in stay] == list(range(1, len(stay) + 1))
        assert re.fullmatch(r"(s?(ua)+)?", "".join(r.role[0] for r in stay))
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in stay).encode()).hexdigest() == want[conv][8]


def test_every_short_role_pattern_has_the_least_audit():
    """All conversations of up to five sound rows, solved at once."""
    rows = [p for n in range(1, 6) for p in itertools.product("suat", repeat=n)]
    kinds = [np.array(["suat".index(c) for c in p], np.uint8) for p in rows]
    graph = repair.Graph(kinds, np.broadcast_to(repair._ACCEPT, (len(rows), 4)), np.ones(len(rows), bool))
    graph.rank()
    audits, state = graph.paths(np.zeros(len(rows), np.int64))
    assert set(state.tolist()) <= {0, 3}
    for p, audit, cost in zip(rows, audits, graph.starts()[:, 0].tolist()):
        want = plain_repair([(c, f"{i}.") for i, c in enumerate(p)])
        assert (audit.decode(), cost) == want[:2], p


def test_damage_is_drawn_from_the_key(spark):
    rows = [(c, t, r, x) for c in (1, 2, None) for t, (r, x) in enumerate([("user", "A. b! c?"), (None, None), ("assistant", "q")] * 12)] + [(4, None, "user", "z.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = []
    for c, t, r, x in rows:
        draw = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = r or " ", " " if x is None else x
        x = "" if draw == 1 else re.sub("[.!?]", "", x) if draw == 2 else x
        want += [(c, t, "user" if draw == 4 else r, x)] * (0 if draw == 0 else 2 if draw == 3 else 1)
    assert sorted(map(tuple, repair.damaged(df).collect()), key=str) == sorted(want, key=str)
