"""Word- and character-level edit distance.

Of metric-cleaned strings both distances come from one pass through Python workers (``word_and_char_levenshtein``): blocks of 64
rows of the bit-parallel recurrence (Myers/Hyyrö), all blocks of many pairs at once in numpy, inside a band of diagonals that
the distance found proves wide enough.

Word edit distance over word arrays runs in the JVM: it is the character edit distance after mapping every distinct word of the
*pair* onto one code point (``levenshtein`` counts code points, so the two distances are equal). The mapping is built
per row from ``array_distinct(ref ++ hyp)``: with at most 255 distinct words, word k becomes ``char(k)``; otherwise
index k becomes code point ``0xFF + k`` below the surrogate block and a supplementary-plane code point (a UTF-16
surrogate pair) above it, which covers 1,103,872 distinct words per pair. A pair with more fails the task with a
clear error instead of returning a wrong number.

Character edit distance defaults to the numpy kernel; ``method="native"`` keeps it in the JVM.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from .text import _bind, jiwer_clean

_BMP_SLOTS = 0xD800 - 0x100  # code points 0x100..0xD7FF
MAX_DISTINCT_WORDS = _BMP_SLOTS + 0x100000


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(c) -> Column:
    """Metric word list: collapse ``\\s\\s+``, strip, split on single spaces, drop empty strings."""
    return words_of_cleaned(jiwer_clean(c))


def words_of_cleaned(cleaned: Column) -> Column:
    """Split an already metric-cleaned string: it has no leading/trailing whitespace and no two adjacent whitespace
    characters, so single-space splitting yields no empty word except for the empty string itself (no lambda)."""
    return F.when(cleaned == "", F.array().cast("array<string>")).otherwise(F.split(cleaned, " "))


def _hex4(n: Column) -> Column:
    return F.lpad(F.hex(n), 4, "0")


def encode_words(ws: Column, vocab: Column) -> Column:
    """One code point per word, by position of the word in ``vocab`` (``vocab`` should be a bound variable)."""

    def unit(w: Column) -> Column:
        k = F.array_position(vocab, w)
        s = k - F.lit(_BMP_SLOTS + 1)  # 0-based offset into the supplementary planes
        pair = F.concat(_hex4(F.lit(0xD800) + F.shiftright(s, 10)), _hex4(F.lit(0xDC00) + s.bitwiseAND(F.lit(0x3FF))))
        return F.when(k <= _BMP_SLOTS, _hex4(k + F.lit(0xFF))).otherwise(pair)

    checked = F.when(
        F.size(vocab) > MAX_DISTINCT_WORDS,
        F.raise_error(F.lit(f"word edit distance: more than {MAX_DISTINCT_WORDS} distinct words in one pair")),
    ).otherwise(F.array_join(F.transform(ws, unit), ""))
    return F.decode(F.unhex(checked), "UTF-16BE")


def encode_words_small(ws: Column, vocab: Column) -> Column:
    """One code point U+0001..U+00FF per word (vocabularies of at most 255 words)."""
    return F.array_join(F.transform(ws, lambda w: F.char(F.array_position(vocab, w))), "")


def word_edit_distance(ref_words: Column, hyp_words: Column, bound: Column | int | None = None,
                       method: str = "native") -> Column:
    """Levenshtein distance over word arrays; with ``bound`` returns -1 when the distance exceeds it.

    ``native`` (default) runs in the JVM on the code-point encoding; ``bitparallel`` factorises each Arrow batch's
    words and uses the vectorised kernel (faster on long utterances; ``bound`` is then applied to the exact value)."""
    if method == "bitparallel":
        d = _word_levenshtein_batches(ref_words, hyp_words)
        if bound is None:
            return d
        b = F.lit(bound) if isinstance(bound, int) else bound
        return F.when(d <= b, d).otherwise(F.lit(-1)).cast("int")
    pair = F.struct(ref_words.alias("a"), hyp_words.alias("b"))

    def body(p: Column) -> Column:
        def inner(t: Column) -> Column:
            # up to 255 distinct words: one Latin-1 code point per word via char(k) (far fewer string operations);
            # larger vocabularies use the surrogate-aware hex encoding
            small = F.size(t["v"]) <= 255
            a = F.when(small, encode_words_small(t["a"], t["v"])).otherwise(encode_words(t["a"], t["v"]))
            b = F.when(small, encode_words_small(t["b"], t["v"])).otherwise(encode_words(t["b"], t["v"]))
            if bound is None:
                return F.levenshtein(a, b)
            return F.call_function("levenshtein", a, b, F.lit(bound) if isinstance(bound, int) else p["bound"])

        return _bind(F.struct(p["a"].alias("a"), p["b"].alias("b"), F.array_distinct(F.concat(p["a"], p["b"])).alias("v")), inner)

    if bound is not None and not isinstance(bound, int):
        pair = F.struct(ref_words.alias("a"), hyp_words.alias("b"), bound.alias("bound"))
    return _bind(pair, body)


def bitparallel_levenshtein(a, b) -> int:
    """Exact edit distance in O(len(b) * len(a) / 64) word operations (bit-vector recurrence of Myers/Hyyro on
    Python integers): the columns of the DP matrix are kept as vertical +1/-1 delta bit masks over ``a``."""
    if len(a) < len(b):
        a, b = b, a  # iterate over the shorter string; the longer one is the bit pattern
    m = len(a)
    if m == 0:
        return len(b)
    places: dict[str, list[int]] = {}
    for i, ch in enumerate(a):
        places.setdefault(ch, []).append(i)

    def mask(ch) -> int:
        bits = bytearray(m // 8 + 1)
        for i in places.get(ch, ()):
            bits[i >> 3] |= 1 << (i & 7)
        return int.from_bytes(bits, "little")

    # the masks are kept while they are small together; those of a long line of many different words are made when needed
    peq = {ch: mask(ch) for ch in places} if len(places) * m <= 8 * MATCH_TABLE_BYTES else None
    full = (1 << m) - 1
    top = 1 << (m - 1)
    vp, vn, dist = full, 0, m
    for ch in b:
        x = (peq.get(ch, 0) if peq is not None else mask(ch)) | vn
        d0 = ((((x & vp) + vp) & full) ^ vp) | x
        hp = vn | (~(d0 | vp) & full)
        hn = d0 & vp
        if hp & top:
            dist += 1
        elif hn & top:
            dist -= 1
        hp = ((hp << 1) | 1) & full
        hn = (hn << 1) & full
        vp = hn | (~(d0 | hp) & full)
        vn = hp & d0
    return dist


# ---- the same recurrence over blocks of 64 rows, all blocks of many pairs at once (numpy) ------------------------
# At time t block k works on text position t - k, so that it needs what the block above gave one step earlier: one step
# is some twenty numpy operations over the blocks of all pairs of a group. Only blocks that meet a band of diagonals
# are worked on (Ukkonen); a pair whose distance does not prove that its band was wide enough is done again with it.
U64 = np.uint64
ONE = U64(1)
LANES = 4096  # blocks of a group
MATCH_TABLE_BYTES = 64 << 20
STEP_US, LANE_US, SCALAR_US, SCALAR_ROW_US = 40.0, 0.025, 2.0, 0.0006  # measured: a step, a block in it; the scalar kernel's step, a row in it


def _codes(s):
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)


def batch_levenshtein(pairs, max_words: int | None = None, chunk: int | None = None):
    """Edit distances of many pairs of strings or code arrays at once: pairs of like length are worked on together, few and long ones
    by the scalar kernel, as are those over ``max_words`` blocks; ``chunk`` bounds the pairs of a group. Exact (cross-checked against
    the scalar kernel and a DP in the tests)."""
    out = np.zeros(len(pairs), dtype=np.int64)
    todo = []
    for i, (a, b) in enumerate(pairs):
        if isinstance(a, str):
            if a == b:
                continue
            a, b = _codes(a), _codes(b)
        if len(a) < len(b):
            a, b = b, a
        if len(b) == 0:
            out[i] = len(a)
        elif max_words is not None and len(a) > 64 * max_words:
            out[i] = bitparallel_levenshtein(a.tolist(), b.tolist())
        else:
            todo.append((i, a, b))
    guess = 1.0
    again = []
    for group in _groups(todo, chunk):
        w = (len(group[-1][1]) + 63) // 64
        bounds = None if w <= 3 else [max(len(a) - len(b), int(guess * len(a)) + 8) for _, a, b in group]
        found, sure = _group_distances(group, bounds)
        out[[t[0] for t in group]] = found
        again += [t for t, s in zip(group, sure) if not s]
        if len(group) >= 8:  # longer pairs are taken to be about as much alike
            guess = min(1.0, 1.1 * float(np.quantile(found / [len(a) for _, a, _ in group], 0.95)))
    for group in _groups(again, chunk):
        out[[t[0] for t in group]], sure = _group_distances(group, [int(out[t[0]]) for t in group])
        assert all(sure)
    return out


def _groups(items, chunk):
    """Runs of pairs of like length; those of a run have at most ``LANES`` blocks together."""
    items = sorted(items, key=lambda t: (len(t[1]), len(t[2])))
    at = 0
    while at < len(items):
        end, most = at + 1, len(items[at][1]) * 1.2 + 32
        while end < len(items) and (m := len(items[end][1])) <= most and (end + 1 - at) * ((m + 63) // 64) <= LANES and (chunk is None or end - at < chunk):
            end += 1
        yield items[at:end]
        at = end


def _group_distances(group, bounds):
    """Distances of a group of pairs in a band that holds all paths of at most ``bounds`` edits (none: no band), and whether each is
    proved to be the whole table's."""
    P, m = len(group), len(group[-1][1])
    W = (m + 63) // 64
    band = W if bounds is None else min(W, max(bounds) // 64 + 2)
    if P * (SCALAR_US + SCALAR_ROW_US * m) < STEP_US + LANE_US * P * band:
        return np.array([bitparallel_levenshtein(a.tolist(), b.tolist()) for _, a, b in group]), [True] * P
    ca, cb, K = _dense([a for _, a, _ in group], [b for _, _, b in group], P * W * 8)
    if P * W * (K + 1) * 8 > MATCH_TABLE_BYTES:
        if P == 1:
            return np.array([bitparallel_levenshtein(ca[0].tolist(), cb[0].tolist())]), [True]
        halves = [_group_distances(group[x], bounds and bounds[x]) for x in (slice(P // 2), slice(P // 2, P))]
        return np.concatenate([h[0] for h in halves]), [*halves[0][1], *halves[1][1]]
    return _run_group(ca, cb, K, W, bounds)


def _dense(ca, cb, row_bytes):
    """The code arrays with codes from 0 on, and how many there are: numbered over the group, or for each pair where that table is too large."""
    P = len(ca)
    flat = np.concatenate(ca + cb)
    cuts = np.cumsum([len(x) for x in ca + cb])[:-1]
    if int(flat.max()) < 1 << 17:
        present = np.zeros(int(flat.max()) + 1, dtype=bool)
        present[flat] = True
        K, codes = int(present.sum()), (np.cumsum(present) - 1)[flat]
    else:
        values, codes = np.unique(flat, return_inverse=True)
        K = len(values)
    if P > 1 and row_bytes * (K + 1) > MATCH_TABLE_BYTES // 8:
        owner = np.repeat(np.tile(np.arange(P), 2), [len(x) for x in ca + cb])
        values, codes = np.unique(owner * K + codes, return_inverse=True)
        first = np.searchsorted(values, np.arange(P + 1) * K)
        codes, K = codes - first[owner], int(np.diff(first).max())
    parts = np.split(codes, cuts)
    return parts[:P], parts[P:], K


def _run_group(ca, cb, K, W, bounds):
    P, M = len(ca), 64 * W
    order = sorted(range(P), key=lambda p: -len(cb[p]))  # longest text first: the pairs that still run are a prefix
    ca, cb = [ca[p] for p in order], [cb[p] for p in order]
    ms, ns = np.array([len(x) for x in ca]), np.array([len(x) for x in cb])
    N, pad = int(ns[0]), M - ms  # rows above the pattern, that no character matches and that differ in nothing from the row over them
    delta = ms - ns
    if bounds is None:
        lo, hi = -N - 1, M
    else:
        k = np.array([bounds[p] for p in order])
        lo, hi = int((pad - np.maximum(0, (k - delta) // 2 + 1)).min()), int((pad + np.maximum(0, (k + delta) // 2 + 1)).max())
    # match table: bits of the block's rows that hold a character; its last column, no character, is empty
    peq = np.zeros(W * P * (K + 1), dtype=U64)
    rows = np.full((P, M), K, dtype=np.int64)
    rows[np.arange(M) >= pad[:, None]] = np.concatenate(ca)
    base = (np.arange(W)[:, None] * P + np.arange(P)) * (K + 1)
    for bit in range(64):
        peq[base + rows[:, bit::64].T] |= ONE << U64(bit)
    peq[K::K + 1] = 0
    base = base.ravel()
    text = np.full((P, N), K, dtype=np.int64)
    text[np.arange(N) < ns[:, None]] = np.concatenate(cb)
    text = np.ascontiguousarray(text[:, ::-1].T).ravel()  # last position first, so that later blocks read on
    bits = np.arange(M) >= pad[:, None]
    pv = np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little").view(U64).T).ravel()
    mv = np.zeros(W * P, dtype=U64)
    over = [(np.zeros((W + 1) * P, dtype=U64), np.zeros((W + 1) * P, dtype=U64)) for _ in range(2)]  # +1 and -1 from the block above: read, written
    for plus, _ in over:
        plus[:P] = 1
    ks = np.arange(W)
    start = (ks + np.maximum(0, 64 * ks - hi)).tolist()
    stop = (ks + np.minimum(N - 1, 64 * ks + 63 - lo)).tolist()
    start.append(-1)
    eq, xv, x, ph = (np.empty(W * P, dtype=U64) for _ in range(4))
    at = np.empty(W * P, dtype=np.int64)
    found = ms.astype(np.int64)
    cnt, live = P, ns.tolist()
    first = last = 0
    for t in range(stop[W - 1] + 1):
        while stop[first] < t:
            first += 1
        while last + 1 < W and start[last + 1] <= t:
            last += 1
        i, j = first * P, (last + 1) * P
        n, s = j - i, N - 1 - t
        (plus, minus), (plus2, minus2) = over[t & 1], over[1 - (t & 1)]
        hp, hn, v, u = plus[i:j], minus[i:j], pv[i:j], mv[i:j]
        e, y, z, h, g = eq[:n], xv[:n], x[:n], ph[:n], at[:n]
        np.add(base[i:j], text[(s + first) * P:(s + last + 1) * P], out=g)
        peq.take(g, out=e, mode="clip")
        np.bitwise_or(e, u, out=y)
        np.bitwise_or(e, hn, out=e)
        np.bitwise_and(e, v, out=z)
        np.add(z, v, out=z)
        np.bitwise_xor(z, v, out=z)
        np.bitwise_or(z, e, out=z)
        np.bitwise_or(z, v, out=h)
        np.invert(h, out=h)
        np.bitwise_or(h, u, out=h)
        np.bitwise_and(z, v, out=z)
        np.right_shift(h, U64(63), out=plus2[i + P:j + P])
        np.right_shift(z, U64(63), out=minus2[i + P:j + P])
        np.left_shift(h, ONE, out=h)
        np.bitwise_or(h, hp, out=h)
        np.left_shift(z, ONE, out=z)
        np.bitwise_or(z, hn, out=z)
        np.bitwise_or(y, h, out=v)
        np.invert(v, out=v)
        np.bitwise_or(v, z, out=v)
        np.bitwise_and(h, y, out=u)
        if first:  # above the band each step right costs one
            plus2[i:i + P] = 1
            minus2[i:i + P] = 0
        if last == W - 1:
            while live[cnt - 1] <= t - last:
                cnt -= 1
            found[:cnt] += plus2[j:j + cnt].astype(np.int64) - minus2[j:j + cnt].astype(np.int64)
        elif start[last + 1] != t + 1:  # the last row known so far, up to where the next block goes on from it
            found += plus2[j:j + P].astype(np.int64) - minus2[j:j + P].astype(np.int64)
    sure = (found + delta <= 2 * (hi - pad)) & (found - delta <= 2 * (pad - lo))
    back = np.argsort(order)
    return found[back], sure[back].tolist()


BATCH_CHARS = 8 << 20


def _pair_edits(frames, measures):
    """For each batch of (reference, hypothesis) its pairs' distances by ``measures``, names to functions of a list of pairs. Batches are taken
    together up to ``BATCH_CHARS``, so that there are more pairs of like length to work on at once."""
    held, size = [], 0

    def scored():
        pairs = [(x, y) if isinstance(x, str) and isinstance(y, str) else None for a, b in held for x, y in zip(a, b)]
        keep = [i for i, p in enumerate(pairs) if p is not None]
        found = {}
        for name, distances in measures.items():
            column = np.zeros(len(pairs), dtype=np.int64)
            column[keep] = distances([pairs[i] for i in keep])
            found[name] = pd.Series(column, dtype="Int64")
            found[name][[i for i, p in enumerate(pairs) if p is None]] = pd.NA
        out, at = pd.DataFrame(found), 0
        for a, _ in held:
            yield out.iloc[at:at + len(a)].reset_index(drop=True)
            at += len(a)

    for a, b in frames:
        held.append((a, b))
        size += sum(len(x) for x in a if x is not None) + sum(len(x) for x in b if x is not None)
        if size >= BATCH_CHARS:
            yield from scored()
            held, size = [], 0
    if held:
        yield from scored()


def _word_distances(pairs):
    """Word lists by splitting cleaned strings at single blanks; the words of a pair are numbered."""
    coded = []
    for a, b in pairs:
        number = defaultdict(count().__next__).__getitem__
        coded.append(tuple(np.fromiter(map(number, s.split(" ") if s else ()), dtype=np.int64) for s in (a, b)))
    return batch_levenshtein(coded)


_WORDS, _CHARS = StructType().add("words", IntegerType()), StructType().add("chars", LongType())


@F.pandas_udf(StructType().add("words", IntegerType()).add("chars", LongType()))
def word_and_char_levenshtein(frames: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Word and character edit distance of two metric-cleaned strings (null: null)."""
    return _pair_edits(frames, {"words": _word_distances, "chars": batch_levenshtein})


@F.pandas_udf(_WORDS)
def word_levenshtein(frames: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    return _pair_edits(frames, {"words": _word_distances})


@F.pandas_udf(_CHARS)
def char_levenshtein(frames: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    return _pair_edits(frames, {"chars": batch_levenshtein})


LONG_PAIR_CHARS = 256


@F.pandas_udf(LongType())
def _word_levenshtein_batches(a: pd.Series, b: pd.Series) -> pd.Series:
    """Word lists of a whole Arrow batch are factorised to integer codes together, then scored by the vectorised
    kernel (a word pair is usually one 64-bit word of state)."""
    keep = [i for i, (x, y) in enumerate(zip(a, b)) if x is not None and y is not None]
    out = pd.Series([None] * len(a), dtype="Int64", index=a.index)
    if not keep:
        return out
    la = [len(a.iloc[i]) for i in keep]
    lb = [len(b.iloc[i]) for i in keep]
    flat = [w for i in keep for w in a.iloc[i]] + [w for i in keep for w in b.iloc[i]]
    codes, _ = pd.factorize(pd.Series(flat, dtype=object))
    codes = codes.astype(np.int64)
    ea = np.cumsum(la)
    eb = np.cumsum(lb) + ea[-1]
    pairs = [(codes[ea[k] - la[k]: ea[k]], codes[eb[k] - lb[k]: eb[k]]) for k in range(len(keep))]
    out.iloc[keep] = batch_levenshtein(pairs)
    return out


def char_edit_distance(ref: Column, hyp: Column, method: str = "bitparallel", cleaned: bool = False) -> Column:
    """Levenshtein distance over code points of the metric-cleaned strings (CER numerator).

    ``bitparallel`` (default): the exact bit-vector recurrence, vectorised with numpy across all pairs of an Arrow
    batch (64 DP cells per machine-word operation; a 25k-character pair takes ~0.2 s instead of ~6 s cell by cell).
    Measured on the sf0.1 utterances it is ~4x faster than the JVM's ``levenshtein`` for every length bucket.
    ``native`` keeps the computation in the JVM; ``auto`` sends only pairs longer than ``LONG_PAIR_CHARS`` to Python.
    Pass ``cleaned=True`` when ``ref``/``hyp`` already went through ``jiwer_clean``."""
    a, b = (ref, hyp) if cleaned else (jiwer_clean(ref), jiwer_clean(hyp))
    if method == "native":
        return F.levenshtein(a, b)
    if method == "bitparallel":
        return char_levenshtein(a, b)["chars"]
    long_pair = F.greatest(F.char_length(a), F.char_length(b)) > F.lit(LONG_PAIR_CHARS)
    python = char_levenshtein(F.when(long_pair, a), F.when(long_pair, b))["chars"]
    return F.coalesce(python, F.when(~long_pair, F.levenshtein(a, b))).cast("long")


def char_count(ref: Column) -> Column:
    """CER denominator: code points of the cleaned reference."""
    return F.char_length(jiwer_clean(ref))


def wer_bound(n_ref_words: Column, threshold: float) -> Column:
    """Upper bound for the bounded distance: ``floor(threshold * n / 100)``; callers re-check the strict
    ``100 * d < threshold * n`` on the result, so float rounding in the bound can never change a decision."""
    return F.floor(F.lit(float(threshold)) * n_ref_words / F.lit(100.0)).cast("int")


def wer_below(distance: Column, n_ref_words: Column, threshold: float) -> Column:
    """F1 keep-predicate on a bounded distance: ``n > 0 AND 0 <= d AND 100 * d < threshold * n``."""
    return (n_ref_words > 0) & (distance >= 0) & (F.lit(100.0) * distance < F.lit(float(threshold)) * n_ref_words)
