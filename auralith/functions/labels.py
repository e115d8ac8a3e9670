"""Label-array functions (L1-L11, T14/T15/T17/T18) as native array expressions.

Token ids follow the public multilingual Whisper vocabulary for special tokens; ordinary text tokens come from a
pluggable vocabulary function (default: a toy rule, ``100 + char_length(word)``, so that both engines agree).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auralith.functions.edit import words

# Special token ids of the multilingual Whisper vocabulary.
EOT = 50257
SOT = 50258
LANG = {"en": 50259, "de": 50261, "es": 50262, "fr": 50265, "ja": 50266}
TRANSLATE = 50358
TRANSCRIBE = 50359
PREV = 50361
NOTIMESTAMPS = 50363  # the reference's ``timestamp_begin``: every id >= this is a timestamp or <|notimestamps|>
TIMESTAMP_FIRST = 50364  # <|0.00|>; 1501 timestamp tokens follow in steps of 0.02 s
TIMESTAMP_COUNT = 1501
PAD_LABEL = -100
MULTILINGUAL_PREFIX = 3  # SOT, language, task


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def toy_token_ids(text) -> Column:
    """T17 stand-in tokenizer: one id per metric word, ``100 + char_length(word)``."""
    return F.transform(words(_c(text)), lambda w: (F.char_length(w) + 100).cast("int"))


def task_prefix(lang: str = "en", task: str = "transcribe", timestamps: bool = False) -> Column:
    """``[SOT, lang, task]`` plus ``<|notimestamps|>`` when timestamps are not predicted."""
    ids = [SOT, LANG[lang], TRANSCRIBE if task == "transcribe" else TRANSLATE]
    if not timestamps:
        ids.append(NOTIMESTAMPS)
    return F.array(*[F.lit(i) for i in ids])


def timestamp_id(seconds: Column) -> Column:
    """Id of ``<|%.2f|>`` for a time in seconds (0.02 s steps, clamped to the 1501 tokens)."""
    step = F.least(F.greatest(F.round(seconds / F.lit(0.02)), F.lit(0)), F.lit(TIMESTAMP_COUNT - 1)).cast("int")
    return F.lit(TIMESTAMP_FIRST) + step


def has_timestamps(ids) -> Column:
    """Ids and the timestamp vocabulary intersect."""
    return F.exists(_c(ids), lambda x: (x >= TIMESTAMP_FIRST) & (x < TIMESTAMP_FIRST + TIMESTAMP_COUNT))


def with_single_eot(ids) -> Column:
    """L1: remove every EOT, append one."""
    return F.concat(F.array_remove(_c(ids), EOT), F.array(F.lit(EOT)))


def drop_timestamp_ids(ids, position: int = MULTILINGUAL_PREFIX) -> Column:
    """L2 (the no-timestamp branch): keep ids below ``<|notimestamps|>`` and insert it at ``position``."""
    kept = F.filter(_c(ids), lambda x: x < NOTIMESTAMPS)
    pos = F.least(F.lit(position + 1), F.size(kept) + 1)
    return F.array_insert(kept, pos, F.lit(NOTIMESTAMPS))


def maybe_drop_timestamps(ids, keep_timestamps: Column, position: int = MULTILINGUAL_PREFIX) -> Column:
    """L2: ids with timestamps lose them unless the draw says keep; ids without timestamps are unchanged."""
    ids = _c(ids)
    return F.when(has_timestamps(ids) & ~keep_timestamps, drop_timestamp_ids(ids, position)).otherwise(ids)


def prompt_from(prev_ids, position: int = MULTILINGUAL_PREFIX) -> Column:
    """L3: prompt from the previous row's unprompted ids: drop ids >= <|notimestamps|>, then
    ``[PREV] + p[position:-1]``; an empty filtered list gives an empty prompt."""
    p = F.filter(_c(prev_ids), lambda x: x < NOTIMESTAMPS)
    body = F.slice(p, position + 1, F.greatest(F.size(p) - (position + 1), F.lit(0)))
    return F.when(F.size(p) > 0, F.concat(F.array(F.lit(PREV)), body)).otherwise(F.array().cast("array<int>"))


def with_prompt(ids, prev_ids, condition: Column, max_len: int, position: int = MULTILINGUAL_PREFIX) -> Column:
    """Prepend the prompt when the draw says so, a previous row exists and the result stays below max_len."""
    ids = _c(ids)
    prompt = prompt_from(prev_ids, position)
    ok = condition & _c(prev_ids).isNotNull() & (F.size(prompt) + F.size(ids) < max_len)
    return F.when(ok, F.concat(prompt, ids)).otherwise(ids)


def labels_in_range(labels, max_len: int) -> Column:
    """``0 < size <= max_len``."""
    n = F.size(_c(labels))
    return (n > 0) & (n <= max_len)


def right_pad(ids, length: Column, value: int) -> Column:
    """L4: right-pad to ``length`` with ``value``."""
    ids = _c(ids)
    return F.concat(ids, F.array_repeat(F.lit(value), F.greatest(length - F.size(ids), F.lit(0)).cast("int")))


def shift_inputs(padded) -> Column:
    """Decoder inputs = padded[:-1]."""
    p = _c(padded)
    return F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0)))


def shift_targets(padded, n_real: Column) -> Column:
    """L5 + L4 mask: targets = padded[1:], padding positions (beyond the real length) set to -100."""
    p = _c(padded)
    tail = F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0)))
    return F.transform(tail, lambda x, i: F.when(i + 1 < n_real, x).otherwise(F.lit(PAD_LABEL)))


def mask_prompt(targets) -> Column:
    """First 0-based index k of SOT in the targets; when k > 0, positions 0..k become -100."""
    t = _c(targets)
    from auralith.functions.edit import _bind

    pair = F.struct(t.alias("t"), (F.array_position(t, SOT) - 1).alias("k"))  # -1 when absent; found once, not per element
    return _bind(pair, lambda p: F.transform(p["t"], lambda x, i: F.when((p["k"] > 0) & (i <= p["k"]), F.lit(PAD_LABEL)).otherwise(x)))


def spaced_index(n: Column, k: Column, start: Column | None = None) -> Column:
    """``linspace(start, n-1, k)`` cast to int with the last forced to ``n-1`` (numpy arithmetic:
    ``i * ((stop - start) / (k - 1)) + start``); ``start`` defaults to 0, the layer-map variant uses ``n // k - 1``."""
    start = F.lit(0) if start is None else start
    step = (n - 1 - start).cast("double") / F.greatest(k - 1, F.lit(1)).cast("double")
    return F.transform(
        F.sequence(F.lit(0), k - 1),
        lambda i: F.when(i == k - 1, n - 1).otherwise(F.floor(i.cast("double") * step + start.cast("double"))).cast("int"),
    )
