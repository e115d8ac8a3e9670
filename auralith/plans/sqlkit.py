"""DuckDB SQL fragments used by the oracle queries (``oracle_sql()``); each mirrors one Spark function.

Differences that are handled, not hidden:
* DuckDB's ``levenshtein`` counts bytes. A pair whose distinct symbols (words or characters) number at most 127 is
  re-coded one symbol -> one ASCII byte, which makes the byte distance equal to the symbol distance; larger pairs
  use an exact anti-diagonal dynamic program over lists (O(n*m)). Both branches are exact.
* DuckDB has no NFKC; ``nfc_normalize`` stands in (equal on the driver tables: no compatibility characters).
"""

from __future__ import annotations

from auralith.functions.text import BRACKETS_RE, MSP_RE, PARENS_RE, WS


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def rx_replace(x: str, pattern: str, repl: str) -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(repl)}, 'g')"


def collapse_ws(x: str) -> str:
    return rx_replace(x, f"{WS}{WS}+", " ")


def strip_ws(x: str) -> str:
    return rx_replace(x, f"^{WS}+|{WS}+$", "")


def jiwer_clean(x: str) -> str:
    return strip_ws(collapse_ws(x))


def words(x: str) -> str:
    return f"list_filter(string_split({jiwer_clean(x)}, ' '), lambda w: w <> '')"


def chars(x: str) -> str:
    return f"string_split({jiwer_clean(x)}, '')"


def basic_normalize(x: str) -> str:
    s = f"lower({x})"
    s = rx_replace(s, BRACKETS_RE, "")
    s = rx_replace(s, PARENS_RE, "")
    s = f"nfc_normalize({s})"
    s = rx_replace(s, MSP_RE, " ")
    s = f"lower({s})"
    return rx_replace(s, f"{WS}+", " ")


def replace_all(x: str, pairs) -> str:
    for old, new in pairs:
        x = f"replace({x}, {q(old)}, {q(new)})"
    return x


def _dp(a: str, b: str) -> str:
    big = "1000000000"
    return f"""(list_reduce(range(1, len({a}) + len({b}) + 1),
  lambda acc, d: [acc[2], list_transform(range(0, len({a}) + 1), lambda i:
     CASE WHEN d - i < 0 OR d - i > len({b}) THEN {big}
          WHEN i = 0 THEN d WHEN d - i = 0 THEN i
          ELSE least(acc[2][i] + 1, acc[2][i + 1] + 1,
                     acc[1][i] + CASE WHEN {a}[i] = {b}[d - i] THEN 0 ELSE 1 END) END)],
  [list_transform(range(0, len({a}) + 1), lambda i: {big}),
   list_transform(range(0, len({a}) + 1), lambda i: CASE WHEN i = 0 THEN 0 ELSE {big} END)])[2][len({a}) + 1])"""


def edit_distance_cte(name: str, src: str, a: str, b: str, out: str) -> str:
    """CTE ``name`` = every row of ``src`` plus ``out`` = edit distance between list columns ``a`` and ``b``."""
    enc = lambda x: f"coalesce(list_aggregate(list_transform({x}, lambda t: chr(list_position(__v, t)::INTEGER)), 'string_agg', ''), '')"
    with_v = f"(SELECT *, list_distinct(list_concat({a}, {b})) AS __v FROM {src})"
    return f"""{name} AS (
  SELECT * EXCLUDE (__v), levenshtein({enc(a)}, {enc(b)}) AS {out} FROM {with_v} WHERE len(__v) <= 127
  UNION ALL
  SELECT * EXCLUDE (__v), {_dp(a, b)} AS {out} FROM {with_v} WHERE len(__v) > 127
)"""


_NOT_WORD = "[^\\p{L}\\p{N}_]"


def _bounded_replace(x: str, pattern: str, repl: str, passes: int) -> str:
    """Python ``\\b`` emulated for RE2 (no look-arounds): the boundary characters are consumed and put back, so
    adjacent matches need another pass; ``passes`` bounds the run length handled (2**passes - 1)."""
    lead = pattern.startswith("\\b")
    trail = pattern.endswith("\\b")
    core = pattern[2 if lead else 0: -2 if trail else None]
    rx = (f"(^|{_NOT_WORD})" if lead else "") + core + (f"({_NOT_WORD}|$)" if trail else "")
    if lead and trail:
        rep = "\\1" + repl + "\\2"
    elif lead:
        rep = "\\1" + repl
    elif trail:
        rep = repl + "\\1"
    else:
        rep = repl
    for _ in range(passes):
        x = rx_replace(x, rx, rep)
    return x


def english_normalize(x: str) -> str:
    from auralith.functions import text as T

    s = f"lower({x})"
    s = rx_replace(s, BRACKETS_RE, "")
    s = rx_replace(s, PARENS_RE, "")
    s = _bounded_replace(s, T.ENGLISH_FILLERS.replace("(hmm", "(?:hmm"), "", 4)
    s = rx_replace(s, f"{WS}+'", "'")
    for pattern, repl in T.ENGLISH_REPLACERS:
        s = _bounded_replace(s, pattern, repl, 2)
    s = rx_replace(s, "(\\p{Nd}),(\\p{Nd})", "\\1\\2")
    s = rx_replace(s, "\\.([^0-9]|$)", " \\1")
    standins = T.KEEP_STANDINS[: len(T.ENGLISH_KEEP_SYMBOLS)]
    s = f"translate({s}, {q(T.ENGLISH_KEEP_SYMBOLS)}, {q(standins)})"
    s = replace_all(s, T.ADDITIONAL_DIACRITICS)
    s = f"strip_accents({s})"  # NFKD + drop Mn (equal on text without compatibility characters)
    s = rx_replace(s, MSP_RE, " ")
    s = f"translate({s}, {q(standins)}, {q(T.ENGLISH_KEEP_SYMBOLS)})"
    s = f"array_to_string(list_filter(regexp_split_to_array({strip_ws(s)}, {q(WS + '+')}), lambda w: w <> ''), ' ')"
    s = rx_replace(s, "[.$¢€£]([^0-9])", " \\1")
    s = rx_replace(s, "([^0-9])%", "\\1 ")
    return rx_replace(s, f"{WS}+", " ")
