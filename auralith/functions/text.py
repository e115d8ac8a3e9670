"""Text functions (``Column -> Column``), all JVM-side Spark expressions.

Regular expressions are written so that Java (Spark) and RE2 (DuckDB, used by the oracle) read them the same
way: whitespace is an explicit class equal to Python's ``\\s`` for ``str`` patterns, code points use ``\\x{..}``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------------------------------------
# Fixed values. These must equal the reference's lists for identical results; kept verbatim and in order.
# ---------------------------------------------------------------------------------------------------------------
TEDLIUM_CONTRACTIONS = [" 's", " 't", " 're", " 've", " 'm", " 'll", " 'd", " 'clock", " 'all"]
GIGASPEECH_PUNCTUATION = [
    (" <comma>", ","),
    (" <period>", "."),
    (" <questionmark>", "?"),
    (" <exclamationpoint>", "!"),
]
GIGASPEECH_JUNK_TOKENS = ["<other>", "<sil>"]
SWB_JUNK_TOKENS = [
    "[noise]", "[laughter]", "[silence]", "[vocalized-noise]", "<a_aside>", "<b_aside>", "<e_aside>",
    "[laughter-", "_1", "[laugh]", "[sigh]", "[cough]", "[mn]", "[breath]", "[lipsmack]",
    "[sneeze]", "[skip]", "[pause]", "(%hesitation)", "(%HESITATION)",
]
EARNINGS_JUNK_TOKENS = ["<noise>", "<crosstalk>", "<affirmative>", "<inaudible>", "inaudible", "<laugh>", "<silence>"]
BASE_IGNORE_SEGMENTS = [
    "ignore_time_segment_in_scoring", "<noise>", "<music>", "[noise]", "[laughter]", "[silence]",
    "[vocalized-noise]", "<crosstalk>", "<affirmative>", "<inaudible>", "<laugh>", "",
]
IGNORE_SEGMENTS = BASE_IGNORE_SEGMENTS + GIGASPEECH_JUNK_TOKENS + SWB_JUNK_TOKENS + EARNINGS_JUNK_TOKENS
TEDLIUM_UNK = "<unk>"
# Timestamp tokens are ``<|%.2f|>`` of i * 0.02 for i in 0..1500.
TIMESTAMP_STEP = 0.02
TIMESTAMP_COUNT = 1501
# ---------------------------------------------------------------------------------------------------------------

# Python's ``\s`` for str patterns, spelled out so Java and RE2 agree on it.
WS = (
    "[\\t\\n\\x{0B}\\f\\r\\x{1C}-\\x{1F} \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}"
    "\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
)
ASCII_WS = "[\\t-\\r\\x{1C}-\\x{20}]"
WS_CHARS = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
BRACKETS_RE = "[<\\[][^>\\]]*[>\\]]"
PARENS_RE = "\\(([^)]+?)\\)"
MSP_RE = "[\\p{M}\\p{S}\\p{P}]"
TIMESTAMP_TOKEN_RE = "<\\|\\d+\\.\\d+\\|>"
ANY_TAG_RE = "<[^>]*>"
ASCII_ONLY_RE = "^[\\x{00}-\\x{7F}]*$"
ASCII_MSP = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum())  # the ASCII characters of MSP_RE


from auralith.functions.numbers import FAST_NUMBER_RE, any_of, spoken_numbers  # noqa: E402


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nfkc(c) -> Column:
    """Unicode NFKC, JVM-side through ICU4J (bundled with Spark 4); ASCII strings are returned as they are."""
    c = _c(c)
    composed = F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    return F.when(c.isNull() | c.rlike(ASCII_ONLY_RE), c).otherwise(composed)


def _bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a lambda variable (an expression that is named several times is
    built again at every mention)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip_ws(c) -> Column:
    """Python ``str.strip()`` (Unicode whitespace), unlike ``trim`` which only removes spaces."""
    return F.btrim(_c(c), F.lit(WS_CHARS))


def _replace_ws(c, pattern: str) -> Column:
    """Matches of ``pattern`` (with ``{WS}`` for a white-space character) become one space. ASCII strings, most of them,
    take the small character class: the Unicode one is tested range by range at every character."""
    return _bind(_c(c), lambda s: F.when(s.rlike(ASCII_ONLY_RE), F.regexp_replace(s, pattern.replace("{WS}", ASCII_WS), " "))
                 .otherwise(F.regexp_replace(s, pattern.replace("{WS}", WS), " ")))


def collapse_ws(c) -> Column:
    """``re.sub(r"\\s\\s+", " ", s)``: runs of two or more whitespace become one space; a single tab survives."""
    return _replace_ws(c, "{WS}{WS}+")


def jiwer_clean(c) -> Column:
    """The metric pre-transform: collapse multiple whitespace, then strip."""
    return strip_ws(collapse_ws(c))


def _without_marked(c) -> Column:
    """Lower case, without ``<..>``/``[..]`` and ``(..)``."""
    return F.regexp_replace(F.regexp_replace(F.lower(_c(c)), BRACKETS_RE, ""), PARENS_RE, "")


def _msp_to_space(s: Column, wide: Column, keep: str = "") -> Column:
    """``wide``; for ASCII strings the same by a character table, without a pattern."""
    marks = "".join(c for c in ASCII_MSP if c not in keep)
    return F.when(s.rlike(ASCII_ONLY_RE), F.translate(s, marks, " " * len(marks))).otherwise(wide)


def _basic_end(s: Column) -> Column:
    return _replace_ws(F.lower(_bind(s, lambda x: _msp_to_space(x, F.regexp_replace(x, MSP_RE, " ")))), "{WS}+")


def basic_normalize(c) -> Column:
    """T1 basic normaliser: lower, drop ``<..>``/``[..]`` and ``(..)``, NFKC, marks/symbols/punctuation to space,
    lower again, whitespace runs to one space (no trim)."""
    return _basic_end(nfkc(_without_marked(c)))


def japanese_normalize(c) -> Column:
    """Basic normaliser, then remove every space, then ``。.`` -> ``。``."""
    return F.replace(F.replace(basic_normalize(c), F.lit(" "), F.lit("")), F.lit("。."), F.lit("。"))


def normalize_for_language(c, lang, stage: str = "eval") -> Column:
    """T4 routing. ``eval``: en -> T2, ja -> T3, others -> T1. ``filter``: en -> T2, every other language -> T1
    (the label filter uses the basic normaliser for Japanese too)."""
    lang = _c(lang)
    english = english_normalize(c)
    if stage == "filter":
        return F.when(lang == "en", english).otherwise(basic_normalize(c))
    return F.when(lang == "en", english).when(lang == "ja", japanese_normalize(c)).otherwise(basic_normalize(c))


def replace_all(c, pairs) -> Column:
    """Sequential literal replacement, in list order."""
    s = _c(c)
    for old, new in pairs:
        s = F.replace(s, F.lit(old), F.lit(new))
    return s


def remove_tokens(c, tokens) -> Column:
    return replace_all(c, [(t, "") for t in tokens])


def join_spaced_contractions(c) -> Column:
    """`` 's`` -> ``'s`` for the nine contractions, in order."""
    return replace_all(c, [(t, t[1:]) for t in TEDLIUM_CONTRACTIONS])


def spelled_punctuation(c) -> Column:
    """`` <comma>`` -> ``,`` etc."""
    return replace_all(c, GIGASPEECH_PUNCTUATION)


def unquote_sentence(c) -> Column:
    """Strip one pair of surrounding double quotes, then ``""`` -> ``"``."""
    s = _c(c)
    quoted = s.startswith('"') & s.endswith('"')
    inner = F.substr(s, F.lit(2), F.length(s) - 2)
    return F.replace(F.when(quoted, inner).otherwise(s), F.lit('""'), F.lit('"'))


def trim_paren_suffix(c) -> Column:
    """Drop the last space-separated token when it starts with ``(``."""
    return F.regexp_replace(_c(c), " \\([^ ]*$", "")


def parse_gender(label) -> Column:
    """Last ``,``/``_`` part without its last character; F/M -> female/male; empty or ``<NA`` -> ``-1``."""
    part = F.element_at(F.split(_c(label), "[,_]"), -1)
    g = F.substr(part, F.lit(1), F.greatest(F.length(part) - 1, F.lit(0)))
    return (
        F.when((g == "") | (g == "<NA"), F.lit("-1"))
        .when(g == "F", F.lit("female"))
        .when(g == "M", F.lit("male"))
        .otherwise(g)
    )


def has_markup(c) -> Column:
    """text contains a ``<...>`` pair."""
    return _c(c).rlike(ANY_TAG_RE)


def remove_timestamp_tokens(c) -> Column:
    """Delete ``<|12.34|>`` tokens."""
    return F.regexp_replace(_c(c), TIMESTAMP_TOKEN_RE, "")


def int_list_from_text(c) -> Column:
    """Every run of digits as an INT array (``"[1 2 3]"`` -> ``[1,2,3]``)."""
    return F.transform(F.regexp_extract_all(_c(c), F.lit("(\\d+)"), F.lit(1)), lambda x: x.cast("int"))


def is_bracketed(c) -> Column:
    c = _c(c)
    return c.startswith("[") & c.endswith("]")


def punct_repair(raw, punctuated, mark: str = "。", unknown: str = "unk") -> Column:
    """The raw text when the punctuated one contains ``unk``; with more than one ``mark``, delete all and
    re-insert one at the 0-based index of the last one, counted in the shortened string (clamped to its end)."""
    s = _c(punctuated)
    n_marks = F.length(s) - F.length(F.replace(s, F.lit(mark), F.lit("")))
    last_idx = F.length(s) - F.locate(mark, F.reverse(s))  # 0-based index of the last mark
    bare = F.replace(s, F.lit(mark), F.lit(""))
    cut = F.least(last_idx, F.length(bare))
    rebuilt = F.concat(F.substr(bare, F.lit(1), cut), F.lit(mark), F.substr(bare, cut + 1, F.lit(1 << 30)))
    return F.when(s.contains(unknown), _c(raw)).when(n_marks > 1, rebuilt).otherwise(s)


def basename(c) -> Column:
    return F.substring_index(_c(c), "/", -1)


def stem(c) -> Column:
    b = basename(c)
    return F.when(b.contains("."), F.regexp_replace(b, "\\.[^.]*$", "")).otherwise(b)


def strip_leading_dot_slash(c) -> Column:
    """``lstrip("./")``: leading ``.``/``/`` characters removed (S2 member names, J11)."""
    return F.regexp_replace(_c(c), "^[./]+", "")


def remove_suffix(c, suffix: str) -> Column:
    """Intended form of the reference's ``strip(".sph")``: remove a literal suffix, not a character set."""
    s = _c(c)
    n = len(suffix)
    return F.when(s.endswith(suffix), F.substr(s, F.lit(1), F.length(s) - n)).otherwise(s)


def chunk_id_from_name(c) -> Column:
    """Number between ``.all_`` and ``.wer_``."""
    return F.regexp_extract(_c(c), "\\.all_(\\d+)\\.wer_", 1).cast("int")


def pandas_round(c, digits: int) -> Column:
    """pandas/numpy ``round``: scale, round half to even on the binary value (``rint``), scale back."""
    scale = float(10 ** digits)
    return F.rint(_c(c) * F.lit(scale)) / F.lit(scale)


# ---------------------------------------------------------------------------------------------------------------
# The English normaliser's filler pattern and replacement rules, in their original order.
# ---------------------------------------------------------------------------------------------------------------
ENGLISH_FILLERS = r"\b(hmm|mm|mhm|mmm|uh|um)\b"
ENGLISH_REPLACERS = [
    (r"\bwon't\b", "will not"),
    (r"\bcan't\b", "can not"),
    (r"\blet's\b", "let us"),
    (r"\bain't\b", "aint"),
    (r"\by'all\b", "you all"),
    (r"\bwanna\b", "want to"),
    (r"\bgotta\b", "got to"),
    (r"\bgonna\b", "going to"),
    (r"\bi'ma\b", "i am going to"),
    (r"\bimma\b", "i am going to"),
    (r"\bwoulda\b", "would have"),
    (r"\bcoulda\b", "could have"),
    (r"\bshoulda\b", "should have"),
    (r"\bma'am\b", "madam"),
    (r"\bmr\b", "mister "),
    (r"\bmrs\b", "missus "),
    (r"\bst\b", "saint "),
    (r"\bdr\b", "doctor "),
    (r"\bprof\b", "professor "),
    (r"\bcapt\b", "captain "),
    (r"\bgov\b", "governor "),
    (r"\bald\b", "alderman "),
    (r"\bgen\b", "general "),
    (r"\bsen\b", "senator "),
    (r"\brep\b", "representative "),
    (r"\bpres\b", "president "),
    (r"\brev\b", "reverend "),
    (r"\bhon\b", "honorable "),
    (r"\basst\b", "assistant "),
    (r"\bassoc\b", "associate "),
    (r"\blt\b", "lieutenant "),
    (r"\bcol\b", "colonel "),
    (r"\bjr\b", "junior "),
    (r"\bsr\b", "senior "),
    (r"\besq\b", "esquire "),
    (r"'d been\b", " had been"),
    (r"'s been\b", " has been"),
    (r"'d gone\b", " had gone"),
    (r"'s gone\b", " has gone"),
    (r"'d done\b", " had done"),
    (r"'s got\b", " has got"),
    (r"n't\b", " not"),
    (r"'re\b", " are"),
    (r"'s\b", " is"),
    (r"'d\b", " would"),
    (r"'ll\b", " will"),
    (r"'t\b", " not"),
    (r"'ve\b", " have"),
    (r"'m\b", " am"),
]
ENGLISH_KEEP_SYMBOLS = ".%$¢€£"
ADDITIONAL_DIACRITICS = [
    ("œ", "oe"), ("Œ", "OE"), ("ø", "o"), ("Ø", "O"), ("æ", "ae"), ("Æ", "AE"), ("ß", "ss"), ("ẞ", "SS"),
    ("đ", "d"), ("Đ", "D"), ("ð", "d"), ("Ð", "D"), ("þ", "th"), ("Þ", "th"), ("ł", "l"), ("Ł", "L"),
]
# ---------------------------------------------------------------------------------------------------------------

WORD_CHAR = "[\\p{L}\\p{N}_]"
# private-use stand-ins that protect the kept symbols while every other mark/symbol/punctuation becomes a space
KEEP_STANDINS = "".join(chr(0xE000 + i) for i in range(len(ENGLISH_KEEP_SYMBOLS)))


def unicode_boundaries(pattern: str) -> str:
    """Python's ``\\b`` (Unicode word characters) as Java look-arounds: a leading ``\\b`` before a word character
    becomes ``(?<!w)``, a trailing one ``(?!w)``."""
    lead = pattern.startswith("\\b")
    trail = pattern.endswith("\\b")
    core = pattern[2 if lead else 0: -2 if trail else None]
    return (f"(?<!{WORD_CHAR})" if lead else "") + core + (f"(?!{WORD_CHAR})" if trail else "")


def nfkd(c) -> Column:
    """Unicode NFKD through ICU4J (JVM-side); ASCII strings are returned as they are."""
    c = _c(c)
    decomposed = F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), c, F.lit(True))
    return F.when(c.isNull() | c.rlike(ASCII_ONLY_RE), c).otherwise(decomposed)


def remove_symbols_and_diacritics(c, keep: str = ENGLISH_KEEP_SYMBOLS) -> Column:
    """NFKD; listed ligatures/letters spelled out; combining marks (Mn) dropped; other marks, symbols and punctuation
    become spaces, except the characters in ``keep``."""
    standins = KEEP_STANDINS[: len(keep)]
    c = _c(c)
    # ASCII text has nothing to decompose, no ligatures and no combining marks: only the symbol step applies
    wide = F.regexp_replace(replace_all(F.translate(nfkd(c), keep, standins), ADDITIONAL_DIACRITICS), "\\p{Mn}", "")
    return _msp_to_space(c, F.translate(F.regexp_replace(wide, MSP_RE, " "), standins, keep), keep)


def _rule_core(pattern: str) -> str:
    return pattern[2 if pattern.startswith("\\b") else 0: -2 if pattern.endswith("\\b") else None]


# one pass that tells whether any filler/contraction/title rule can fire at all (most lines: none); inside an ASCII word the
# first look-behind, a plain table, ends the trial
_ANY_RULE_RE = (f"(?<![0-9a-z_])(?<!{WORD_CHAR})"
                + any_of("hmm mm mhm mmm uh um".split() + [_rule_core(p) for p, _ in ENGLISH_REPLACERS if p.startswith("\\b")]) + f"(?!{WORD_CHAR})|'")


def _english_rules(s: Column) -> Column:
    s = F.regexp_replace(s, unicode_boundaries(ENGLISH_FILLERS), "")
    s = F.regexp_replace(s, f"{WS}+'", "'")
    for pattern, repl in ENGLISH_REPLACERS:
        s = F.regexp_replace(s, unicode_boundaries(pattern), repl)
    return s


def english_normalize(c, spelling: dict[str, str] | None = None) -> Column:
    """T2 (documented subset): lower, drop bracketed/parenthesised words, fillers, apostrophe spacing, the
    contraction/title rules, commas between digits, periods not followed by digits, symbols and diacritics (keeping
    ``.%$¢€£``), spelled-out numbers (see ``numbers.py``), spelling map per word (pluggable; the word split also normalises
    whitespace), stray numeric symbols, whitespace runs.

    The ~50 rule passes only run on strings where one combined pattern finds a candidate."""
    plain = remove_symbols_and_diacritics(_english_points(_english_spoken(_without_marked(c))))
    return _english_end(_english_numbers(plain), spelling)


def _english_spoken(s: Column) -> Column:
    return F.when(s.rlike(_ANY_RULE_RE), _english_rules(s)).otherwise(s)


def _english_points(s: Column) -> Column:
    s = F.regexp_replace(s, "(\\p{Nd}),(\\p{Nd})", "$1$2")
    return F.regexp_replace(s, "\\.([^0-9]|$)", " $1")


def _english_numbers(s: Column) -> Column:
    return F.when(s.rlike(FAST_NUMBER_RE), spoken_numbers(s)).otherwise(s)


def _english_end(s: Column, spelling: dict[str, str] | None = None) -> Column:
    if spelling:
        words = F.filter(F.split(strip_ws(s), f"{WS}+"), lambda w: w != "")
        m = F.create_map(*[F.lit(x) for kv in spelling.items() for x in kv])
        spaced = F.array_join(_bind(words, lambda ws: F.transform(ws, lambda w: F.coalesce(F.try_element_at(m, w), w))), " ")
    else:  # " ".join(s.split()): white-space runs to one space, none at the ends
        spaced = F.trim(_replace_ws(s, "{WS}+"))
    # symbols that no digit follows (a percent sign: precedes); most lines have none
    return _bind(spaced, lambda x: F.when(x.rlike("[.$¢€£%]"), F.regexp_replace(
        F.regexp_replace(F.regexp_replace(x, "[.$¢€£]([^0-9])", " $1"), "([^0-9])%", "$1 "), f"{WS}+", " ")).otherwise(x))


def with_normalized(df: DataFrame, lang, stage: str = "eval", **sources: str) -> DataFrame:
    """T4 for several text columns at once (``new_column="source_column"``), every step a column of its own.

    The steps name their input several times (a test, a replacement, the untouched string); as columns they are computed
    once per row, where one nested expression would build each input again at every mention."""
    lang = _c(lang)
    english = F.coalesce(lang == "en", F.lit(False))

    def step(before: str, after: str, change) -> None:
        nonlocal df
        df = df.withColumns({f"_{n}_{after}": change(F.col(f"_{n}_{before}")) for n in sources})

    df = df.withColumns({f"_{n}_bare": _without_marked(src) for n, src in sources.items()})
    step("bare", "spoken", lambda s: F.when(english, _english_spoken(s)))
    step("spoken", "points", _english_points)
    step("points", "plain", remove_symbols_and_diacritics)
    step("plain", "numbers", _english_numbers)
    step("bare", "nfkc", lambda s: F.when(~english, nfkc(s)))

    def final(n: str) -> Column:
        other = _basic_end(F.col(f"_{n}_nfkc"))
        if stage != "filter":
            other = F.when(lang == "ja", F.replace(F.replace(other, F.lit(" "), F.lit("")), F.lit("。."), F.lit("。"))).otherwise(other)
        return F.when(english, _english_end(F.col(f"_{n}_numbers"))).otherwise(other)

    from auralith.operators.ordering import compute_once

    df = compute_once(df, **{n: final(n) for n in sources})
    return df.drop(*[f"_{n}_{x}" for n in sources for x in ("bare", "spoken", "points", "plain", "numbers", "nfkc")])
