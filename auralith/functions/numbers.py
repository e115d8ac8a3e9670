"""Spelled-out English numbers as digits (part of T2), one fold over the words of a line.

Covered: cardinals with hundreds and powers of a thousand (``two thousand and five`` -> ``2005``), numbers said in pieces
(``nineteen eighty four`` -> ``1984``, ``one two three`` -> ``123``), ordinals and plurals (``twenty first`` -> ``21st``,
``nineties`` -> ``90s``), decimals (``three point one four`` -> ``3.14``), digits followed by a power (``5 million``), signs
before a number, and percent and currency words after one. Not covered: ``oh`` for zero, ``half``, ``double``/``triple``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

ONE, TEEN, TEN, HUNDRED, POWER, ZERO, PERCENT, MONEY, SIGN, AND, POINT, DIGITS = range(1, 13)
# Number words, their ordinals and plurals, currency signs.
UNITS = "one two three four five six seven eight nine".split()
TEENS = "ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
POWERS = {"thousand": 10 ** 3, "million": 10 ** 6, "billion": 10 ** 9, "trillion": 10 ** 12}
ORDINALS = {"first": (ONE, 1, "st"), "second": (ONE, 2, "nd"), "third": (ONE, 3, "rd"), "fifth": (ONE, 5, "th"), "eighth": (ONE, 8, "th"),
            "ninth": (ONE, 9, "th"), "twelfth": (TEEN, 12, "th")}
SIGNS = {"minus": "-", "negative": "-", "plus": "+", "positive": "+"}
CURRENCIES = {"dollar": "$", "dollars": "$", "cent": "¢", "cents": "¢", "euro": "€", "euros": "€", "pound": "£", "pounds": "£"}


def lexicon() -> dict[str, tuple[int, int, str]]:
    """word -> (kind, value, suffix or sign)."""
    out: dict[str, tuple[int, int, str]] = {"zero": (ZERO, 0, ""), "and": (AND, 0, ""), "point": (POINT, 0, ""), "percent": (PERCENT, 0, "%")}
    for words, kind, first, step in ((UNITS, ONE, 1, 1), (TEENS, TEEN, 10, 1), (TENS, TEN, 20, 10)):
        for i, word in enumerate(words):
            out[word] = (kind, first + i * step, "")
            if word[:-1] + "ies" != word and word.endswith("ty"):
                out[word[:-1] + "ieth"] = (kind, first + i * step, "th")
                out[word[:-1] + "ies"] = (kind, first + i * step, "s")
            else:
                out[word + "th"] = (kind, first + i * step, "th")
    for irregular in ("oneth", "twoth", "threeth", "fiveth", "eightth", "nineth", "twelveth"):
        out.pop(irregular, None)
    out |= ORDINALS
    for word, value in {"hundred": 100, **POWERS}.items():
        kind = HUNDRED if value == 100 else POWER
        out |= {word: (kind, value, ""), word + "th": (kind, value, "th"), word + "s": (kind, value, "s")}
    out |= {w: (SIGN, 0, s) for w, s in SIGNS.items()} | {w: (MONEY, 0, s) for w, s in CURRENCIES.items()}
    return out


_NUMERIC = [w for w, (k, _, _) in lexicon().items() if k in (ONE, TEEN, TEN, HUNDRED, POWER, ZERO)]
ANY_NUMBER_RE = r"(^|\s)(" + "|".join(_NUMERIC) + r"|\d+ (percent|" + "|".join(CURRENCIES) + r"))(\s|$)"


def any_of(words) -> str:
    """A pattern for any of ``words``, common beginnings once: at a place it tries a letter, not every word."""
    tree: dict = {}
    for word in words:
        node = tree
        for c in word:
            node = node.setdefault(c, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        options = [re.escape(c) + pattern(below) for c, below in node.items() if c] + ([""] if "" in node else [])
        return options[0] if len(options) == 1 else f"(?:{'|'.join(options)})"

    return pattern(tree)


# the same matches as ANY_NUMBER_RE
FAST_NUMBER_RE = rf"(?:^|\s)(?:{any_of(_NUMERIC)}|\d+ {any_of(['percent', *CURRENCIES])})(?:\s|$)"


def _state(done: Column, **new) -> Column:
    """The fold's state with some fields replaced."""
    fields = {"out": "string", "open": "boolean", "head": "string", "whole": "boolean", "total": "bigint", "part": "bigint", "last": "int",
              "sign": "string", "decimal": "boolean"}
    return F.struct(*[(new[n] if isinstance(new.get(n), Column) else F.lit(new[n]) if n in new else done[n]).cast(t).alias(n) for n, t in fields.items()])


def _said(s: Column) -> Column:
    """The number as it stands."""
    return F.concat(s["head"], F.when(s["whole"], (s["total"] + s["part"]).cast("string")).otherwise(F.lit("")))


_CLOSED = {"open": False, "head": "", "whole": False, "total": 0, "part": 0, "last": 0, "sign": "", "decimal": False}


def _written(s: Column, before=None, after=None) -> Column:
    """The text so far with the open number, if any."""
    number = F.concat(F.lit(" "), s["sign"], before if before is not None else F.lit(""), _said(s), after if after is not None else F.lit(""))
    return F.when(s["open"], F.concat(s["out"], number)).otherwise(s["out"])


def _step(s: Column, t: Column) -> Column:
    kind, value, mark, follow = t["kind"], t["value"], t["mark"], t["follow"]
    small = kind.isin(ONE, TEEN, TEN)
    joins = s["open"] & s["whole"] & ((s["last"].isin(HUNDRED, POWER, AND) & small) | ((s["last"] == TEN) & (kind == ONE)))
    put = F.concat(_written(s), F.lit(" "), t["word"])

    fresh = _state(s, open=True, head="", whole=True, total=0, part=value, last=kind)
    more = _state(s, part=s["part"] + value, last=kind)
    pieced = _state(s, head=_said(s), whole=True, total=0, part=value, last=kind)
    spelled = _state(s, head=F.concat(_said(s), value.cast("string")), whole=False, total=0, part=0, last=kind)
    number = F.when(~s["open"], fresh).when(s["decimal"], spelled).when(joins, more).otherwise(pieced)
    zero = F.when(s["open"], spelled).otherwise(_state(s, open=True, head="0", whole=False, last=ZERO))
    hundred = F.when(s["open"] & s["whole"] & s["part"].between(1, 99) & ~s["decimal"], _state(s, part=s["part"] * 100, last=HUNDRED)).when(
        s["open"], _state(s, out=_written(s), **{**_CLOSED, "open": True, "whole": True, "part": 100, "last": HUNDRED})).otherwise(
        _state(s, open=True, whole=True, head="", total=0, part=100, last=HUNDRED))
    power = F.when(s["open"] & s["whole"] & (s["part"] > 0), _state(s, total=s["total"] + s["part"] * value, part=0, last=POWER)).when(
        s["open"] & s["whole"] & (s["total"] > 0), _state(s, total=s["total"] * value, last=POWER)).when(
        s["open"], _state(s, out=_written(s), **{**_CLOSED, "open": True, "whole": True, "total": value, "last": POWER})).otherwise(
        _state(s, open=True, whole=True, head="", total=value, part=0, last=POWER))
    said = F.when(small | (kind == DIGITS), number).when(kind == ZERO, zero).when(kind == HUNDRED, hundred).otherwise(power)

    def ended(x: Column) -> Column:  # an ordinal or plural closes its number
        return F.when(mark != "", _state(x, out=_written(x, after=mark), **_CLOSED)).otherwise(x)

    number_kind = small | kind.isin(HUNDRED, POWER, ZERO, DIGITS)
    other = _state(s, out=put, **_CLOSED)
    follows = follow.isin(ONE, TEEN, TEN, ZERO, DIGITS)
    return (
        F.when(number_kind, F.element_at(F.transform(F.array(said), ended), 1))
        .when((kind == AND) & s["open"] & s["whole"] & s["last"].isin(HUNDRED, POWER) & follow.isin(ONE, TEEN, TEN), _state(s, last=AND))
        .when((kind == POINT) & s["open"] & ~s["decimal"] & follows, _state(s, head=F.concat(_said(s), F.lit(".")), whole=False, decimal=True, last=POINT))
        .when((kind == PERCENT) & s["open"], _state(s, out=_written(s, after=mark), **_CLOSED))
        .when((kind == MONEY) & s["open"], _state(s, out=_written(s, before=mark), **_CLOSED))
        .when((kind == SIGN) & follows, _state(s, out=_written(s), **{**_CLOSED, "sign": mark}))
        .otherwise(other)
    )


def spoken_numbers(s: Column) -> Column:
    """The words of ``s`` (any white space between them) with spelled-out numbers as digits, joined by single spaces."""
    table = lexicon()
    entries = F.create_map(*[x for w, (k, v, m) in table.items() for x in (
        F.lit(w), F.struct(F.lit(k).alias("kind"), F.lit(v).cast("bigint").alias("value"), F.lit(m).alias("mark")))])
    words = F.filter(F.split(s, r"\s+"), lambda w: w != "")

    def entry(w: Column) -> Column:
        found = F.try_element_at(entries, w)
        digits = w.rlike(r"^\d{1,15}$")
        return F.struct(w.alias("word"), F.when(digits, F.lit(DIGITS)).otherwise(F.coalesce(found["kind"], F.lit(0))).alias("kind"),
                        F.when(digits, w.try_cast("bigint")).otherwise(F.coalesce(found["value"], F.lit(0).cast("bigint"))).alias("value"),
                        F.coalesce(found["mark"], F.lit("")).alias("mark"))

    def folded(tagged: Column) -> Column:
        follow = F.concat(F.slice(F.transform(tagged, lambda t: t["kind"]), 2, F.greatest(F.size(tagged), F.lit(1))), F.array(F.lit(0)))
        tokens = F.zip_with(tagged, follow, lambda t, f: F.struct(t["word"].alias("word"), t["kind"].alias("kind"), t["value"].alias("value"),
                                                                t["mark"].alias("mark"), f.alias("follow")))
        start = _state(F.lit(None), out="", **_CLOSED)
        return F.when(F.size(tagged) == 0, F.lit("")).otherwise(F.aggregate(tokens, start, _step, lambda end: F.ltrim(_written(end))))

    return F.element_at(F.transform(F.array(F.transform(words, entry)), folded), 1)
