"""T2 subset: the Spark expression chain against a plain-Python statement of the same rules."""

import re
import unicodedata

from pyspark.sql import functions as F

from auralith.functions import text as T


def python_english(s: str) -> str:
    s = s.lower()
    s = re.sub(r"[<\[][^>\]]*[>\]]", "", s)
    s = re.sub(r"\(([^)]+?)\)", "", s)
    s = re.sub(T.ENGLISH_FILLERS, "", s)
    s = re.sub(r"\s+'", "'", s)
    for pattern, repl in T.ENGLISH_REPLACERS:
        s = re.sub(pattern, repl, s)
    s = re.sub(r"(\d),(\d)", r"\1\2", s)
    s = re.sub(r"\.([^0-9]|$)", r" \1", s)
    extra = dict(T.ADDITIONAL_DIACRITICS)
    out = []
    for c in unicodedata.normalize("NFKD", s):
        if c in T.ENGLISH_KEEP_SYMBOLS:
            out.append(c)
        elif c in extra:
            out.append(extra[c])
        elif unicodedata.category(c) == "Mn":
            continue
        elif unicodedata.category(c)[0] in "MSP":
            out.append(" ")
        else:
            out.append(c)
    s = " ".join("".join(out).split())
    s = re.sub(r"[.$¢€£]([^0-9])", r" \1", s)
    s = re.sub(r"([^0-9])%", r"\1 ", s)
    return re.sub(r"\s+", " ", s)


CASES = [
    "Um, I can't go to St. Mary's (aside) party, uh... It's 1,000,000 $5.50 or 30% off!",
    "Mr Smith and Dr. Jones won't   y'all gonna — they'd been there; she's got it.",
    "Cœur Ærø straße  um um um  hmm <noise> [laugh] naïve café",
    "Prices: £3.20, €4, ¢5; 12.5% of 3,4",
    "",
]


def test_english_matches_python(spark):
    df = spark.createDataFrame([(c,) for c in CASES], "s string")
    got = [r.o for r in df.select(T.english_normalize(F.col("s")).alias("o")).collect()]
    assert got == [python_english(c) for c in CASES]


def test_spelling_map(spark):
    df = spark.createDataFrame([("the colour grey",)], "s string")
    assert df.select(T.english_normalize(F.col("s"), {"colour": "color", "grey": "gray"}).alias("o")).first().o == "the color gray"


def test_spoken_numbers_on_hand_worked_lines(spark):
    from auralith.functions.numbers import spoken_numbers

    cases = [("two thousand and five cats", "2005 cats"), ("nineteen eighty four", "1984"), ("one two three", "123"), ("twenty first century", "21st century"),
             ("the nineties", "the 90s"), ("three point one four", "3.14"), ("5 million", "5000000"), ("minus five degrees", "-5 degrees"),
             ("twenty percent of it", "20% of it"), ("five dollars and ten cents", "$5 and ¢10"), ("one hundred and one", "101"), ("hundred and", "100 and"),
             ("three hundred forty two thousand six hundred and seven", "342607"), ("salt and pepper", "salt and pepper"), ("point taken", "point taken"),
             ("zero point five", "0.5"), ("one million two hundred thousand", "1200000"), ("first", "1st"), ("one hundredth", "100th"), ("ten and two", "10 and 2"),
             ("", ""), ("no  numbers", "no numbers"), ("20 percent", "20%"), ("twenty twenty", "2020"), ("fiftieth", "50th"), ("plus and minus", "plus and minus")]
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(cases)], "i int, a string")
    got = {r.i: r.o for r in df.select("i", spoken_numbers(F.col("a")).alias("o")).collect()}
    assert [got[i] for i in range(len(cases))] == [b for _, b in cases]
