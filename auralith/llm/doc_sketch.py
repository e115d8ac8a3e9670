"""Document fingerprints by threshold-scaled sketches (operator 12).

A text's shingles are its runs of ``width`` words (fewer words: the whole sequence as one). Every shingle is hashed (the
first 64 bits of md5, as 16 hexadecimal digits), and the sketch keeps each hash below a fixed fraction of the hash range,
sorted and without repeats. Whether a hash is kept depends on the hash alone, so sketches merge (the sketch of two texts
together is the union of theirs) and the share of the smaller sketch found in the larger estimates containment however
unequal the texts are. A text none of whose hashes lies below the fraction keeps its least one, so that every text with
a word has a fingerprint. The fingerprint is the sketch written out.

Everything is DataFrame functions. ``compare_next`` lays each text beside the document that follows it in a given order:
the order is taken from keys alone, each text is shuffled once by its key, and of the follower only the part that is
needed and its sketch travel on.

Defined cases: a null text is empty; a text without words has the fingerprint ''; two empty fingerprints are alike (1.0), an
empty and another are not (0.0); null ids come last; documents of one id are ordered by a hash of their texts;
repeated rows follow each other; an empty table gives an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auralith.operators.ordering import dense_index

WIDTH, FRACTION = 5, 0.25
_SPACE = r"[\x20\x09-\x0D]+"


def threshold(fraction: float) -> str:
    """Hashes (16 hexadecimal digits) below this string are kept."""
    return f"{min(int(fraction * 2 ** 64), 2 ** 64 - 1):016x}"


def sketch(text: Column, width: int = WIDTH, fraction: float = FRACTION) -> Column:
    """Sorted distinct shingle hashes below ``fraction`` (the least one, if none is) as an array of strings."""
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), _SPACE), "")

    def hashes(w: Column) -> Column:
        # get() beyond the end is null, which concat_ws leaves out; slice() would copy the whole array at each step
        starts = F.sequence(F.lit(0), F.greatest(F.size(w) - width, F.lit(0)))
        return F.transform(starts, lambda i: F.substring(F.md5(F.concat_ws(" ", *[F.get(w, i + j) for j in range(width)])), 1, 16))

    def kept(h: Column) -> Column:
        low = F.filter(h, lambda x: x < F.lit(threshold(fraction)))
        return F.when(F.size(low) > 0, F.array_sort(F.array_distinct(low))).otherwise(F.array(F.array_min(h)))

    # one-element transforms bind the words and the hashes, so that neither is computed again at each mention
    bound = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, F.transform(F.array(hashes(w)), kept)[0]))
    return F.coalesce(bound[0], F.array().cast("array<string>"))


def merge(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """Sketch of two texts together, from their sketches."""
    both = F.array_sort(F.array_union(a, b))
    low = F.filter(both, lambda x: x < F.lit(threshold(fraction)))
    return F.when(F.size(low) > 0, low).otherwise(F.slice(both, 1, 1))


def likeness(a: Column, b: Column) -> Column:
    """Estimated containment of the text with the smaller sketch in the other (0 to 1)."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise((F.size(a) == F.size(b)).cast("double"))


def fingerprint(kept: Column) -> Column:
    return F.array_join(kept, "")


def packed(kept: Column) -> Column:
    """A sketch as eight bytes a hash, for shuffles."""
    return F.unhex(fingerprint(kept))


def unpacked(raw: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.hex(raw)), F.lit("[0-9a-f]{16}"), F.lit(0))


def compare_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, fraction: float = FRACTION) -> DataFrame:
    """One row per document: its ``text``, ``sketch``, the ``edited`` text (its last half replaced by the first half of
    the next document in descending order of ids; the first follows the last), its ``edited_sketch``, and the likenesses
    ``near_edited`` and ``near_next``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = docs.select(F.col(id_col).cast("long").alias("doc"), text.alias("text"))
    key = ["void", "id", "h1", "h2"]
    source = source.select(F.col("doc").isNull().alias("void"), F.coalesce("doc", F.lit(0)).alias("id"), F.xxhash64("text").alias("h1"),
                           F.xxhash64(F.lit(12), "text").alias("h2"), "text")
    sizes = source.select(*key, F.char_length("text").alias("n")).groupBy(*key).agg(F.count(F.lit(1)).alias("times"), F.first("n").alias("n"))
    order = dense_index(sizes, [F.col("void"), F.col("id").desc(), F.col("h1"), F.col("h2")], "at")
    total = order.count()
    follower = order.select(*[F.col(c).alias(f"n_{c}") for c in key], F.pmod(F.col("at") - 1, F.lit(max(1, total))).alias("at"))
    pairs = order.join(follower, "at").drop("at")
    again = order.filter("times > 1").select("*", *[F.col(c).alias(f"n_{c}") for c in key]).drop("at").withColumn("times", F.col("times") - 1)
    pairs = pairs.withColumn("times", F.lit(1).cast("long")).unionByName(again)

    texts = source.groupBy(*key).agg(F.first("text").alias("text"))
    after = texts.select(*[F.col(c).alias(f"n_{c}") for c in key], F.col("text").alias("n_text"))
    after = pairs.hint("merge").join(after, [f"n_{c}" for c in key])
    half = F.floor(F.col("n") / 2).cast("int")
    after = after.select(*key, "n", "times", F.substring("n_text", F.lit(1), half).alias("head"), packed(sketch(F.col("n_text"), width, fraction)).alias("n_sketch"))
    both = texts.hint("merge").join(after, key)
    edited = F.concat(F.substring("text", F.lit(1), F.col("n") - half), F.col("head"))
    both = both.select("void", "id", "n", "times", "text", unpacked(F.col("n_sketch")).alias("n_sketch"), edited.alias("edited"))
    both = both.withColumns({"sketch": sketch(F.col("text"), width, fraction), "edited_sketch": sketch(F.col("edited"), width, fraction)})
    return both.select(
        F.when(~F.col("void"), F.col("id")).alias(id_col), F.col("n").cast("long").alias("n_chars"), "text", "sketch", "edited", "edited_sketch",
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), likeness(F.col("sketch"), F.col("n_sketch")).alias("near_next"),
        F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")).drop("copy")


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
o AS (SELECT *, length(text) AS n, row_number() OVER (ORDER BY doc_id DESC NULLS LAST) AS at, count(*) OVER () AS total FROM d),
e AS (SELECT a.doc_id, a.n, a.text, b.text AS next,
             left(a.text, (a.n - a.n // 2)::BIGINT) || left(b.text, (a.n // 2)::BIGINT) AS edited
      FROM o a JOIN o b ON b.at = a.at % a.total + 1),
t AS (SELECT doc_id, n, edited, 1 AS kind, text AS body FROM e UNION ALL SELECT doc_id, n, edited, 2, edited FROM e
      UNION ALL SELECT doc_id, n, edited, 3, next FROM e),
w AS (SELECT doc_id, kind, unnest(words) AS word, generate_subscripts(words, 1) AS pos, len(words) AS n_words
      FROM (SELECT doc_id, kind, regexp_extract_all(body, '[^\\x20\\x09-\\x0D]+') AS words FROM t)),
h AS (SELECT doc_id, kind, pos, n_words, left(md5(concat_ws(' ', word, {", ".join(f"lead(word, {j}) OVER p" for j in range(1, WIDTH))})), 16) AS hash
      FROM w WINDOW p AS (PARTITION BY doc_id, kind ORDER BY pos)),
g AS (SELECT doc_id, kind, min(hash) AS least, list_sort(list(DISTINCT hash) FILTER (hash < '{threshold(FRACTION)}')) AS low
      FROM h WHERE pos <= greatest(n_words - {WIDTH - 1}, 1) GROUP BY doc_id, kind),
s AS (SELECT t.doc_id, t.n, t.edited, t.kind, coalesce(g.low, CASE WHEN g.least IS NULL THEN []::VARCHAR[] ELSE [g.least] END) AS kept
      FROM t LEFT JOIN g ON g.doc_id = t.doc_id AND g.kind = t.kind)
SELECT a.doc_id, a.n::BIGINT AS n_chars, sha256(a.edited) AS edited_sha256, array_to_string(a.kept, '') AS fingerprint,
       array_to_string(b.kept, '') AS edited_fingerprint,
       CASE WHEN least(len(a.kept), len(b.kept)) > 0 THEN len(list_intersect(a.kept, b.kept))::DOUBLE / least(len(a.kept), len(b.kept))
            ELSE (len(a.kept) = len(b.kept))::INT::DOUBLE END AS near_edited,
       CASE WHEN least(len(a.kept), len(c.kept)) > 0 THEN len(list_intersect(a.kept, c.kept))::DOUBLE / least(len(a.kept), len(c.kept))
            ELSE (len(a.kept) = len(c.kept))::INT::DOUBLE END AS near_next
FROM s a JOIN s b USING (doc_id) JOIN s c USING (doc_id) WHERE a.kind = 1 AND b.kind = 2 AND c.kind = 3
"""
