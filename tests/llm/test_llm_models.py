"""Language-model scoring, toxicity and language ID: held-out quality, exact parts by brute force, and edge cases."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from auralith.llm import brown_lm, language_id, toxicity
from auralith.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def base_by_brute_force(rows, train):
    count, texts = Counter(), 0
    for _, text in (r for r in rows if train(r[0])):
        count.update(tokens_of(text))
        texts += 1
    total, kinds = sum(count.values()) + texts, len(count) + (texts > 0)
    out = {}
    for doc, text in rows:
        words = tokens_of(text)
        c = [count[w] for w in words] + [texts]
        out[doc] = (len(c), sum(x > 0 for x in c), total, sum(math.log10((x + 1) / (total + kinds + 1)) for x in c))
    return out


def test_op2_base_is_exact_and_the_model_beats_it_on_held_out_text(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows}
    want = base_by_brute_force(rows, lambda d: not held[d])
    got = QUERIES["op2_brown_lm_scoring"](spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == held[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3]
        assert r.base_score == pytest.approx(want[r.doc_id][3])
        assert r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens))
    out = [r for r in got if r.held_out]
    assert out and sum(r.score for r in out) > sum(r.base_score for r in out)


def small_model(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs, brown_lm.fit(docs, classes=8, rounds=3, item_share=1e-3, **options)


def test_probabilities_sum_to_one_and_scores_follow_them(spark):
    rng = np.random.default_rng(2)
    a, b = [f"la{i}" for i in range(30)], [f"ru{i}." for i in range(30)]
    rows = [(i, " ".join(rng.choice(a if i % 2 else b, 25))) for i in range(120)]
    docs, model = small_model(spark, rows)
    assert np.allclose((10.0 ** model.transition).sum(axis=-1), 1)
    counts = Counter(w for _, t in rows for w in t.split())
    words = sorted(counts)
    piece = brown_lm.blocks.scan(pa.array([" ".join(words)]))
    _, _, item = model.items.find(piece)
    of = model.class_of[item]
    for c in set(of.tolist()):  # the words of a class and one unseen word
        mass = sum((counts[w] + 1) / 10 ** model.norm[c] for w, k in zip(words, of) if k == c) + 1 / 10 ** model.norm[c]
        assert mass == pytest.approx(1)
    assert not set(of[:30].tolist()) & set(of[30:].tolist())  # exchange clustering parts the two vocabularies
    for hot in (1e-6, 0.9):  # every count broadcast, every count joined
        _, other = small_model(spark, rows, hot_share=hot)
        scored = {r.doc_id: r for r in brown_lm.score(docs, other).collect()}
        for i, text in rows[:6]:
            two, one, total = 0, 0, 0.0
            for w in [*text.split(), None]:
                c = 0 if w is None else int(of[words.index(w)]) if hot < 0.5 else int(other.class_of[other.items.find(brown_lm.blocks.scan(pa.array([w])))[2][0]])
                total += other.transition[two, one, c] + (0 if w is None else math.log10(counts[w] + 1) - other.norm[c])
                two, one = one, c
            assert scored[i].score == pytest.approx(total) and scored[i].n_known == scored[i].n_tokens


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(0)
    pairs = np.zeros((21, 21))
    for _ in range(4000):
        left = rng.integers(1, 21)
        pairs[left, rng.integers(1, 11) if left > 10 else rng.integers(11, 21)] += 1
    of = np.r_[0, 1 + np.arange(20) % 2]

    def sides(of):
        after, before = np.zeros((21, 3)), np.zeros((21, 3))
        np.add.at(after.T, of, pairs.T)
        np.add.at(before.T, of, pairs)
        return after, before

    start = brown_lm.likelihood(sides(of)[0], of, 3)
    for turn in range(12):
        of = brown_lm.exchange(*sides(of), of, 3, turn)
    assert brown_lm.likelihood(sides(of)[0], of, 3) > start
    assert len(set(of[1:11])) == 1 and len(set(of[11:])) == 1 and of[1] != of[11]


def test_brown_edges(spark):
    rows = [(1, "a b a."), (1, "a b a."), (2, None), (3, ""), (None, "a 12 zz"), (4, "word " * 30000)]
    docs, model = small_model(spark, rows)
    got = brown_lm.score(docs.withColumn("score", F.lit("x")), model).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known) for r in got) == [("1", 4, 4), ("1", 4, 4), ("2", 1, 1), ("3", 1, 1), ("4", 30001, 30001), ("None", 4, 4)]
    assert all(math.isfinite(r.score) and r.score <= 0 for r in got)
    nothing = brown_lm.fit(docs.limit(0), classes=4, rounds=1)
    out = brown_lm.score(docs, nothing).collect()
    assert len(out) == len(rows) and all(r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 for r in out)
    assert brown_lm.score(docs.limit(0), model).count() == 0


def toxic_corpus(n, seed):
    rng = np.random.default_rng(seed)
    plain, bad = [f"word{i}" for i in range(400)], ["vilest", "rottenly", "scorner", "qolumnak", "Scorner!!", "xqolumy"]
    rows, labels = [], []
    for i in range(n):
        words = list(rng.choice(plain, rng.integers(15, 120)))
        toxic = rng.random() < 0.12
        for _ in range(3 if toxic else 0):
            words[rng.integers(len(words))] = str(rng.choice(bad))
        rows.append((i, " ".join(words)))
        labels.append((i, (1 if toxic else 0) if rng.random() < 0.4 else None, toxic))
    return rows, labels


def test_toxicity_on_held_out_documents(spark):
    rows, labels = toxic_corpus(3000, 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([x[:2] for x in labels], "doc_id long, toxic int").filter("toxic is not null")
    train = toxicity.fold(F.col("doc_id")) != 0
    model = toxicity.fit(docs, known, train)
    truth = {i: t for i, _, t in labels}
    got = [r for r in toxicity.score(docs, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    hits = sum(r.predicted for r in got if truth[r.doc_id]) / sum(truth[r.doc_id] for r in got)
    false = sum(r.predicted for r in got if not truth[r.doc_id]) / sum(not truth[r.doc_id] for r in got)
    assert hits >= 0.95 and false <= 0.02, (hits, false)
    held = known.withColumn("toxic", F.when(train, F.col("toxic")).otherwise(1 - F.col("toxic")))  # held-out labels change nothing
    again = toxicity.fit(docs, held, train)
    assert again.bias == pytest.approx(model.bias) and np.allclose(again.weight, model.weight, atol=1e-4)


def test_toxicity_edges(spark):
    rows, labels = toxic_corpus(400, 2)
    docs = spark.createDataFrame([(i, t, "x", 0.5) for i, t in rows], "doc_id long, text string, predicted string, score double")
    known = spark.createDataFrame([x[:2] for x in labels] + [(None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, known)
    odd = spark.createDataFrame([(1, None), (None, ""), (3, "!!! ..."), (4, "é " * 20000), (4, "é " * 20000)], "doc_id long, text string")
    out = toxicity.score(odd, model).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert toxicity.score(docs, model).columns == ["doc_id", "text", "score", "predicted"]
    empty = toxicity.fit(docs, known.limit(0))
    assert {r.predicted for r in toxicity.score(odd, empty).collect()} == {0}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_non_negative_step_stops_overfit():
    rng = np.random.default_rng(0)
    n, size = (40, 400), 60
    positive = (np.repeat(np.arange(40), 2), np.r_[np.zeros(40, int), rng.integers(1, size, 40)].reshape(2, 40).T.ravel())
    rows = rng.integers(1, size, (400, 2))
    rows[:40, 0] = 0  # the tenth of unlabelled rows that is positive
    w, bias = toxicity.nn_pu(positive, (np.repeat(np.arange(400), 2), rows.ravel()), n, size, 0.1)
    margin = bias + w[rows].sum(axis=1)
    assert (margin[:40] > 0).mean() > 0.9 and (margin[40:] < 0).mean() > 0.95


def test_op9_and_op10_cover_every_document(spark):
    ids = sorted(r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())
    for name, rest, modulus, out in (("op9_toxicity", {"score", "predicted"}, 5, 0), ("op10_language_id", {"lang_pred", "score"}, 4, 2)):
        got = QUERIES[name](spark, SF)
        assert set(got.columns) == {"doc_id", "held_out"} | rest
        got = got.collect()
        assert sorted(r.doc_id for r in got) == ids
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == out) and 0 <= r.score <= 1 for r in got)


def test_best_classes_are_those_of_the_largest_likelihood():
    """Each word moved alone, by counting everything anew."""
    rng = np.random.default_rng(5)
    size, classes = 40, 6
    pairs = rng.poisson(rng.gamma(0.4, 3, (size, size)))
    of = np.concatenate([[0], 1 + rng.integers(0, classes - 1, size - 1)])

    def table(of):
        both = np.zeros((classes, classes))
        np.add.at(both, (of[:, None], of[None, :]), pairs)
        return both

    np.fill_diagonal(pairs, 0)  # a word beside itself counts with its class as it was
    after, before = np.zeros((size, classes)), np.zeros((size, classes))
    for c in range(classes):
        after[:, c], before[:, c] = pairs[:, of == c].sum(axis=1), pairs[of == c].sum(axis=0)
    got = brown_lm.best_classes(after[1:], before[1:], of[1:], table(of))
    for w, c in enumerate(got, 1):
        value = [brown_lm.table_likelihood(table(np.where(np.arange(size) == w, k, of))) for k in range(1, classes)]
        assert value[c - 1] >= max(value) - 1e-9


def test_words_of_an_absolute_count_get_classes_of_their_own(spark):
    """Rare words of one spelling pattern that stand in the places of two groups of frequent words."""
    rng = random.Random(3)
    left, right = [f"l{i}xyz" for i in range(20)], [f"r{i}xyz" for i in range(20)]
    groups = [["alpha", "beta"] * 20 + left, ["gamma", "delta"] * 20 + right]
    texts = [" ".join(rng.choice(g) for _ in range(60) for g in groups) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = brown_lm.fit(docs, classes=5, item_share=0.05, word_count=10 ** 9)
    own = brown_lm.fit(docs, classes=5, item_share=0.05, word_count=50)
    assert own.items.size == plain.items.size + 40
    of = own.class_of[own.items.find(brown_lm.blocks.scan(pa.array([" ".join(left + right)])))[2]]
    most = [Counter(x.tolist()).most_common(1)[0][0] for x in (of[:20], of[20:])]
    assert most[0] != most[1]
    gain = [brown_lm.score(docs, m).agg({"score": "sum"}).first()[0] for m in (plain, own)]
    assert gain[1] > gain[0]


def test_language_id_on_held_out_documents(spark):
    sf = SF.replace("0.001", "0.01")
    got = QUERIES["op10_language_id"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) >= 0.98


def grams_by_brute_force(text):
    out = Counter()
    letters = "".join(c.lower() if c.isalpha() else " " for c in text)
    for word in letters.split():
        out.update(word)
        padded = f" {word} "
        out.update(padded[i: i + 2] for i in range(len(padded) - 1))
        out.update(padded[i: i + 3] for i in range(len(padded) - 2))
    return out


def test_ngrams_and_out_of_place_distance(spark):
    texts = ["", "a", "Ab1ba!! cc\n", "Straße übel", None, "x" * 300, "Добрый день, ΚΑΛΗ μέρα", "東京 \U00031350\U00031351", " \U0001F600 "]
    row, gram, n = language_id.counted(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        got = {language_id.spelled(g): k for g, k in zip(gram[row == i].tolist(), n[row == i].tolist())}
        assert got == dict(grams_by_brute_force(t or ""))
    train = spark.createDataFrame([("l1", "abab abab ab"), ("l2", "cdcd cd"), (None, "zzzz"), ("l3", None)], "lang string, text string")
    profiles = language_id.fit(train, size=5)
    assert profiles.languages == ["l1", "l2"]
    far, count = language_id.distances(pa.array(["abab abab ab", "cd", "..."]), profiles)
    assert far[0, 0] == 0 and count.tolist()[0] == 5 and count.tolist()[2] == 0
    assert far[0, 1] == 5 * count[1]  # nothing of it is in the first profile


def test_languages_of_one_script_and_letters_beyond_the_first_planes(spark):
    train = spark.createDataFrame([("ru", "что это такое и как это было " * 9), ("uk", "що це таке і як це було її " * 9), ("el", "τι είναι αυτό και πώς " * 9)], "lang string, text string")
    texts = ["это было так", "це було її", "αυτό είναι", "\U00031350\U00031351", "123", "\U0001F600"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r.lang_pred for r in language_id.predict(docs, language_id.fit(train)).collect()}
    assert [got[i] for i in range(3)] == ["ru", "uk", "el"] and got[3] != "und" and got[4] == got[5] == "und"


def test_ngram_numbers_that_do_not_fit_beside_their_rows():
    """Very many different letters in one batch."""
    letters = [chr(p) for p in range(0x4E00, 0x9F00)] + [chr(p) for p in range(0xAC00, 0xD700)]
    texts = ["".join(letters)] + ["ab"] * 300_000
    row, gram, n = language_id.counted(pa.array(texts, pa.string()))
    assert (np.bincount(row)[1:] == 7).all() and (row == 0).sum() == len(grams_by_brute_force(texts[0]))


def test_language_id_edges(spark):
    train = spark.createDataFrame([("b", "abc abc"), ("a", "abc abc")], "lang string, text string")
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "123 !", "x"), (4, "abc", "x"), (None, "abc " * 30000, None), (4, "abc", "x"), (5, "日本 \U0001F600", "x")],
                                 "doc_id long, text string, score string")
    out = language_id.predict(docs, language_id.fit(train))
    assert out.columns == ["doc_id", "text", "lang_pred", "score"]
    got = sorted((str(r.doc_id), r.lang_pred) for r in out.collect())
    assert got == [("1", "und"), ("2", "und"), ("3", "und"), ("4", "a"), ("4", "a"), ("5", "a"), ("None", "a")]
    assert {r.lang_pred for r in language_id.predict(docs, language_id.fit(train.limit(0))).collect()} == {"und"}
    assert language_id.predict(docs.limit(0), language_id.fit(train)).count() == 0
