"""Toxicity: held-out quality, no use of held-out labels, edge rows."""

import zlib

import numpy as np
import pytest

from lotwise.llm import toxicity as T

SCHEMA = "doc_id bigint, text string, score string, toxic string"
LABELS = "doc_id bigint, toxic int, text string"


def made_up(n, seed):
    """Texts of random syllables; toxic ones hold a few misspelt bad words."""
    rng = np.random.default_rng(seed)
    syllables = ["lo", "ra", "mi", "ten", "ska", "vo", "pel", "dri", "un", "co"]
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(int(rng.integers(5, 300)))]
        bad = bool(i % 4 == 0)
        for _ in range(2 * bad):
            stem = ["grubhead", "snotface", "wretchling"][int(rng.integers(3))]
            at = int(rng.integers(len(stem) - 1))
            words.insert(int(rng.integers(len(words))), stem[:at] + stem[at] * int(rng.integers(1, 3)) + stem[at + 1:])
        docs.append((i, " ".join(words), "s", "t"))
        labels.append((i, int(bad), None))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = made_up(1200, 1)
    return spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, LABELS), dict((a, b) for a, b, _ in labels)


def test_held_out_rows_are_found(spark, tables):
    docs, labels, toxic = tables
    got = {r.doc_id: r.score for r in T.scores(docs, T.fit(docs, labels)).collect()}
    out = [i for i in got if zlib.crc32(str(i).encode()) % 3 == 1]
    hit = np.array([got[i] >= T.THRESHOLD for i in out])
    want = np.array([toxic[i] == 1 for i in out])
    assert hit[want].mean() > 0.95 and hit[~want].mean() < 0.02


def test_held_out_labels_are_not_used(spark, tables):
    docs, labels, _ = tables
    flipped = labels.selectExpr("doc_id", "case when crc32(string(doc_id)) % 3 = 1 then 1 - toxic else toxic end toxic", "text")
    assert np.array_equal(T.fit(docs, labels, train_docs=60).buckets, T.fit(docs, flipped, train_docs=60).buckets)


def test_edge_rows(spark, tables):
    docs, labels, _ = tables
    model = T.fit(docs, labels, train_docs=100)
    rows = [(1, None, "", ""), (2, "", "", ""), (None, "lo ra", "", ""), (4, "a b", "", ""), (4, "a b", "", ""),
            (5, "12 !! __", "", ""), (6, "x" * 300_000, "", ""), (7, "lo mi " * 100_000 + "grubhead snotface", "", "")]
    got = T.scores(spark.createDataFrame(rows, SCHEMA), model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert [r.score for r in got if r.doc_id in (1, 2)] == [0.0, 0.0]
    assert T.scores(docs.limit(0), model).count() == 0
    one_class = T.fit(docs, labels.where("toxic = 0"))
    assert {r.score for r in T.scores(docs, one_class).collect()} == {0.0}
    assert T.scores(docs, T.fit(docs, labels.limit(0))).count() == 1200
    kept = T.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and 800 < kept.count() < 1000


def plain_score(model, text):
    """The score by its definition, one n-gram at a time."""
    mask = (1 << 64) - 1
    step, mix = int(T._STEP), int(T._MIX)

    def bucket(h, salt):
        h = ((h ^ h >> 29) * mix + salt) & mask
        h = (h ^ h >> 32) * step & mask
        return (h >> 48) % T.BUCKETS

    def value(word):
        letters = [ord(c) for c in f"<{word}>"]
        found = [bucket(sum(c * pow(step | 1, i, 1 << 64) for i, c in enumerate(letters)) & mask, 0)]
        for n in T.GRAMS:
            for i in range(len(letters) - n + 1):
                h = 0
                for c in letters[i:i + n]:
                    h = (h * step + c + 1) & mask
                found.append(bucket(h, n))
        return sum(float(model.buckets[b]) for b in found) / len(found)

    words = T.words_of(text)
    if not words:
        return 0.0
    values = [value(w) for w in words]
    size = min(T.WINDOW, len(values))
    worst = max(sum(values[i:i + size]) / size for i in range(len(values) - size + 1))
    return 1 / (1 + np.exp(-(worst + model.bias)))


def test_scores_equal_the_plain_ones(spark, tables):
    docs, labels, _ = tables
    model = T.fit(docs, labels, train_docs=100)
    odd = ["", "é", "Ünï \U0001f600x", "a", "ab cd ef gh ij", "lo " * 50 + "grubbhead wretchling x", "z" * 3000]
    rows = [(10_000 + i, t, "", "") for i, t in enumerate(odd)]
    some = docs.where("doc_id < 200").unionByName(spark.createDataFrame(rows, SCHEMA))
    text = {r.doc_id: r.text for r in some.collect()}
    for r in T.scores(some, model).collect():
        assert abs(r.score - plain_score(model, text[r.doc_id])) < 1e-6


def test_long_labelled_texts_are_read_whole(spark, tables):
    """The one bad word of a text stands deep inside it."""
    docs, labels, toxic = tables
    filler = " ".join(f"w{i % 997}" for i in range(6000))
    long = [(50_000 + i, f"{filler} {filler} grubhead{'x' * (i % 3)} {filler}" if i % 2 else f"{filler} {filler}", "", "") for i in range(80)]
    marks = [(i, int(i % 2), None) for i, *_ in long]
    all_docs = docs.unionByName(spark.createDataFrame(long, SCHEMA))
    model = T.fit(all_docs, labels.unionByName(spark.createDataFrame(marks, LABELS)))
    got = {r.doc_id: r.score for r in T.scores(all_docs, model).collect()}
    out = [i for i, *_ in long if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got[i] >= T.THRESHOLD) == bool(i % 2) for i in out]) > 0.95


def test_given_table(spark):
    got = T.op7_subword_toxicity(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == 1000 and all((r.score >= 0.7) == bool(r.predicted) for r in got)
