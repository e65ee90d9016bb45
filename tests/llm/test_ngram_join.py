"""Similarity join against all pairs in plain Python, hot groups, edge rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotwise.llm import components as C
from lotwise.llm import ngram_join as J

SCHEMA = "doc_id bigint, text string, n int, h string"


def shingle_set(text, n):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\f\r":
        words = words.replace(blank, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return frozenset()
    n = min(n, len(words))
    return frozenset(tuple(words[i:i + n]) for i in range(len(words) - n + 1))


def smallest(nodes, links):
    up = {i: i for i in nodes}

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {i: root(i) for i in nodes}


def brute(rows, n, percent):
    sets = [(i, shingle_set(t, n)) for i, t, *_ in rows]
    links = []
    for x, (i, s) in enumerate(sets):
        for j, t in sets[:x]:
            if i is not None and j is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                links.append((i, j))
    own = smallest({i for i, _ in sets if i is not None}, links)
    return sorted(((i, len(s), own.get(i)) for i, s in sets), key=repr)


def check(spark, rows, n=3, percent=90):
    got = J.similar_groups(spark.createDataFrame(rows, SCHEMA), n, percent)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, n, percent)


def near_copies(rnd, base, count, most):
    for _ in range(count):
        words = list(base)
        for _ in range(rnd.randint(0, most)):
            at = rnd.randrange(len(words))
            words[at:at + rnd.randint(0, 1)] = [rnd.choice("xyzw") * rnd.randint(1, 4)]
        yield " ".join(words)


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80)])
def test_all_pairs(spark, n, percent):
    rnd = random.Random(n)
    texts = []
    for size in (3, 4, 5, 8, 12, 20, 40, 90, 200):
        base = [f"w{rnd.randint(0, 60)}" for _ in range(size)]
        texts += near_copies(rnd, base, 14, 3 + size // 12)
    texts += [t.upper() for t in texts[:20]] + ["w1 w2 w3"] * 3 + ["one", "One", "one two", "", None, " \n"]
    texts += [("common line of many words here " * 3) + t for t in texts[60:90]]
    rows = [(i, t, 0, "") for i, t in enumerate(texts)]
    rnd.shuffle(rows)
    check(spark, rows, n, percent)


def test_a_large_group_of_near_copies(spark):
    rnd = random.Random(9)
    base = [f"w{rnd.randint(0, 500)}" for _ in range(60)]
    rows = [(i, t, 0, "") for i, t in enumerate(near_copies(rnd, base, 400, 8))]
    check(spark, rows)


def test_edge_rows(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, None, 0, ""), (2, "", 0, ""), (2, "", 0, ""), (None, "a b c d", 0, ""), (None, "a b c d", 0, ""),
            (5, "A b\tc d", 0, ""), (6, "a b c D", 0, ""), (6, "p q r s", 0, ""), (7, "p\x0bq r s", 0, ""), (8, "a\xa0b c d", 0, ""),
            (9, long, 0, ""), (10, long + " end", 0, ""), (11, "É x y z", 0, ""), (12, "é x y z", 0, "")]
    check(spark, rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert J.similar_groups(df).count() == 0 and J.one_of_each_group(df).count() == 0


def test_sent_or_joined_texts(spark, monkeypatch):
    monkeypatch.setattr(J, "SENT_IDS", 0)
    rnd = random.Random(2)
    rows = [(i, t, 0, "") for i, t in enumerate(near_copies(rnd, [f"w{k}" for k in range(40)], 60, 4))]
    check(spark, rows)


def test_one_of_each_group(spark):
    rows = [(3, "a b c d e f g", 1, "x"), (1, "A B C D E F G", 2, "y"), (2, "other words here", 3, "z"), (None, "a b c d e f g", 4, "")]
    kept = J.one_of_each_group(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([rows[1], rows[2], rows[3]], key=repr)


def test_components(spark):
    rnd = random.Random(4)
    links = [(rnd.randint(0, 400), rnd.randint(0, 400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1200)]
    links += [(5000, 5001 + i) for i in range(300)] + [(6000, 6000)]
    got = C.components(spark.createDataFrame(links, "p bigint, q bigint"), "p", "q")
    want = smallest({i for a, b in links for i in (a, b)}, links)
    linked = {i for a, b in links if a != b for i in (a, b)}
    assert {r.id: r.component for r in got.collect()} == {i: c for i, c in want.items() if i in linked}
    assert got.count() == len(linked)


def test_given_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = J.op9_ngram_join(spark, sf)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, 3, 90)
    assert got.where(F.col("component_id") < F.col("doc_id")).count() > 0


def test_words_that_collide_modulo_powers_of_two(spark):
    """A Thue-Morse word and its complement have equal polynomial sums modulo 2^64 at
    every odd number; they are different words here."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    other = word.translate(str.maketrans("ab", "ba"))
    assert len(set(J._word_hashes(f"{word} {other} {word}".encode()).tolist())) == 2
    check(spark, [(1, word, 0, ""), (2, other, 0, ""), (3, f"x {word} y z", 0, ""), (4, f"x {other} y z", 0, ""),
                  (5, f"x {word} y z", 0, "")])


def test_word_hashes_equal_the_plain_ones():
    words = ["a", "b", "ab", "é", "z" * 3000, "\x00", "ab"]
    mask = (1 << 64) - 1

    def plain(w):
        data = w.encode()
        h = len(data) * int(J._MIX) & mask
        for k, point in enumerate(J.POINTS):
            h ^= sum((c + 1) * pow(point, i, J.PRIME) for i, c in enumerate(data)) % J.PRIME << 31 * k
        for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53), (33, 1)):
            h = (h ^ h >> shift) * factor & mask
        return h

    assert J._word_hashes(" ".join(words).encode()).tolist() == [plain(w) for w in words]


def test_hot_sets_and_ids(spark, monkeypatch):
    """Equal sets, empty texts and null ids hold most rows."""
    from lotwise.llm import common

    rows = [(i, "one and the same text here", 0, "") for i in range(1500)] + [(2000 + i, "", 0, "") for i in range(1200)]
    rows += [(None, "one and the same text here", 0, "")] * 30 + [(5000 + i, f"text number {i} stands alone", 0, "") for i in range(50)]
    sets = spark.createDataFrame(rows, SCHEMA).groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    assert {r.text for r in common.hot_keys(sets, "n").collect()} == {"one and the same text here", ""}
    check(spark, rows)


def test_near_copies_that_do_not_link_end_in_the_join(spark):
    """Two sets of 196 shingles that share 166 need 175: the bits of their parts tell, in one
    expression, and never tell of more than the 60 unshared ones."""
    words = [f"w{i}" for i in range(200)]
    one, two = list(words), list(words)
    for i in range(3):
        one[20 + 50 * i] = f"one{i}"
        two[40 + 50 * i] = f"two{i}"
    docs = spark.createDataFrame([(1, " ".join(one)), (2, " ".join(two)), (3, " ".join(words))], "_id bigint, _text string")
    nodes = J._prefixes(docs, 5, 80, np.zeros(1 << 12, np.uint8), 12)
    x, y = nodes.alias("x"), nodes.alias("y")
    got = x.join(y, F.col("x._id") < F.col("y._id")).select(
        F.col("x._id").alias("a"), F.col("y._id").alias("b"), J._oddly_unshared(F.col("x.odd"), F.col("y.odd")).alias("d"))
    d = {(r.a, r.b): r.d for r in got.collect()}
    assert 42 < d[1, 2] <= 60 and d[1, 3] <= 30 and d[2, 3] <= 30
