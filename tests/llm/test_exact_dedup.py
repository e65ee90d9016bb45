"""Content sort: small tables against plain Python, salted groups, empty tables."""

import hashlib

from lotwise.llm import exact_dedup as X

SCHEMA = "doc_id bigint, text string, kept string, salt int"


def norm(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(norm(t), []).append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        first = True
        for i in ids:
            kept = first and i == keep
            first = first and not kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, X.exact_groups(df).collect()), key=repr) == brute(rows)
    return df


def test_small_rows(spark):
    check(spark, [(1, "Abc", "x", 1), (5, "aBC", "y", 2), (3, None, None, None), (4, "", "z", 3), (7, "É", "", 0),
                  (8, "é", "", 0), (9, "ΑΣ", "", 0), (None, "abc", "", 0), (6, "u", "", 0), (6, "U", "", 0),
                  (None, "n", "", 0), (None, "n", "", 0), (10, "x" * 200_000, "", 0), (11, "X" * 200_000, "", 0)])


def test_empty_table(spark):
    df = check(spark, [(1, "a", "", 0)]).limit(0)
    assert X.exact_groups(df).count() == 0 and X.drop_exact_copies(df).count() == 0


def test_hot_group_is_salted_and_whole(spark):
    rows = [(i, "Same text" if i % 3 else f"own {i // 6}", "c", 0) for i in range(9000)]
    df = check(spark, rows)
    kept = X.drop_exact_copies(df)
    assert kept.columns == df.columns
    want = {r[0] for r in brute(rows) if r[3]}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)
