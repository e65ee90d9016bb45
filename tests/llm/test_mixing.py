"""Mixing: targets against the loop of the contract, words taken, positions."""

import re

import pytest

from lotwise.llm import mixing as M

SCHEMA = "doc_id bigint, text string, source string, size int, target string"


def targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        share = sum(w for s, w in weights.items() if s not in full) or 1
        t = {s: 3 * sizes[s] if s in full else rest * weights[s] / share for s in names}
        over = {s for s in names if s not in full and t[s] > 3 * sizes[s]}
        if not over:
            return t
        full |= over


def check(spark, rows, **kw):
    got = M.curriculum(spark.createDataFrame(rows, SCHEMA), **kw).collect()
    assert len(got) == len(rows)
    sizes, taken = {}, {}
    for r in rows:
        sizes[r[2]] = sizes.get(r[2], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    want = targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 1
    return got


def test_small_rows(spark):
    rows = [(i, " w\t" * (i % 7) + " x\x1cy" * (i % 2), f"s{i % 5}", 0, "t") for i in range(60)]
    rows += [(100, None, "s1", 0, ""), (101, "", None, 0, ""), (102, "a b", None, 0, ""), (102, "a b", None, 0, ""),
             (None, "lone\nword", "Z", 0, ""), (103, "w " * 40_000, "é", 0, "")]
    got = check(spark, rows)
    assert got == check(spark, rows, bucket_rows=2)
    placed = [r.position for r in got if r.position is not None]
    assert placed == sorted(placed)


def test_no_words_and_empty_table(spark):
    check(spark, [(1, None, "a", 0, ""), (2, " \n", None, 0, "")])
    df = spark.createDataFrame([], SCHEMA)
    assert M.curriculum(df).count() == 0 and M.mixed_documents(df).count() == 0


def test_mixed_documents_repeat_by_passes(spark):
    rows = [(i, "a b c d", "s0" if i < 4 else "s2", 0, "") for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    mixed = M.mixed_documents(df)
    assert mixed.columns == df.columns
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert all(counts[i] == 3 for i in range(4)) and max(counts.values()) <= 3


def test_every_pass_has_its_place(spark):
    rows = [(i, "w " * (1 + i % 9), f"s{i % 4}", 0, "") for i in range(400) if i % 4 or i % 16 == 0]
    got = check(spark, rows)
    spans, last = {}, {}
    for r in got:
        assert (r.positions or [None])[0] == r.position and len(r.positions or ()) == -(-r.taken // r.size)
        g = {"s0": 0.5, "s1": 0.0, "s2": -0.5, "s3": 0.5}[r.source]
        for p, at in enumerate(r.positions or ()):
            words = min(r.size, r.taken - p * r.size)
            spans.setdefault(r.source, []).append((at, words, r.target, g))
    bent = {s: (x[0][2], x[0][3]) for s, x in spans.items()}
    for s, x in spans.items():
        done, (target, g) = 0, bent[s]
        for at, words, _, _ in sorted(x):
            # Time t of the place: the demands of all sources at t sum to it.
            low, high = 0.0, 1.0
            for _ in range(60):
                t = (low + high) / 2
                low, high = (t, high) if sum(a * (t + b * (t - t * t)) for a, b in bent.values()) < at else (low, t)
            assert target * (t + g * (t - t * t)) == pytest.approx(done + words / 2, abs=0.01)
            done += words
        last[s] = t
        assert abs(done - target) <= 1
    assert any(r.taken > r.size for r in got) and min(last.values()) > 0.9


def test_mixed_documents_are_in_training_order(spark, monkeypatch):
    rows = [(i, "w " * (1 + i % 9), f"s{i % 4}", 0, "") for i in range(400) if i % 4 or i % 16 == 0]
    rows += [(None, "a b", "s1", 0, "")] * 3 + [(500, "", "s1", 0, "")]
    df = spark.createDataFrame(rows, SCHEMA)

    def expected():
        places = []
        for r in M.curriculum(df).collect():
            n = int(r.taken / r.size + 0.5) if r.size else 1
            places += [(at, r.doc_id) for at in ((r.positions or [])[:n] if r.size else [float("inf")])]
        ties = {}
        for at, i in places:
            ties.setdefault(at, []).append(str(i))
        return [sorted(ties[at]) for at in sorted(ties)]

    def in_order(want):
        got, at = [str(r.doc_id) for r in M.mixed_documents(df).collect()], 0
        for ids in want:
            assert sorted(got[at:at + len(ids)]) == ids
            at += len(ids)
        return at == len(got)

    want = expected()
    assert in_order(want) and want[-1] == ["500"]
    monkeypatch.setattr(M.curriculum, "__defaults__", tuple(
        (-0.5, 0.0, 0.5) if d == M.RAMPS else d for d in M.curriculum.__defaults__))
    turned = expected()
    assert in_order(turned) and turned != want
