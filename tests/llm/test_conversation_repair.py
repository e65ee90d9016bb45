"""Conversation repair against trying all edits."""

import functools
import hashlib
import random
import re
import zlib

from lotwise.llm import conversation_repair as C

SCHEMA = "conv_id bigint, turn bigint, role string, text string, conv string, copies int, audit string"
BLANKS = " \t\n\x0b\f\r"


def damage(rows):
    out = []
    for c, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(c, turn, "user" if h == 4 else role, text)] * {0: 0, 3: 2}.get(h, 1)
    return out


def cheapest(rows, faults):
    """Least (cost, audit, repaired rows) over all edits; insertions as long as they may pay."""
    @functools.cache
    def best(i, roles, more):
        options = []
        if i == len(rows):
            if re.fullmatch("(s?(ua)+)?", roles):
                options.append((0, "", ()))
        else:
            (role, text), fault = rows[i], faults[i]
            extra = 5 if fault == "t" else 0
            ways = [(2, "D", roles, None)]
            if fault not in ("b", "d"):
                ways += [(extra, "K", roles + role[:1], (role, text))]
                ways += [(1 + extra, "R", roles + r[0], (r, text)) for r in ("user", "assistant")]
            for cost, edit, after, row in ways:
                if edit == "D" or (len(after) > len(roles) and re.fullmatch("s?(ua)*u?", after)):
                    c, a, rest = best(i + 1, tail(after), 2)
                    options.append((cost + c, edit + a, ((row,) if row else ()) + rest))
        for r in ("user", "assistant") if more else ():
            after = roles + r[0]
            if re.fullmatch("s?(ua)*u?", after):
                c, a, rest = best(i, tail(after), more - 1)
                options.append((5 + c, "I" + a, ((r, ""),) + rest))
        return min(options, default=(1 << 40, "", ()))

    def tail(roles):  # what the grammar still knows of the roles so far
        return "ua" if re.fullmatch("s?(ua)+", roles) else "u" if roles.endswith("u") else roles

    return best(0, "", 2)


def brute(original, rows):
    out = []
    for c in {r[0] for r in original}:
        mine = sorted((r for r in rows if r[0] == c), key=lambda r: (
            r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).digest()))
        faults, seen = [], set()
        for _, _, role, text in mine:
            shown = text.strip(BLANKS)
            faults.append("b" if not shown else "d" if (role, text) in seen else "" if shown[-1] in ".!?" else "t")
            seen.add((role, text))
        turns = {r[1] for r in mine} - {None}
        initials = [r[2][:1] for r in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, fixed = cheapest(tuple((r[2], r[3]) for r in mine), tuple(faults)) if mine else (0, "", ())
        whole = "\n".join(f"{r}:{t}" for r, t in fixed)
        out.append((c, max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("b"), faults.count("d"),
                    faults.count("t"), illegal, cost, audit, hashlib.sha256(whole.encode()).hexdigest()))
    return sorted(out, key=repr)


def check(spark, rows):
    df = spark.createDataFrame([(*r, "x", 9, "y") for r in rows], SCHEMA).repartition(4)
    got = sorted((tuple(r) for r in C.repair(C.damaged(df)).collect()), key=repr)
    assert got == brute(rows, damage(rows))
    plain = [(r[0], r[1], " " if r[2] is None else r[2], " " if r[3] is None else r[3]) for r in rows]
    got = sorted((tuple(r) for r in C.repair(C.rows_of(df)).collect()), key=repr)
    assert got == brute(rows, plain)
    return got


def made(n, seed):
    rng = random.Random(seed)
    texts = ["Hi.", "Hi.", "What?", "cut off", "", " \t", "No!  ", "x y", None, "é…", "a\nb."]
    roles = ["system", "user", "user", "assistant", "assistant", "u", "tool", "", None]
    return [(c, rng.choice([None, *range(12)]) if rng.random() < .2 else t, rng.choice(roles), rng.choice(texts))
            for c in range(n) for t in range(rng.randint(1, 9))]


def test_all_edits(spark):
    check(spark, made(120, 1))


def test_odd_conversations(spark):
    rows = [(None, None, None, None), (None, 3, "user", "Hi."), (-5, -(1 << 62), "user", "a."), (-5, 5, "assistant", "b."),
            (7, None, "user", "q?"), (7, None, "assistant", "r."), (8, 1, "system", "only."),
            (9, 0, "user", "long " * 200_000 + "."), (9, 1, "assistant", "é" * 100_000)]
    rows += [(10, 4, "user", "same.")] * 5 + [(100 + i, t, r, "Fine.") for i in range(300) for t, r in enumerate(("user", "assistant"))]
    check(spark, rows)
    assert C.repair(C.rows_of(spark.createDataFrame([], SCHEMA))).count() == 0


def test_a_hot_conversation(spark):
    n = 5000
    rows = [(1, t, ("user", "assistant")[t % 2], f"line {t}.") for t in range(n)] + [(2, 0, "user", "Hm")]
    df = spark.createDataFrame([(*r, "", 0, "") for r in rows], SCHEMA)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    pieces = C._pieces(C._marked(C.rows_of(df))).collect()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(len(p.letters) for p in pieces if p.conv == 1) == n and len({p.part for p in pieces}) > 1
    got = {r.conv: r for r in C.repair(C.rows_of(df)).collect()}
    assert (got[1].audit, got[1].cost, got[1].gaps, got[2].audit, got[2].cost) == ("K" * n, 0, 0, "D", 2)
    assert got[1].repaired_sha256 == hashlib.sha256("\n".join(f"{r}:{t}" for _, _, r, t in rows[:n]).encode()).hexdigest()


def test_repaired_rows(spark):
    rows = made(60, 3)
    df = spark.createDataFrame([(*r, "x", 9, "y") for r in rows], SCHEMA)
    back = {}
    for r in C.repaired_rows(C.rows_of(df)).orderBy("conv", "position").collect():
        back.setdefault(r.conv, []).append((r.position, r.role, r.text))
    for r in C.repair(C.rows_of(df)).collect():
        mine = back.get(r.conv, [])
        assert [m[0] for m in mine] == list(range(len(mine)))
        assert re.fullmatch("(s?(ua)+)?", "".join(m[1][:1] for m in mine))
        assert hashlib.sha256("\n".join(f"{x}:{t}" for _, x, t in mine).encode()).hexdigest() == r.repaired_sha256


def test_endings_are_shared():
    a = C.Automaton()
    assert a.solve("cba")[1] == C.Automaton().solve("cba")[1]
    pushed = []
    push = a._push
    a._push = lambda letter: (pushed.append(letter), push(letter))
    a.solve("cbab")
    a.solve("cb")
    assert pushed == ["b"] and len(a.cost) == 4 * 3
