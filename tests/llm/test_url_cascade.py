"""URL rules by Bloom filter cascades against a plain reading of the rules."""

import random
import re

from pyspark.sql import functions as F

from lotwise.llm import url_cascade as U

SCHEMA = "page_id bigint, url string, host string, key string"


def plain(url, rules):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
    host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    best = (-1,)
    for h, p, a in rules:
        if h and (host == h or host.endswith("." + h)) and path.startswith(p or ""):
            best = max(best, (len(h + (p or "")), h.count("."), h + (p or ""), a))
    return host, path, best[2] if len(best) > 1 else None, best[3] if len(best) > 1 else "allow"


def check(spark, urls, rules, **how):
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], SCHEMA)
    got = U.judged(df, U.rules_table(spark, rules), **how).collect()
    assert sorted(map(tuple, got), key=lambda r: r[0]) == [(i, *plain(u, rules)) for i, u in enumerate(urls)]
    return got


ODD = [None, "", "net/", "http://net", "http://net/", "https://A.Example.NET/en/1?x#y", "http://example.net/en", "http://xexample.net/en/",
       "ftp://example.com/de/", "http://example.com/DE/", "http://a.org/fr/x", "http://.org/fr/", "http://a.org./fr/", "a://b://c.net/",
       "http://é.net/É/", "://net/", "http://?net/", "http://a.net#/", "http://" + "a." * 3000 + "net/" + "x" * 100_000, "http://net:80/",
       "http://user@example.net/en/\nx", "http://İ.net/", "http:///en/"]


def test_rules_of_the_query(spark):
    got = check(spark, ODD + ODD[:9], U.RULES)
    assert {r.rule for r in got} == {None, "net/", "example.net/en/", "example.com/de/", "org/fr/"}


def corpus(seed, n, hosts):
    rng = random.Random(seed)
    parts = ["a", "b", "c", "de", "news", "x1"]
    return ["http://" + ("hot.a.b" if rng.random() < .3 else ".".join(rng.choices(parts, k=rng.randint(1, hosts))))
            + "/" + "/".join(rng.choices(parts, k=rng.randint(0, 3))) for _ in range(n)]


def rule_list(seed, n):
    rng = random.Random(seed)
    parts = ["a", "b", "c", "de", "news", "x1"]
    found = {}
    for _ in range(n):
        key = (".".join(rng.choices(parts, k=rng.randint(2, 3))), rng.choice(["/", "/b/"]))
        found[key] = rng.choice(["allow", "block"])
    return [(h, p, a) for (h, p), a in found.items()]


def test_many_levels_at_a_high_rate(spark):
    urls, rules = corpus(1, 3000, 5), rule_list(2, 60)
    keys = U.rule_keys(U.rules_table(spark, rules))
    frame = spark.createDataFrame([(i, u, "", "") for i, u in enumerate(urls)], SCHEMA)
    host, path = U.url_parts(F.col("url"))
    asked = U._asked(frame.select(host.alias("host"), path.alias("path")), [(n, m) for n in (1, 2, 3) for m in (1, 3)])
    cascade = U.Cascade(keys.select("key"), asked, 1000, rate=0.5)
    assert len(cascade.levels) > 2
    listed = {r.key for r in keys.collect()}
    answers = asked.select("key", cascade.in_list(F.col("key")).alias("in")).collect()
    assert all((r.key in listed) == r["in"] for r in answers)
    assert all(r["in"] for r in keys.select(cascade.in_list(F.col("key")).alias("in")).collect())


def test_default_rate_and_join_agree(spark):
    urls, rules = corpus(3, 800, 4) + ODD, rule_list(4, 40)
    a = check(spark, urls, rules, rate=0.5)
    b = check(spark, urls + urls[:50], rules, max_words=0)
    c = check(spark, urls, rules, max_shapes=1)
    assert sorted(map(tuple, a)) == sorted(map(tuple, c)) and len(b) == len(urls) + 50


def test_edges(spark):
    check(spark, ["http://a/", None], [])
    check(spark, [], U.RULES)
    check(spark, [], [])
    twice = [("a", "/", "allow"), ("a", "/", "block"), ("", "/x", "block"), ("b", None, "block")]
    got = {r.page_id: (r.rule, r.verdict) for r in U.judged(
        spark.createDataFrame([(0, "http://a/x", "", ""), (1, "http://c.b", "", ""), (None, "http://q/x", "", "")], SCHEMA),
        U.rules_table(spark, twice)).collect()}
    assert got == {0: ("a/", "block"), 1: ("b", "block"), None: (None, "allow")}


def test_plan_has_no_join_and_no_python(spark):
    plan = U.op13_url_cascade(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Python" not in plan and "Arrow" not in plan
