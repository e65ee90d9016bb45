"""Property tests: Spark expressions against plain-Python statements of the
same rules, on random inputs (many values per Spark job)."""

from urllib.parse import parse_qsl, quote_plus, urlsplit, urlunsplit

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lotwise.functions import scalars as fn
from lotwise.operators import dedupe

SETTINGS = dict(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))

text = st.text(alphabet=st.sampled_from(list("0123456789$,. -abcXYZ\t%")), max_size=25)
host = st.sampled_from(["a.com", "B.org", "x.example.net:8080", ""])
path = st.text(alphabet=st.sampled_from(list("abc/-_.~%20")), max_size=12)
qpart = st.text(alphabet=st.sampled_from(list("kvAUTM_=+ %é*~2")), max_size=8)
urls = st.builds(
    lambda lead, scheme, h, p, qs, frag: f"{lead}{scheme}://{h}/{p}" + (("?" + "&".join(qs)) if qs else "") + frag,
    st.sampled_from(["", " ", "\t"]), st.sampled_from(["http", "https", "HTTP", "Https"]), host, path,
    st.lists(st.one_of(qpart, st.just("utm_source=x"), st.just("UTM_Campaign=y")), max_size=4),
    st.sampled_from(["", "#f", "#a?b"]))


def run(spark, values, f, typ="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {typ}")
    return [r[1] for r in sorted(df.select("i", f("x")).collect())]


def py_clean_number(t):
    d = "".join(ch for ch in (t or "") if ch in "0123456789")
    return int(d) if d and int(d) < 2 ** 63 else None


def py_strip(u):
    p = urlsplit(u)
    return urlunsplit((p.scheme, p.netloc, p.path, "", ""))


def py_untrack(u):
    p = urlsplit(u)
    kept = [kv for kv in parse_qsl(p.query, keep_blank_values=True) if not kv[0].lower().startswith("utm_")]
    query = "&".join(quote_plus(k) + "=" + quote_plus(v) for k, v in kept)
    return urlunsplit((p.scheme, p.netloc, p.path, query, ""))


@settings(**SETTINGS)
@given(st.lists(text, min_size=1, max_size=80))
def test_clean_number_matches_python(spark, values):
    assert run(spark, values, fn.clean_number) == [py_clean_number(v) for v in values]


@settings(**SETTINGS)
@given(st.lists(urls, min_size=1, max_size=60))
def test_url_strip_matches_stdlib(spark, values):
    assert run(spark, values, fn.url_strip) == [py_strip(v) for v in values]


@settings(**SETTINGS)
@given(st.lists(urls, min_size=1, max_size=60))
def test_url_untrack_matches_stdlib(spark, values):
    assert run(spark, values, fn.url_untrack) == [py_untrack(v) for v in values]


@settings(**SETTINGS)
@given(st.lists(st.text(alphabet=st.sampled_from(list("0129 aX\t 　")), max_size=8), min_size=1, max_size=60))
def test_year_and_blank_match_python(spark, values):
    years = [int(v[:4]) if len(v) >= 4 and all(c in "0123456789" for c in v[:4]) else None for v in values]
    assert run(spark, values, fn.title_year) == years
    assert run(spark, values, fn.is_blank) == [not v.strip() for v in values]


rows = st.lists(st.tuples(st.sampled_from(["u1", "u2", "u3", "", None]),
                          st.sampled_from(["", None, "2024-01-01", "2024-01-02", "2023-12-31"])),
                min_size=1, max_size=40)


@settings(**SETTINGS)
@given(rows)
def test_merge_and_dedupe_match_sequential_rules(spark, data):
    df = spark.createDataFrame([(i, u, s) for i, (u, s) in enumerate(data)], "pos int, url string, first_seen string")
    # sequential statement of the merge: walk rows in order, replace only on a strictly earlier non-blank stamp
    best, first = {}, {}
    for i, (u, s) in enumerate(data):
        if not u:
            continue
        first.setdefault(u, i)
        if u not in best or (s and (not best[u][1] or s < best[u][1])):
            best[u] = (i, s)
    got = {r.url: (r.pos, r.first_pos.pos) for r in dedupe.merge_first_seen(df, ["pos"]).collect()}
    assert got == {u: (best[u][0], first[u]) for u in best}
    kept = sorted(r.pos for r in dedupe.dedupe_keep_blank(df, ["pos"]).collect())
    seen, want = set(), []
    for i, (u, _) in enumerate(data):
        if not u:
            want.append(i)
        elif u not in seen:
            seen.add(u)
            want.append(i)
    assert kept == want


seg = st.sampled_from(["a", "b", "c.html", ".", "..", ""])
hrefs = st.builds(lambda lead, segs, tail: lead + "/".join(segs) + tail,
                  st.sampled_from(["", "/", "./", "../"]), st.lists(seg, min_size=1, max_size=5),
                  st.sampled_from(["", "?q=1", "#top", "?a=b#c"]))


@settings(**SETTINGS)
@given(st.lists(hrefs, min_size=1, max_size=60), st.sampled_from(["https://www.cars.com", "https://x.org/a/b",
                                                                  "https://x.org/a/b/"]))
def test_url_join_matches_urljoin(spark, values, base):
    from urllib.parse import urljoin
    assert run(spark, values, lambda c: fn.url_join(c, base)) == [urljoin(base, v) for v in values]
