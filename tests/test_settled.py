"""Pages settled where they are read: the same rows as variants give, without them."""

import json
import random
from datetime import datetime

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from lotwise.operators import extract as X
from lotwise.operators import htmldom as H
from lotwise.operators.sites import SITES
from lotwise.plans import sizing
from lotwise.schema import LISTING, PAGES
from lotwise.session import MAX_FOLDERS
from lotwise.sinks.writers import write_per_source
from lotwise.sources.render import render_pages
from tests import pages_fixtures as P

B_OBJECTS = [
    '{"title":"2001 Elk","price":2750.5,"mileage":"12,000 mi","dealer":{"name":"N","address":"A"},"url":"https://e.example/a?b#c"}',
    '{"name":"x","price":0,"listingPrice":"$1,200","mileageString":9000,"dealerName":"D","dealerLocation":"L","canonicalUrl":"/a/b?c"}',
    '{"header":"h","priceString":"9","dealer":"text","sellerName":"S","location":7,"detailUrl":"//other.example/x"}',
    '{"heading":"","price":1e3,"dealer":[1],"link":"../up"}', '{"price":"0","title":0,"url":""}', '{"price":12.50,"title":true}',
    '{"price":-0,"title":"a","mileage":123456789012345678901}', '{"price":null,"title":{"a":[1]},"url":"/x/./y"}',
    '{"title":"t","title":"u","price":1}', '{"title":"half \\ud83d","price":1}', '{"title":"t","price":NaN}',
    '{"title":"\\u00e9","price":"1 2","url":"HTTPS://H/p"}', '{"title":"t","url":"/a\tb"}',
]
C_OBJECTS = [
    '{"name":"n","url":"/a.html?q","offers":{"price":"12.00"},"areaServed":{"addressLocality":"W"}}',
    '{"headline":"h","@id":"https://z.example/i#x","offers":{"price":5.25},"areaServed":{"name":"","addressRegion":3}}',
    '{"name":"n","url":"/a.html","price":7,"address":"P"}', '{"name":"n","areaServed":{},"address":{"name":"Q"}}',
    '{"name":"","headline":"","price":[1]}', '{"name":"n","areaServed":["x"]}', '{"headline":0,"offers":{"price":{"a":1}}}',
    '{"name":"n","address":4,"price":1.0}', '{"url":"#top"}',
]


def pages() -> list[tuple[str, str]]:
    out = []
    for o in B_OBJECTS:
        out.append(("cargurus", P.script('window.x = {"a":[],"b":[{"k":1}],"l":[' + o + "," + B_OBJECTS[0] + "]};")))
    for o in C_OBJECTS:
        out.append(("craigslist", P.script('{"itemListElement":["ad",{"item":' + o + '},{"item":null},' + o + ',{"name":"z"}]}', P.LD)))
        out.append(("craigslist", P.script('{"itemListElement":[],"about":[' + o + "]}", f'{P.LD} id="ld_searchpage_results"')))
    out += [("cargurus", getattr(P, n)) for n in ("B_CARDS", "B_ASSIGNED", "B_ZERO", "B_HALF", "B_BROKEN")]
    out += [("craigslist", getattr(P, n)) for n in ("C_ROWS", "C_LINKED", "C_LINKED_LIST")]
    return out + [("cargurus", P.script('{"l":[{"price":1}')), ("cargurus", P.script("[1] = {}")), ("craigslist", P.script("[]", P.LD))]


def test_the_same_rows_as_variants_give(spark):
    """A page longer than PLAIN_CHARS is left to variants."""
    url, pad = "https://reno.craigslist.org/search/cto", " " * X.PLAIN_CHARS
    rows = [(s, "", i, 1, url, 200, None, h) for i, (s, h) in enumerate(pages())]
    short, long = (X.extract(spark.createDataFrame(r, PAGES)).select("crawl_id", "pos", "n_rows", "extractor", "error", *X.FIELDS)
                   .orderBy("crawl_id", "pos").collect() for r in (rows, [(*r[:7], r[7] + pad) for r in rows]))
    assert short == long and len(short) > len(rows)


def test_plain_json_needs_no_variants():
    listing = {"title": "2001 Elk", "price": 2750.5, "url": "/a?b"}
    html = P.script(json.dumps({"view": {"rows": [listing]}}))
    got = X.held("cargurus", html, None, SITES)
    assert got["how"] == "json" and got["html"] is None
    assert got["rows"] == [X._row("2001 Elk", 27505, None, None, None, "https://www.cargurus.com/a")]
    linked = P.script('{"itemListElement":[{"item":{"name":"n","url":"/b"}},{"item":{"name":"m","url":"/b"}}]}', P.LD)
    got = X.held("craigslist", linked, "https://reno.craigslist.org/s", SITES)
    assert got["how"] == "jsonld" and [r["url"] for r in got["rows"]] == ["https://reno.craigslist.org/b"]
    assert X.held("cargurus", P.script('{"l":[{"price":1e3}]}'), None, SITES)["html"]


def test_only_pages_left_to_variants_keep_their_html(spark):
    rows = [("cargurus", "", i, 1, "u", 200, None, P.script('{"l":[{"price":%s}]}' % v)) for i, v in enumerate(["1", "1e3", "2.5"])]
    got = X.extract(spark.createDataFrame(rows, PAGES)).orderBy("crawl_id").select("extractor", "price", "error").collect()
    assert [tuple(r) for r in got] == [("json", 1, None), ("json", 1000, None), ("json", 25, None)]


@pytest.mark.parametrize("html", [
    P.A_VAN, P.A_TWO, P.B_CARDS, P.C_ROWS, "<p>a<div>b</p>c", "<li>1<li>2</ul><br>x", "<a href='x'>1</a>", '<a b="1" b="2">t',
    "a &amp; b<p>x</p>", "<title>a</title><script>b</script>", "<!-- c -->d<!-- e -->f", "<div class=\"\">x</div", "",
    "<td>1<td>2<tr><option>a<option>b", "<script>if (a<b) {}</script><p>x", "<textarea><p>x</p></textarea>"])
def test_plain_pages_give_the_parsers_tree(html):
    def shown(n):
        return n.tag, n.attrs, [c if isinstance(c, str) else shown(c) for c in n.children]

    builder = H._Builder()
    builder.feed(html)
    builder.close()
    assert shown(H.parse(html)) == shown(builder.tree.root)


def test_plain_links_are_joined_as_any():
    for base in ("https://h.example", "https://h.example/d/"):
        for href in ("/a/b?c#d", "https://O.example/x", "http://o.example/x/?y", "/a//b", "//o/x", "/a/../b", "x", "/a;p?q", "https://o.example", "?q"):
            assert X.joined(base, href) == X.canonical(X.urljoin(base, href))


def test_digits_of_a_text(spark):
    texts = ["$1,234.50", "", None, "none", "9" * 19, "9" * 30, "0012", "١ 2"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    from lotwise.functions import scalars as fn
    got = [r[0] for r in df.orderBy("i").select(fn.clean_number(F.col("t"))).collect()]
    assert got == [123450, None, None, None, fn.LONG_MAX, fn.LONG_MAX, 12, 2]


@pytest.mark.parametrize("source,html", [
    ("cars.com", P.A_VAN), ("cars.com", P.A_TWO), ("cargurus", P.B_CARDS), ("craigslist", P.C_ROWS),
    ("cars.com", '<div class="vehicle-card"><p class="mileage">1<div class="vehicle-card"><h2>a <b>b</b> </i>c<br>d</h2></div>'
                 '<h2><title>e</title>f <!-- x -->g</h2></div></div><a href="/vehicledetail/1">h</a>'),
    ("craigslist", '<ul><li class="result-row"><span class="price">$1<li class="result-row"><span class="nearby"> (n)'
                   '<script>s</script>m</span></ul>'),
    ("cars.com", '<div class="vehicle-card"><template><h2>t</h2></template><h2>u</h2><style class="mileage">7</style></div>'),
    ("cars.com", '<div class="vehicle-card"><h2>a &amp; b</h2></div>'), ("cargurus", '<div data-listingid="1"><a href="/x">y')])
def test_cards_are_those_of_the_tree(source, html):
    site = SITES[source]
    assert X.page_cards(html, site, None) == X.card_rows(H.parse(html), site, None)


def test_plain_cards_need_no_tree(monkeypatch):
    def no_tree(_):
        raise AssertionError("a tree was built")

    monkeypatch.setattr(X, "parse", no_tree)
    html = '<ul><li class="result-row"><a class="hdrlnk" href="/b?c">t <b>u</b></a><span class="price">$1,2</span></li></ul>'
    assert X.held("craigslist", html, None, SITES)["rows"] == [
        X._row("tu", 12, None, None, None, "https://philadelphia.craigslist.org/b")]


def random_page(rnd) -> str:
    parts = ['<div class="vehicle-card">', '<div class="vehicle-card x">', "</div>", "</div>", "<h2>", "</h2>", "<b>", "</b>", "<p>", "</p>",
             '<a class="vehicle-card-link" href="/vehicledetail/{}">', '<a href="/vehicledetail/{}">', '<a href="/other/{}">', "</a>",
             '<span class="mileage">', '<span data-test="vehicleMileage">', "</span>", "<!-- c -->", "<br>", '<img class="dealer-name">',
             "<title>t</title>", "<script>s</script>", "<ul>", "<li>", "</ul>", '<div class="dealer-name">', "t {}", " ", "u", "$1,{}"]
    return "<html><body>" + "".join(rnd.choice(parts).format(rnd.randrange(99)) for _ in range(rnd.randrange(60))) + "</body></html>"


def test_random_pages_have_the_cards_of_the_tree():
    rnd, site = random.Random(3), SITES["cars.com"]
    pages = [random_page(rnd) for _ in range(4000)]
    read = [X._tables(site.rules)[2].read(h) for h in pages]
    assert sum(r is not None for r in read) > 3000 and sum(bool(r) for r in read) > 1000
    assert [X.page_cards(h, site, None) for h in pages] == [X.card_rows(H.parse(h), site, None) for h in pages]


def test_alike_cards_are_worked_out_once(monkeypatch):
    site, walked = SITES["cars.com"], []
    reader = H.CardReader(*X._tables(site.rules)[:2])
    walk, kind = reader._walk, reader._kind
    monkeypatch.setattr(reader, "_walk", lambda ids, around: walked.append(len(ids)) or walk(ids, around))
    monkeypatch.setattr(reader, "_kind", lambda head: walked.append(1) or kind(head))
    card = '<div class="vehicle-card"><h2><b>{0}</b> x</h2><a href="/vehicledetail/{0}">d</a><div class="mileage">{0} mi.</div></div>'
    got = reader.read("<html><body>" + "".join(card.format(i) for i in range(3000)) + "</body></html>")
    assert [c["link"].href for c in got] == [f"/vehicledetail/{i}" for i in range(3000)]
    assert [c["title"].text() for c in got] == [f"{i}x" for i in range(3000)] and len(walked) < 20


def test_pages_lines_are_dealt_out_without_their_texts(spark):
    line = (7, 3, 5, 1, 2.0, 10.0, datetime(2001, 2, 3), "elk", "Brand#1", "cars.com")
    lines = spark.createDataFrame([line], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                                          "l_extendedprice double, l_shipdate timestamp, p_name string, p_brand string, source string")
    plan = render_pages(lines)._jdf.queryExecution().optimizedPlan().toString()
    above, _, below = plan.partition("RepartitionByExpression")
    assert "utm_source" in above and below and "utm_source" not in below and "date_format" not in below
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_a_reader_keeps_few_tags():
    reader = H.CardReader(H.RuleTable({"card": [H.tag("li")]}), H.RuleTable({"link": [H.tag("a")]}))
    html = "".join(f'<li><a href="/{i}">t</a></li>' for i in range(H.KEPT_TAGS + 10)) + f'<li class="{"x" * 500}">'
    assert len(reader.read(html)) == H.KEPT_TAGS + 11 and len(reader.known) <= H.KEPT_TAGS
    assert all(len(k) <= H.KEPT_CHARS for k in reader.known)


def test_pages_say_the_same_in_python(spark):
    texts = ["", "Are You a Human?", "CAPTCHA İ", "attention reKuired", "checKing your browser", "x", None,
             "We Found Partial Matches", "partial matches", "partial matches OUTSIDE your search area", "Σ access denied"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, html string").orderBy("i")
    assert [tuple(r) for r in df.select(X.bot_check("html"), X.partial_banner("html")).collect()] == [X.says(t) for t in texts]
    rows = [("cargurus", "", i, 1, "u", 503 if i % 2 else 200, None, t) for i, t in enumerate(texts)]
    heads = X.page_heads(X.extract(spark.createDataFrame(rows, PAGES))).orderBy("crawl_id").select("bot_check", "partial")
    assert [tuple(r) for r in heads.collect()] == [X.says(t) for t in texts]


def test_tags_are_known_by_what_rules_ask_of_them(monkeypatch):
    reader, asked = H.CardReader(*X._tables(SITES["cargurus"].rules)[:2]), []
    kind = reader._kind
    monkeypatch.setattr(reader, "_kind", lambda head: asked.append(head) or kind(head))
    card = '<div data-listingid="{0}"><a id="n{0}" href="/x/{0}">t {0}</a><em itemprop="price">{0}</em><em itemprop="x{0}">n</em></div>'
    got = reader.read("".join(card.format(i) for i in range(500)))
    assert [(c["link"].href, c["link"].text(), c["price"].text()) for c in got] == [(f"/x/{i}", f"t {i}", str(i)) for i in range(500)]
    assert len(asked) < 10 and len(reader.known) < 10  # a tag for each listing is not worked out, nor kept, for each


def test_a_link_is_the_tags_own_attribute():
    reader = H.CardReader(*X._tables(SITES["cargurus"].rules)[:2])
    html = '<div data-listingid="1"><a title="x href=" rel="b" href="/c">t</a></div><div data-listingid="2"><a rel=" href=">u</a></div>'
    assert [c["link"].href if "link" in c else None for c in reader.read(html)] == ["/c", None]
    assert X.page_cards(html, SITES["cargurus"], None) == X.card_rows(H.parse(html), SITES["cargurus"], None)


def scripts_by_the_pattern(html):
    return [(X.PY_SCRIPT_START_RE.match(e)[1], e[X.PY_SCRIPT_START_RE.match(e).end():-len("</script")])
            for e in X.PY_SCRIPT_RE.findall(html) if e]


def test_near_scripts_are_those_of_the_pattern():
    rnd = random.Random(5)
    parts = ["<script>", "<SCRIPT type='a'>", '<script id="x>y">', "<scripts>", "<script\n>", "<script", "</script>", "</Script >", "</scripty>",
             "</script", "<style>", "</style>", "<!--", "-->", "<p>", '<p title="<script>">', "<p <", "</p>", ">", "<", "'", '"', " a ", "{}"]
    near = 0
    for _ in range(20_000):
        html = "".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 9)))
        got = X._near_scripts(html)
        near += got is not None and got != []
        assert got is None or got == scripts_by_the_pattern(html), html
    assert near > 500
    page = "<html><script>var a = 1;</script><script>{}</script></html>"
    assert X._near_scripts(page) == [("", "var a = 1;"), ("", "{}")]


def test_numbers_of_plain_and_other_texts():
    texts = ["$1,234", "007", "", None, "mi.", "12\u0663", "\u00a31,2", "9" * 30, "0", "1\n2\x7f"]
    assert [X.clean_number(t) for t in texts] == [1234, 7, None, None, None, 12, 12, X.fn.LONG_MAX, 0, 12]


def test_rows_are_not_sorted_by_folder(spark, scratch, monkeypatch):
    name, seen = "spark.sql.maxConcurrentOutputFileWriters", []
    before = spark.conf.get(name)
    for kind in ("parquet", "csv"):
        write = getattr(DataFrameWriter, kind)
        monkeypatch.setattr(DataFrameWriter, kind, lambda self, *a, _w=write, **k: seen.append(spark.conf.get(name)) or _w(self, *a, **k))
    rows = spark.createDataFrame([(s, f"t{i}", i, None, "d", None, f"u{i}", "x") for i, s in enumerate("abcab")], LISTING)
    table, n = sizing.staged(rows, "folders", "source")
    write_per_source(rows, f"{scratch}/csv", "csv")
    write_per_source(rows, f"{scratch}/parquet")
    assert n == 5 and sorted(table.collect()) == sorted(rows.collect())
    for fmt in ("csv", "parquet"):
        got = spark.read.option("header", True).format(fmt).load(f"{scratch}/{fmt}")
        assert sorted(map(tuple, got.select("source", "title").collect())) == [(r.source, r.title) for r in sorted(rows.collect())]
    assert [int(s) for s in seen] == [MAX_FOLDERS] * 3 and spark.conf.get(name) == before
