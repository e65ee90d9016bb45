"""Main text: hand-written pages, a site's style tree, the given pages, odd markup."""

import html
import re

from lotwise.llm import html_sst as H

SCHEMA = "page_id bigint, url string, html string, text string, n_chars int"


def text(page):
    return H.Page(page).main_text()


def test_parts_that_say_what_they_are_go():
    page = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
    <header><a href=/>Site</a></header><nav>Menu</nav><div class="cookie-notice">We use cookies</div>
    <div id="ad-12">Buy</div><main><article class=post><header><h1>Head &amp; line</h1></header>
    <p>One <b>bold</b>\n word<script>var a="</p>";</script>s.<p>Two<br>three &lt;x&gt;&nbsp;four<ul><li>a<li>b</ul>
    <form><input value=q>Search</form><div role="navigation">more</div><p hidden>secret</p><p title="a hidden gem">shown</p>
    <table><tr><td>c<td>d</table></article><section class="comments"><article class="comment">Nice!</article></section>
    </main><aside>Side</aside><footer>Foot</footer></body></html>"""
    assert text(page) == "Head & line One bold words. Two three <x> four a b shown c d"


def test_landmarks_or_all():
    assert text("<body><div>a</div><p>b") == "a b"
    assert text("<main><p>m</p></main><p>out</p>") == "m"
    assert text("<p>out</p><article>a1</article><article>a2</article>") == "a1 a2"
    assert text("") == text("<html></html>") == text("<!-- x") == text("<script>never closed <p>x") == ""


def test_odd_markup():
    assert text("<p><b>one<br><p>two</p></b>three") == "one two three"
    assert text("a < b <3 &amp c &#x41;&#66; &bogus;") == "a < b <3 & c AB &bogus;"
    assert text('<div class="x > y">in</div><!--> <p>after</p>') == "in after"
    assert text("<p title='open>text</p><p>more</p>") in ("text more",)
    assert text("<ul><li>a<ul><li>b</ul><li>c</ul>") == "a b c"
    assert text("<article>x</ARTICLE><nav>n</nav>") == "x"
    for bad in ("<" * 100_000, "<a \"" * 50_000, "<div>" * 20_000 + "x", "</b>" * 50_000, "<!--" * 50_000,
                "<b>" * 20_000 + "</i>" * 20_000, "<p class=" * 20_000, "&" * 100_000):
        text(bad)


def site_page(i):
    return (f"<body><div class=top><span>My site</span></div><div class=story><h2>Story {i}</h2><p>It is {i * 7} words.</p>"
            f"<p>And {i} more.</p></div><div class=tail>Follow us everywhere</div></body>")


def test_style_tree_takes_what_a_site_repeats(spark):
    rows = [(i, f"https://User@Site.example:80/{i}", site_page(i), "", 0) for i in range(20)]
    rows += [(100 + i, "http://few.example/", site_page(i), "", 0) for i in range(3)]
    rows += [(200 + i, "http://copies.example/", site_page(1), "", 0) for i in range(30)]
    rows += [(300, None, None, "", 0), (301, "not a url", "", "", 0), (301, "not a url", "", "", 0), (None, "http://[", "<p>x", "", 0),
             (302, "http://long/", "<p>" + "word " * 200_000, "", 0)]
    got = {r.page_id: r.text for r in H.main_texts(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i in range(20):
        assert got[i] == f"Story {i} It is {i * 7} words. And {i} more."
    assert got[100].startswith("My site") and got[200].startswith("My site Story 1")
    assert got[300] == got[301] == "" and got[None] == "x" and len(got[302]) == 999_999
    tree = H.style_tree(H.style_rows(spark.createDataFrame(rows, SCHEMA))).where("host = 'site.example'").collect()
    assert [r.importance < H.LEAST for r in sorted(tree, key=lambda r: r.importance)] == [True, True, False]


def test_branches_joined_by_host_when_not_sent(spark, monkeypatch):
    rows = [(i, "https://s.example/", site_page(i), "", 0) for i in range(20)]
    sent = H.main_texts(spark.createDataFrame(rows, SCHEMA)).collect()
    monkeypatch.setattr(H, "SENT_NODES", 0)
    assert sorted(H.main_texts(spark.createDataFrame(rows, SCHEMA)).collect()) == sorted(sent)


def test_empty_table(spark):
    assert H.main_texts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_given_pages(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = H.op4_style_tree(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        article = re.search(r"<article>(.*?)(</article>|<footer>|$)", pages[r.page_id], re.S)[1]
        plain = re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)\b[^>]*>", " ", article))
        assert r.text == " ".join(html.unescape(plain).split()) and r.n_chars == len(r.text)


def test_named_parts_are_judged_by_the_tree_and_names_are_the_fallback(spark):
    page = lambda i: (f"<body><nav><a href=/>Go {i}</a></nav><div class=site-menu>Home</div><div class=story-banner>"  # noqa: E731
                      f"<p>Text {i} of</p><p>page {i * 3}</p></div><footer>Foot</footer></body>")
    rows = [(i, "http://many.example/", page(i) + "<p>And plain text beside it", "", 0) for i in range(20)]
    rows += [(100 + i, "http://few.example/", page(i) + "<p>And plain text beside it", "", 0) for i in range(3)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.page_id: r.text for r in H.main_texts(df).collect()}
    assert all(got[i] == f"Text {i} of page {i * 3} And plain text beside it" for i in range(20))
    assert got[100] == "And plain text beside it"
    tree = H.style_tree(H.style_rows(df)).where("host = 'many.example'").orderBy("named", "importance").collect()
    assert [(r.named, r.importance < H.NAMED_LEAST) for r in tree] == [(1, True), (1, False), (2, True), (2, True)]
    assert text("<div class=print-view>All there is</div><nav>Menu</nav>") == "All there is"


def test_layouts_of_blogs():
    """Everyday names: parts with the title or most of the text stay, comments and adverts go."""
    assert text('<div class="entry-header"><h1>The Title</h1>by x</div><div class="entry-content"><p>Body') == "The Title by x Body"
    assert text('<div class="page-header"><h1>T</h1></div><p>b') == "T b"
    assert text('<div class="site-banner"><h1>T</h1></div><p>b') == "T b"
    assert text('<div class="banner-story">Story</div><p>b') == "Story b"
    assert text('<div id="market-share">Share up</div><p>b') == "Share up b"
    assert text('<div class="main-menu">The whole text of this page</div><p>b') == "The whole text of this page b"
    assert text('<article>A<div id="comments">nice</div><section class="comments-area">nice</section></article>') == "A"
    assert text('<article>A<div class="ad-unit">buy</div><div id="cookie-banner">c</div><div id="ad-12">b</div></article>') == "A"
    assert text('<main>A<div id="sidebar">side</div><div class="sidebar-inner">side</div></main>') == "A"
    assert text('<article><section id="comments-on-kant"><h2 id="comments">Comments on Kant</h2>x</section></article>') == \
        "Comments on Kant x"
    assert text('<div class="site-footer">f</div><div class="cookie-notice">c</div><div id="ad-12">b</div><p>text and more') == \
        "text and more"


def test_menus_of_links_go_though_each_page_has_its_own(spark):
    """Outside landmarks a part that is all links has no importance, whatever its words."""
    page = lambda i: (f"<body><div class=top><a href=/{i}>Go {i}</a> <a href=/>there {i * 3}</a></div><div class=story><h2>Story {i}"  # noqa: E731
                      f"</h2><p>It is {i * 7} words <a href=x>and a link {i}</a>.</p></div></body>")
    rows = [(i, "http://s.example/", page(i), "", 0) for i in range(12)]
    rows += [(100 + i, "http://t.example/", f"<article><p>Text {i}</p><ul class=refs><li><a href=/>Ref {i}</a></ul></article>", "", 0) for i in range(12)]
    got = {r.page_id: r.text for r in H.main_texts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i] == f"Story {i} It is {i * 7} words and a link {i}." for i in range(12))
    assert all(got[100 + i] == f"Text {i} Ref {i}" for i in range(12))


def test_a_template_longer_than_the_text_goes(spark):
    long = "The same words at the end of every page. " * 30
    rows = [(i, "http://s.example/", f"<body><div class=story><p>Short {i}</p></div><div class=tail>{long}</div></body>", "", 0) for i in range(9)]
    rows += [(50, "http://s.example/", f"<body><div class=tail>{long}</div></body>", "", 0)]
    got = {r.page_id: r.text for r in H.main_texts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i] == f"Short {i}" for i in range(9)) and got[50] == long.strip()


def test_importance_equals_the_plain_one(spark):
    """Both entropies of every node, from the pages one by one."""
    import math
    from collections import Counter, defaultdict

    pages = [site_page(i % 17) if i % 3 else f"<body><div class=story><p>Other {i}</p><ul class=x><li><a href=/>l {i % 4}</a> t</ul></div>"
             f"<nav><a href=/>n</a></nav></body>" for i in range(40)]
    shown, blocks, letters, seen = defaultdict(set), defaultdict(set), defaultdict(set), defaultdict(set)
    for html_ in pages:
        p = H.Page(html_)
        number = tuple(b[0] for b in p.blocks if all(s == H.HINT for _, s in b[3]))
        for b in p.blocks:
            for node in (*b[2], *(n for n, _ in b[3])):
                blocks[node].add((number, b[0]))
                letters[node].add((number, b[0], b[4] if node in p.outer else 0))
                seen[node].add(number)
        for node, sequences in p.shown.items():
            shown[node] |= {(number, q) for q in sequences}
            seen[node].add(number)
    want = {}
    for node, numbers in seen.items():
        m = math.log(max(2, len(numbers)))
        entropy = lambda counts: -sum(k / sum(counts) * math.log(k / sum(counts)) for k in counts)
        k_of = Counter(b for _, b in blocks[node]).values()
        content = 1 - (sum(k * math.log(k) for k in k_of) / sum(k_of) if k_of else math.log(len(numbers))) / m
        looks = Counter(q for _, q in shown[node])
        look = min(1, entropy(looks.values()) / m) if looks else 0
        kids = sum(k * (q.count(",") + bool(q)) for q, k in looks.items()) / sum(looks.values()) if looks else 0
        total = sum(len(b) for _, b, _ in letters[node])
        plain = 1 - (sum(x for *_, x in letters[node]) / total if total else 0)
        want[node] = plain * ((1 - H.GAMMA ** kids) * look + H.GAMMA ** kids * content)
    df = spark.createDataFrame([(i, "http://s.example/", h, "", 0) for i, h in enumerate(pages)], SCHEMA)
    got = {r.node: r.importance for r in H.style_tree(H.style_rows(df)).collect()}
    assert set(got) == set(want) and all(abs(got[n] - want[n]) < 1e-9 for n in got)


def test_article_text_is_not_lost_by_a_word(spark):
    assert text('<article><section id="search-algorithms"><h2 id="related-work" class="menu">Related work</h2><p>Text</section>'
                '<table class="menu"><tr><td>Soup</table><div class="share-price">Up 3</div><div class="ad">Buy</div>'
                '<div class="widget skip login">Kept</div></article>') == "Related work Text Soup Up 3 Kept"
    rows = [(i, "http://s.example/", f"<article><p>Story {i}</p><div class=newsletter>Join us</div><div class=pager>Part {i}"
             f"</div></article>", "", 0) for i in range(20)]
    got = {r.page_id: r.text for r in H.main_texts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i] == f"Story {i} Part {i}" for i in range(20))


def test_article_over_main_only_with_most_of_the_text():
    card = '<article class="product-card">Buy this</article>'
    assert text(f"<body><p>Out</p><main><div>The text of this page is here.</div>{card}</main>") == \
        "The text of this page is here. Buy this"
    assert text(f"<body><div>The text of this page is here.</div>{card}") == "The text of this page is here. Buy this"
    links = "<div><a href=/>A link among many</a> <a href=/>another link of them</a></div>"
    assert text(f"<body>{links}<article>The story.</article>") == "The story."
