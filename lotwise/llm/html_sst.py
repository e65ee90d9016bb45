"""Main text of web pages by a site style tree.

The pages of a host share a template.  Their DOMs are merged into one style tree:
elements with the same path of tags, classes and ids are one node.  Each node
gets an importance from two entropies over the host's distinct pages:

* presentation: of the sequences of child tags that the node shows, to base m
  (the number of pages that hold it), so a node that always looks the same has 0;
* content: one minus the mean of log_m(k) over its text blocks, k being the number
  of pages that show the block under the node, so a menu that is the same on all
  pages has 0 and running text has 1.

Both are joined as ``(1 - g^l) * presentation + g^l * content`` for l child tags
on average.  Outside landmarks this is multiplied by the share of the node's letters that
stand outside links: a menu filled anew on each page differs in every block, but all of it is
links.  Branches under ``LEAST`` are taken out of each page.  An importance of few pages
is uncertain, so ``1 / pages`` is added to it where a branch is to go, and
``CAUTION / pages`` taken off where one with a hint is to stay; there is no least number of pages.

Parts that say what they are, by tag, role, class or id, are nodes of the tree as
well, and go under ``NAMED_LEAST``.  Of parts that the tree cannot tell (adverts filled
anew on each page, a host of few pages) the name decides: a sure name (tag, role, whole class
or id) always takes its part out; a hint (a class or id that ends in such a word, or
begins with one of adverts, consent or comments) unless the tree is sure of the part, and never a
part that holds an h1 or most of the page's letters outside links.  In a landmark
only adverts, consent, comments and sidebars are sure, by class or id, and only with words for
parts of a layout after them; headings are never named.  What no reader sees
(``GONE_TAGS``, hidden) is no node.

Of what is left the text blocks in ``article`` elements are returned if they hold
at least half of the letters outside links (of ``main``, if it has text of its
own, else of the page), else those in ``main``, else all.  The style tree never takes the landmarks, headings and
paragraphs themselves, nor all that is left of a page.  White space inside a block becomes one
blank, character references are decoded, blocks are joined by one blank.

Scale: statistics are rows (host, node, block) of 64-bit hashes, counted where
they are read and merged by key, so a host with a third of all pages only adds to
sums.  Pages are read twice and never shuffled as long as the table of branches to
remove is small enough to send (``SENT_NODES``); beyond, they are joined by host.

Defined results: a null html is empty and gives an empty text; a null url, or one
without a host, belongs to a host of its own (the empty one); rows may repeat; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import html as htmllib
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.llm.common import map_slices, stored, table, text_of

GAMMA = 0.9
LEAST = 0.3
NAMED_LEAST = 0.5
#: Pages' worth of doubt about a part with a hint that looks important.
CAUTION = 4
SENT_NODES = 100_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "section select summary table tbody td tfoot th thead tr ul".split())
#: Elements that end an open p, and those that end an element of their own kind.
ENDS_P = BLOCKS - frozenset("br td th tr tbody thead tfoot caption option optgroup legend summary head html body".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
            "th": ("td", "th"), "option": ("option",), "optgroup": ("optgroup", "option"),
            "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th"),
            "body": ("head",)}
SIBLING_SCOPE = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",),
                 "th": ("table",), "option": ("select",), "optgroup": ("select",), "tbody": ("table",),
                 "tfoot": ("table",), "body": ("html",)}

GONE_TAGS = RAW | frozenset("head button select input object svg canvas audio video datalist label".split())
NAMED_TAGS = frozenset("nav footer aside form menu dialog".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
DROP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbox sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice notification popup modal overlay sidebar sidebars aside menu menus nav navbar navigation "
    "breadcrumb breadcrumbs footer masthead comment comments commentlist disqus respond reply replies share sharing "
    "social related recommended recommendations newsletter subscribe subscription signup login search pagination pager "
    "widget widgets toolbar skip print paywall outbrain taboola".split())
OUTER_DROP_WORDS = frozenset("header topbar".split())
#: Words that say so as the last word of a class or id ("site-footer"), and as the first.
LAST_WORDS = frozenset(
    "ad ads advert adverts advertisement banner cookies consent notice popup modal overlay sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs footer masthead comments commentlist disqus newsletter subscribe signup pagination pager toolbar "
    "paywall recommendations promo sponsored topbar".split())
FIRST_WORDS = frozenset("ad ads advert advertisement cookie cookies consent gdpr comment comments sponsored newsletter".split())
#: Inside a landmark: words of adverts, consent, comments and sidebars, alone or
#: followed only by words for parts of a layout.
INNER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsbox adsbygoogle sponsored cookie cookies consent gdpr comment comments "
    "commentlist disqus outbrain taboola sidebar".split())
LAYOUT_WORDS = frozenset(
    "area bar banner block box container content form holder inner list notice outer panel popup section slot space thread "
    "unit widget wrap wrapper".split())
#: Whole classes that hint at a part inside a landmark.
INNER_CLASSES = frozenset(
    "share-buttons social-share sharing newsletter newsletter-signup related-posts related-articles recommendations breadcrumb "
    "breadcrumbs navbar navigation pagination pager paywall".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
KEPT_TAGS = frozenset("html body main article".split())
COMMENT_WORDS = frozenset("comment comments reply replies teaser related".split())
#: Without a class or id these are never branches of their own.
PLAIN_TAGS = frozenset("html body main article p h1 h2 h3 h4 h5 h6 b i em strong span a br li dd dt blockquote pre td th tr "
                       "tbody thead tfoot code sub sup u small hr img".split())

_TAG = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
_ATTR = re.compile(r"([^\s=>/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_ATTR_NAMES = frozenset(("class", "id", "role", "hidden", "aria-hidden"))
_PART = re.compile(r"[^a-z]+")
_DIGITS = re.compile(r"[0-9]+")
_BRANCH_TAGS = BLOCKS - {"br", "hr"}
#: The host part of a lower-case URL.
HOST_RE = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^:/?#]*)"


#: How surely a name says that a part is no main text.
HINT, SURE = 1, 2


def _hash(*parts) -> int:
    return int.from_bytes(blake2b("\x00".join(map(str, parts)).encode("utf-8", "surrogatepass"), digest_size=8).digest(),
                          "little", signed=True)


def _attributes(text: str) -> dict[str, str]:
    out = {}
    for name, double, single, bare in _ATTR.findall(text):
        if (name := name.lower()) in _ATTR_NAMES:
            out.setdefault(name, double or single or bare)
    return out


@lru_cache(maxsize=64)
def _end_of(tag: str) -> re.Pattern:
    return re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I)


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("open", tag, attributes) and ("close", tag, "") in
    page order.  Each place is looked at a bounded number of times."""
    at, n, quoted = 0, len(page), True
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:], ""
            return
        if lt > at:
            yield "text", page[at:lt], ""
        after = page[lt + 1:lt + 2]
        if after in ("!", "?"):
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 2)  # <!--> is a whole comment
                at = n if end < 0 else end + 3
            else:
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            continue
        closing = after == "/"
        m = _TAG.match(page, lt + 1 + closing)
        if not m:
            yield "text", "<", ""
            at = lt + 1
            continue
        end, i = -1, m.end()
        while quoted:
            stop = _STOP.search(page, i)
            if not stop:
                quoted = False  # an open quote somewhere: take the next > from here on
            elif stop[0] == ">":
                end = stop.start()
                break
            else:
                close = page.find(stop[0], stop.end())
                if close < 0:
                    quoted = False
                i = close + 1
        if end < 0:
            end = page.find(">", m.end())
        if end < 0:
            return
        tag, at = m[0].lower(), end + 1
        if closing:
            yield "close", tag, ""
            continue
        yield "open", tag, page[m.end():end]
        if tag in RAW:
            m = _end_of(tag).search(page, at)
            at = m.start() if m else n


class _Open:
    __slots__ = ("tag", "path", "dropped", "inside", "branches", "named", "children")

    def __init__(self, tag, path, dropped, inside, branches, named):
        self.tag, self.path, self.dropped, self.inside, self.branches = tag, path, dropped, inside, branches
        self.named = named
        self.children: list[str] | None = None


def _gone(tag: str, attrs: dict[str, str]) -> bool:
    return tag in GONE_TAGS or (bool(attrs) and tag not in ("html", "body") and (
        "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true"))


def _name(tag: str, attrs: dict[str, str], inside: bool) -> int:
    """2: the element surely says that it is no main text, 1: a hint, 0: neither."""
    if tag in NAMED_TAGS or (tag == "header" and not inside):
        return SURE
    if not attrs:
        return 0
    if attrs.get("role", "").lower() in DROP_ROLES:
        return SURE if tag not in ("html", "body") else 0
    classes = attrs.get("class", "").lower().split()
    if tag in KEPT_TAGS:
        return SURE if tag == "article" and not COMMENT_WORDS.isdisjoint(classes) else 0
    if tag in HEADINGS:
        return 0
    ids = attrs.get("id", "").lower().split()
    if inside:
        if any(_layout_of(c) for c in (*classes, *ids)):
            return SURE
        return HINT if not INNER_CLASSES.isdisjoint(classes) else 0
    if tag == "section":  # its id may be made from a heading
        ids = [i for i in ids if _layout_of(i)]
    if any(c in DROP_WORDS or c in OUTER_DROP_WORDS for c in (*classes, *ids)):
        return SURE
    return HINT if any(w and (w[-1] in LAST_WORDS or w[0] in FIRST_WORDS) for w in map(_parts, (*classes, *ids))) else 0


@lru_cache(maxsize=4096)
def _parts(name: str) -> tuple[str, ...]:
    return tuple(w for w in _PART.split(name) if w)


def _layout_of(name: str) -> bool:
    """Whether a class or id is one of ``INNER_WORDS``, numbers and layout words after it."""
    words = _parts(name)
    return bool(words) and words[0] in INNER_WORDS and all(w in LAYOUT_WORDS or w in INNER_WORDS for w in words[1:])


class Page:
    """The text blocks of a page and the branches they stand in.

    ``blocks``: (text, landmark, branches, named, linked), landmark 2 in an
    article, 1 in main, 0 elsewhere, branches the style nodes around it that may
    be removed, named those with a name, as (node, how sure), linked the letters
    in links.
    ``shown``: style node -> its child tag sequences on this page.
    ``titled``: the nodes that hold an h1; ``outer``: those outside landmarks."""

    def __init__(self, page: str):
        self.blocks: list[tuple[str, int, tuple[int, ...], tuple[tuple[int, int], ...], int]] = []
        self.shown: dict[int, list[str]] = {}
        self.titled: set[int] = set()
        self.outer: set[int] = set()
        root = _Open("", 0, False, 0, (), ())
        stack, count, piece, linked = [root], {}, [], 0

        def flush() -> None:
            nonlocal linked
            if piece:
                text, links = "".join(piece), linked
                piece.clear()
                linked = 0
                if "&" in text:
                    text = htmllib.unescape(text)
                if text := " ".join(text.split()):
                    top = stack[-1]
                    self.blocks.append((text, top.inside, top.branches, top.named, min(links, len(text))))

        def pop_to(depth: int) -> None:
            while len(stack) > depth:
                e = stack.pop()
                count[e.tag] -= 1
                if e.children is not None:
                    self.shown.setdefault(e.path, []).append(",".join(e.children))

        def close(tag: str, scope) -> None:
            """End the innermost open ``tag`` unless a tag of ``scope`` is nearer."""
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    pop_to(depth)
                    return
                if stack[depth].tag in scope:
                    return

        for kind, tag, rest in tokens(page):
            if kind == "text":
                if not stack[-1].dropped:
                    piece.append(tag)
                    if count.get("a"):
                        linked += len(tag)
                continue
            if tag in BLOCKS:
                flush()
            if kind == "close":
                if count.get(tag):
                    close(tag, KEPT_TAGS if tag == "p" else () if tag in BLOCKS else _BRANCH_TAGS - {"p"})
                continue
            if tag in ENDS_P and count.get("p"):
                close("p", ("table", "button", "article", "main", "body"))
            for sibling in SIBLINGS.get(tag, ()):
                if count.get(sibling):
                    close(sibling, SIBLING_SCOPE[tag])
            top = stack[-1]
            attrs = _attributes(rest) if rest.strip(" /") else {}
            inside = 2 if tag == "article" else max(top.inside, 1 if tag == "main" or attrs.get("role") == "main" else 0)
            dropped, name = top.dropped or _gone(tag, attrs), 0
            if not dropped and (name := _name(tag, attrs, top.inside > 0)) and tag not in BLOCKS:
                dropped, name = True, 0  # inside a block: never a branch, so the name decides
            if not dropped and top.children is not None and (not top.children or top.children[-1] != tag):
                top.children.append(tag)
            if tag == "h1":
                self.titled.update(e.path for e in stack)
            if tag in VOID:
                continue
            label = f"{tag}.{' '.join(sorted(attrs.get('class', '').split()))}#{_DIGITS.sub('0', attrs.get('id', ''))}" \
                if attrs else tag
            path = top.path if dropped else _hash(top.path, label)
            branches, named = top.branches, top.named
            surely = bool(named) and named[-1][1] == SURE
            if name and not surely:
                named = (*named, (path, name))
            elif not dropped and not surely and tag in _BRANCH_TAGS and tag not in KEPT_TAGS and (
                    "class" in attrs or "id" in attrs
                    or (tag not in PLAIN_TAGS and (top.inside == 0 or tag in ("div", "section")))):
                branches = (*branches, path)
            e = _Open(tag, path, dropped, inside, branches, named)
            if branches is not top.branches or named is not top.named:
                e.children = []
                if not inside:
                    self.outer.add(path)
            stack.append(e)
            count[tag] = count.get(tag, 0) + 1
        flush()
        pop_to(1)

    def main_text(self, removed: frozenset[int] = frozenset(), kept: frozenset[int] = frozenset()) -> str:
        """``removed``: branches of low importance.  ``kept``: branches with a
        hint that enough pages hold and that are not of low importance."""
        # The tree decides first; a sure name takes its part out in any case.
        standing = [b for b in self.blocks if all(sure == HINT for _, sure in b[3])]
        whole = sum(len(b[0]) - b[4] for b in standing)
        letters: dict[int, int] = {}
        for b in standing:
            for node, _ in b[3]:
                letters[node] = letters.get(node, 0) + len(b[0]) - b[4]
        held = {n for n, k in letters.items() if n not in removed and (n in kept or n in self.titled or 2 * k > whole)}
        blocks = [b for b in standing if all(node in held for node, _ in b[3])] or standing
        if removed:
            blocks = [b for b in blocks if removed.isdisjoint(b[2])] or blocks
        if any(b[1] == 1 for b in blocks):
            blocks = [b for b in blocks if b[1]]
        article = [b for b in blocks if b[1] == 2]
        if article and 2 * sum(len(b[0]) - b[4] for b in article) >= sum(len(b[0]) - b[4] for b in blocks):
            blocks = article
        return " ".join(b[0] for b in blocks)


def host_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(url.cast("string")), HOST_RE, 1), F.lit(""))


def style_rows(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, node, page (hash of its blocks without a sure name), block hash (null: a
    child tag sequence) and sequence hash (null: a block), with its child count,
    how sure the node's name is (0: it has none), the block's letters, and those of them in
    links (counted outside landmarks only)."""
    def per_slice(hosts, htmls):
        out = tuple([] for _ in range(9))
        for host, text in zip(hosts, htmls):
            page = Page(text)
            number = _hash(*(b[0] for b in page.blocks if all(sure == HINT for _, sure in b[3])))
            names = dict(pair for b in page.blocks for pair in b[3])
            rows = {(node, _hash(b[0]), None, 0, len(b[0]), b[4] if node in page.outer else 0)
                    for b in page.blocks for node in (*b[2], *(n for n, _ in b[3]))}
            rows |= {(node, None, _hash(s), s.count(",") + bool(s), 0, 0) for node, seen in page.shown.items() for s in seen}
            for node, block, sequence, children, letters, links in rows:
                for column, v in zip(out, (host, node, number, block, sequence, children, names.get(node, 0), letters, links)):
                    column.append(v)
        return out

    return map_slices(pages.select(host_of(F.col(url_col)).alias("host"), text_of(F.col(html_col)).alias("html")), per_slice,
                      "host string, node bigint, page bigint, block bigint, sequence bigint, children int, named int, "
                      "letters bigint, links bigint")


def style_tree(rows: DataFrame) -> DataFrame:
    """host, node, pages (distinct pages holding it), named, importance."""
    # A page that is an exact copy of another counts once.
    seen = stored(rows.distinct(), "style-rows")
    m = F.greatest(F.col("pages"), F.lit(2)).cast("double")
    pages = (seen.groupBy("host", "node", "page").agg(
                F.max("named").alias("named"), F.sum("letters").alias("letters"), F.sum("links").alias("links"))
             .groupBy("host", "node").agg(F.count(F.lit(1)).alias("pages"), F.max("named").alias("named"),
                                          F.sum("letters").alias("letters"), F.sum("links").alias("links")))
    blocks = (
        seen.where("block is not null").groupBy("host", "node", "block").agg(F.count(F.lit(1)).alias("k"))
        .groupBy("host", "node").agg(F.sum("k").alias("shows"), F.sum(F.col("k") * F.log("k")).alias("spread"))
    )
    per_sequence = (seen.where("sequence is not null").groupBy("host", "node", "sequence")
                    .agg(F.count(F.lit(1)).alias("k"), F.max("children").alias("children")))
    looks = per_sequence.groupBy("host", "node").agg(
        F.sum("k").alias("looked"), F.sum(F.col("k") * F.log("k")).alias("alike"),
        F.sum(F.col("k") * F.col("children")).alias("kids"))
    joined = pages.join(blocks, ["host", "node"], "left").join(looks, ["host", "node"], "left")
    content = 1 - F.coalesce(F.col("spread") / F.col("shows"), F.log("pages")) / F.log(m)
    presentation = F.coalesce((F.log("looked") - F.col("alike") / F.col("looked")) / F.log(m), F.lit(0.0))
    weight = F.pow(F.lit(GAMMA), F.coalesce(F.col("kids") / F.col("looked"), F.lit(0.0)))
    outside_links = 1 - F.when(F.col("letters") > 0, F.col("links") / F.col("letters")).otherwise(F.lit(0.0))
    return joined.select("host", "node", "pages", "named", (outside_links * (
        (1 - weight) * F.least(presentation, F.lit(1.0)) + weight * content)).alias("importance"))


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
               least: float = LEAST, named_least: float = NAMED_LEAST, caution: float = CAUTION) -> DataFrame:
    """One row per page: id, url, text."""
    tree = style_tree(style_rows(pages, url_col, html_col))
    low = F.col("importance") + 1 / F.col("pages") < F.when(F.col("named") > 0, named_least).otherwise(least)
    sure = (F.col("named") == HINT) & (F.col("importance") - caution / F.col("pages") >= named_least)
    judged = stored(tree.select("host", "node", low.alias("low"), sure.alias("sure")).where("low or sure"), "style-nodes")
    of_host = judged.groupBy(F.col("host").alias("_host")).agg(
        F.collect_set(F.when(F.col("low"), F.col("node"))).alias("_removed"),
        F.collect_set(F.when(F.col("sure"), F.col("node"))).alias("_kept"))
    rows = pages.select(F.col(id_col), F.col(url_col), text_of(F.col(html_col)).alias("html"))
    nodes = judged.count()
    if nodes:
        small = nodes <= SENT_NODES
        rows = rows.join(F.broadcast(of_host) if small else of_host, host_of(F.col(url_col)) == F.col("_host"), "left")
        rows = rows.drop("_host")
    else:
        none = F.lit(None).cast("array<bigint>")
        rows = rows.withColumn("_removed", none).withColumn("_kept", none)

    def per_slice(ids, urls, htmls, removed, kept):
        return ids, urls, [Page(h).main_text(frozenset(r or ()), frozenset(k or ())) for h, r, k in zip(htmls, removed, kept)]

    types = {f.name: f.dataType.simpleString() for f in pages.schema}
    return map_slices(rows, per_slice, f"`{id_col}` {types[id_col]}, `{url_col}` {types[url_col]}, text string", text_at=2)


def op4_style_tree(spark, sf_dir):
    return main_texts(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("bigint"))
