"""A small HTML tree for the extraction job (stdlib ``html.parser``).

Only what the card rules need: void elements, implied end tags, class
tokens, attribute tests, first match in document order among descendants,
and text that skips scripts, styles and comments.  Runs inside executors,
one page at a time.

Most pages are plain: lower-case tags, attributes in double quotes, no character
references.  Their tags are cut by one expression; a page with anything else in it goes
to ``html.parser`` as a whole.  Both build the same tree.  The cards of a plain page need no
tree: ``CardReader`` finds them, and the first element of each field, in one walk over the tags.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

# ---- fixed values: HTML parsing rules ---------------------------------------
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NO_TEXT = frozenset(["script", "style", "template"])
# Opening the key tag closes an open tag of these kinds (nearest first).
IMPLIED_END = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
    "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "p": ("p",),
}
# Tags that end an implied-end search (a list item does not close across a list).
SCOPE = frozenset(["ul", "ol", "table", "dl", "select", "div", "body", "html"])
BLOCKS_CLOSING_P = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre "
    "section table ul".split()
)
# Tags inside which a parser reads text by rules of its own.
OWN_TEXT = frozenset("script style title textarea iframe noembed noframes noscript xmp plaintext".split())
_PLAIN_ATTRIBUTES = r'((?: [a-z][a-z0-9-]*="[^"<>&]*")*)'
#: text | start tag, attributes | end tag | an element of plain text, attributes, text | passed over | anything else
TOKEN_RE = re.compile(
    r"([^<&]+)"
    rf"|<(?!(?:{'|'.join(sorted(OWN_TEXT))})[ >])([a-z][a-z0-9]*){_PLAIN_ATTRIBUTES}>"
    r"|</([a-z][a-z0-9]*)>"
    rf"|<(title|script|style){_PLAIN_ATTRIBUTES}>([^<&]*)</\5>"
    r"|(<!-- [A-Za-z0-9 ]*-->|<!(?:DOCTYPE|doctype) html>)"
    r"|([\s\S])")
ATTRIBUTE_RE = re.compile(r'([a-z][a-z0-9-]*)="([^"]*)"')


class Node:
    __slots__ = ("tag", "attrs", "cls", "children", "elems", "parent")

    def __init__(self, tag: str, attrs: dict, parent: "Node | None"):
        self.tag = tag
        self.attrs = attrs
        c = attrs.get("class")
        self.cls = frozenset(c.split()) if c else frozenset()
        self.children: list = []   # elements and text, in order
        self.elems: list = []      # elements only
        self.parent = parent

    # -- queries ---------------------------------------------------------------
    def iter(self):
        """Descendant elements in document order (pre-order), self excluded."""
        stack = self.elems[::-1]
        while stack:
            n = stack.pop()
            yield n
            if n.elems:
                stack.extend(n.elems[::-1])

    def select(self, rules):
        """All descendants matching any rule, in document order."""
        return [n for n in self.iter() if any(r.match(n) for r in rules)]

    def select_one(self, rules):
        for n in self.iter():
            for r in rules:
                if r.match(n):
                    return n
        return None

    def first_of(self, table: RuleTable) -> dict:
        """For each name of the table, the first descendant matching any of its
        rules (document order), found in one walk of the subtree."""
        found = dict.fromkeys(table.names)
        left = len(found)
        for n in self.iter():
            for name in table.matching(n):
                if found[name] is None:
                    found[name] = n
                    left -= 1
            if not left:
                break
        return found

    def get(self, name: str):
        return self.attrs.get(name)

    def classes(self) -> frozenset:
        return self.cls

    def strings(self):
        ahead = list(reversed(self.children))
        while ahead:
            c = ahead.pop()
            if c.__class__ is str:
                yield c
            elif c.tag not in NO_TEXT:
                ahead += reversed(c.children)

    def text(self, sep: str = "") -> str:
        """Text pieces, each stripped, empty ones skipped, joined by ``sep``."""
        ch = self.children
        if len(ch) == 1 and ch[0].__class__ is str:
            return ch[0].strip()
        return sep.join(s for s in (p.strip() for p in self.strings()) if s)

    def string(self):
        """The element's only text child, or None (like a script's body)."""
        if len(self.children) == 1 and self.children[0].__class__ is str:
            return self.children[0]
        return None


class Rule:
    """One simple selector: tag, class token, attribute test (all optional)."""

    __slots__ = ("tag", "cls", "attr", "op", "value")

    def __init__(self, tag=None, cls=None, attr=None, op=None, value=None):
        self.tag, self.cls, self.attr, self.op, self.value = tag, cls, attr, op, value

    def match(self, n: Node) -> bool:
        if self.tag is not None and n.tag != self.tag:
            return False
        if self.cls is not None and self.cls not in n.cls:
            return False
        if self.attr is not None:
            v = n.attrs.get(self.attr)
            if v is None:
                return False
            if self.op == "=" and v != self.value:
                return False
            if self.op == "*=" and self.value not in v:
                return False
        return True


class RuleTable:
    """Names and their rules, found by what a rule asks for: a class token, an
    attribute, or only a tag.  An element meets few of them."""

    def __init__(self, table: dict):
        self.names = list(table)
        self.by_cls: dict[str, list] = {}
        self.by_attr: dict[str, list] = {}
        self.by_tag: dict[str, list] = {}
        self.others: list = []
        for name, rules in table.items():
            for r in rules:
                if r.cls is not None:
                    self.by_cls.setdefault(r.cls, []).append((name, r))
                elif r.attr is not None:
                    self.by_attr.setdefault(r.attr, []).append((name, r))
                elif r.tag is not None:
                    self.by_tag.setdefault(r.tag, []).append((name, r))
                else:
                    self.others.append((name, r))

    def matching(self, n: Node) -> list:
        """The names (with repeats) that have a rule matching the element."""
        near = self.others + self.by_tag[n.tag] if n.tag in self.by_tag else self.others
        for c in n.cls:
            if c in self.by_cls:
                near = near + self.by_cls[c]
        for a in n.attrs:
            if a in self.by_attr:
                near = near + self.by_attr[a]
        return [name for name, r in near if r.match(n)]


def tag(t):
    return Rule(tag=t)


def cls(c, t=None):
    return Rule(tag=t, cls=c)


def attr(name, value=None, t=None, op="="):
    return Rule(tag=t, attr=name, op=None if value is None else op, value=value)


class _Tree:
    """The tree that start tags, end tags and texts build, in order."""

    def __init__(self):
        self.root = Node("#document", {}, None)
        self.cur = self.root

    def _close_implied(self, t: str):
        if t in IMPLIED_END:
            n = self.cur
            while n is not self.root and n.tag not in SCOPE:
                if n.tag in IMPLIED_END[t]:
                    self.cur = n.parent
                    return
                n = n.parent
        if t in BLOCKS_CLOSING_P:
            n = self.cur
            while n is not self.root and n.tag not in SCOPE:
                if n.tag == "p":
                    self.cur = n.parent
                    return
                n = n.parent

    def start(self, t: str, attrs: dict):
        if t in IMPLIED_END or t in BLOCKS_CLOSING_P:
            self._close_implied(t)
        node = Node(t, attrs, self.cur)
        self.cur.children.append(node)
        self.cur.elems.append(node)
        if t not in VOID:
            self.cur = node

    def end(self, t: str):
        n = self.cur
        while n is not self.root:
            if n.tag == t:
                self.cur = n.parent
                return
            n = n.parent
        # stray end tag: ignored

    def text(self, data: str):
        ch = self.cur.children
        if ch and ch[-1].__class__ is str:
            ch[-1] += data
        else:
            ch.append(data)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tree = _Tree()

    def handle_starttag(self, t, attrs):
        a = {}
        for k, v in attrs:
            a.setdefault(k, v if v is not None else "")
        self.tree.start(t, a)

    def handle_startendtag(self, t, attrs):
        self.handle_starttag(t, attrs)
        tree = self.tree
        if t not in VOID and tree.cur.tag == t:
            tree.cur = tree.cur.parent

    def handle_endtag(self, t):
        self.tree.end(t)

    def handle_data(self, data):
        self.tree.text(data)


def _attributes(text: str) -> dict:
    """The attributes of a plain tag; of a repeated one the first counts."""
    return dict(reversed(ATTRIBUTE_RE.findall(text))) if text else {}


def _plain_tree(html: str) -> Node | None:
    """The tree of a plain page, None for any other."""
    tree = _Tree()
    for text, start, attrs, end, own, own_attrs, own_text, _, odd in TOKEN_RE.findall(html):
        if text:
            tree.text(text)
        elif start:
            tree.start(start, _attributes(attrs))
        elif end:
            tree.end(end)
        elif own:
            tree.start(own, _attributes(own_attrs))
            if own_text:
                tree.text(own_text)
            tree.end(own)
        elif odd:
            return None
    return tree.root


def parse(html: str) -> Node:
    plain = _plain_tree(html)
    if plain is not None:
        return plain
    b = _Builder()
    b.feed(html)
    b.close()
    return b.tree.root


# ---- cards of a plain page, without a tree --------------------------------------------------
_OWN = "|".join(sorted(OWN_TEXT))
PLAIN_START_RE = re.compile(rf"(?!(?:{_OWN})(?: |\Z))([a-z][a-z0-9]*){_PLAIN_ATTRIBUTES}")
PLAIN_END_RE = re.compile(r"/([a-z][a-z0-9]*)")
PLAIN_OWN_RE = re.compile(rf"(title|script|style){_PLAIN_ATTRIBUTES}")
PASSED_RE = re.compile(r"!-- [A-Za-z0-9 ]*--|!(?:DOCTYPE|doctype) html")
HREF_RE = re.compile(r'[a-z][a-z0-9]*(?: (?!href=)[a-z][a-z0-9-]*="[^"<>&]*")* href="([^"<>&]*)"')
_START, _END, _OWN_START, _PASSED = range(4)
#: Tags and runs of tags kept by what is written in them: at most so many, of at most so many
#: characters or tags, inside at most so many open elements.
KEPT_TAGS, KEPT_CHARS, KEPT_RUN = 10_000, 200, 200
#: The character that stands for the first kind of tag (those from here on are no surrogates).
FIRST_KIND = 0xE000


class NotPlain(Exception):
    """A page that needs the tree."""


class Found:
    """A card's field: its element's tag and the pieces of its text."""

    __slots__ = ("head", "pieces")

    def __init__(self, head: str, pieces: list[str]):
        self.head = head
        self.pieces = pieces

    @property
    def href(self) -> str | None:
        link = HREF_RE.match(self.head)
        return link and link[1]

    def text(self, sep: str = "") -> str:
        p = self.pieces
        return p[0].strip() if len(p) == 1 else sep.join(s for s in (x.strip() for x in p) if s)


class _Known(dict):
    """The characters of tags as they are written; one not met yet is asked for."""

    def __init__(self, ask):
        super().__init__()
        self.ask = ask

    def __missing__(self, head: str) -> str:
        return self.ask(head)


class CardReader:
    """The cards of plain pages, by a table of rules for cards and one for their fields.

    Each kind of tag has a character, so the tags of a page are a text.  What a run of them means
    depends only on that and on the elements open around it, so it is worked out once: where a
    run ends with no card open, the next begins at a card.  The texts are then taken from their
    places."""

    def __init__(self, cards: RuleTable, wanted: RuleTable):
        self.cards, self.wanted = cards, wanted
        self.asked: dict[str, list] = {}  # attributes whose values rules look at
        for table in (cards, wanted):
            for name, rules in table.by_attr.items():
                self.asked.setdefault(name, []).extend(r for _, r in rules if r.value is not None)
        self._forget()

    def _forget(self):
        self.known = _Known(self._character)     # of tags whose values are none, or classes, or such as rules name
        self.plain: dict[tuple, str] = {}        # of any tag by what the rules may ask of it
        self.frames: dict[tuple, tuple] = {}     # a tag without its values: which of them rules look at
        self.kinds: list[tuple] = []
        self.numbers: dict[tuple, int] = {}
        self.runs: dict[tuple, tuple] = {}
        self.begins = None                       # finds the tags of cards

    def _kind(self, head: str) -> tuple:
        """What a tag is: kind, name, whether a card, names of the fields it matches, void,
        whether it ends open elements."""
        m = PLAIN_END_RE.fullmatch(head)
        if m:
            return _END, m[1], False, (), False, False
        if PASSED_RE.fullmatch(head):
            return _PASSED, "", False, (), False, False
        m = PLAIN_START_RE.fullmatch(head)
        kind = _START if m else _OWN_START
        m = m or PLAIN_OWN_RE.fullmatch(head)
        if not m:
            raise NotPlain
        t = m[1]
        n = Node(t, _attributes(m[2]), None)
        return (kind, t, bool(self.cards.matching(n)), tuple(dict.fromkeys(self.wanted.matching(n))), t in VOID,
                t in IMPLIED_END or t in BLOCKS_CLOSING_P)

    def _frame(self, names: tuple) -> tuple:
        """Which values of a tag rules look at (with the rules; None for classes), and whether
        there are others."""
        asked = [(2 * i + 1, None if a == "class" else self.asked.get(a))
                 for i, a in enumerate(n.rpartition(" ")[2][:-1] for n in names[:-1])]
        out = tuple((i, rules) for i, rules in asked if rules is None and names[i // 2].endswith("class=") or rules), len(asked)
        if sum(map(len, names)) <= KEPT_CHARS:
            self.frames[names] = out
        return out

    def _character(self, head: str) -> str:
        """The character of a tag's kind, which depends on its names, its classes and what rules say
        of the values they look at."""
        parts = head.split('"')
        names = tuple(parts[::2])
        looked, n = self.frames.get(names) or self._frame(names)
        said = [parts[i] if rules is None else tuple([r.value in parts[i] if r.op == "*=" else r.value == parts[i] for r in rules])
                for i, rules in looked]
        key = names, *said
        out = self.plain.get(key)
        if out is None:
            kind = self._kind(head)
            number = self.numbers.setdefault(kind, len(self.kinds))
            if number == len(self.kinds):
                self.kinds.append(kind)
                self.begins = None
            out = chr(FIRST_KIND + number)
            if len(head) <= KEPT_CHARS:
                self.plain[key] = out
        if len(looked) == n and len(head) <= KEPT_CHARS and all(rules is None or any(r.op == "=" and r.value == parts[i] for r in rules)
                                                                for i, rules in looked):
            self.known[head] = out
        return out

    def _begins(self, tags: str) -> list[int]:
        """The places of cards' tags."""
        if self.begins is None:
            cards = "".join(chr(FIRST_KIND + i) for i, kind in enumerate(self.kinds) if kind[2])
            self.begins = re.compile(f"[{cards}]" if cards else "(?!)")
        return [m.start() for m in self.begins.finditer(tags)]

    def read(self, html: str) -> list[dict[str, Found]] | None:
        """For each card, in document order, the first element of each field among its
        descendants.  None for a page that is not plain, or has a template, or a title, script or
        style that is a card or a field: those need the tree."""
        if "&" in html:
            return None
        if max(len(self.known), len(self.plain), len(self.frames), len(self.kinds), len(self.runs)) >= KEPT_TAGS:
            self._forget()
        tags = [x.partition(">") for x in html.split("<")]
        del tags[0]
        if not tags:
            return []
        heads, closed, texts = zip(*tags)
        if "" in closed:
            return None
        out = []
        try:
            tags = "".join(map(self.known.__getitem__, heads))
            ends = self._begins(tags)
            ends.append(len(tags))
            begin, at, around = 0, 0, ()
            if ends[0] == 0:
                at = 1
            while begin < len(tags):
                step = 1
                while True:  # a run that ends inside a card goes on, twice as far each time
                    end = ends[min(at + step, len(ends)) - 1]
                    found, after, closed = self._run(tags[begin:end], around)
                    if closed or end == len(tags):
                        break
                    step *= 2
                for card in found:
                    out.append({name: Found(heads[begin + i], [texts[begin + only]] if only is not None else
                                            ["".join([texts[begin + k] for k in p]) for p in pieces])
                                for name, i, only, pieces in card})
                begin, at, around = end, min(at + step, len(ends)), after
        except NotPlain:
            return None
        return out

    def _run(self, run: str, around: tuple) -> tuple:
        """``_walk``, once for a short run; of a card's fields the name, the place of the tag, of
        the text if it is in one place, and of its pieces."""
        out = self.runs.get((around, run))
        if out is None:
            found, after, closed = self._walk([ord(c) - FIRST_KIND for c in run], around)
            cards = [[(name, i, pieces[0][0] if len(pieces) == 1 == len(pieces[0]) else None, pieces)
                      for name, (i, pieces) in card.items()] for card in found]
            out = cards, after, closed
            if len(run) <= KEPT_RUN and len(around) <= KEPT_RUN:
                self.runs[around, run] = out
        return out

    def _walk(self, ids: list[int], around: tuple) -> tuple:
        """Of a run of tags inside open elements: for each card the places of its fields'
        tags and of their texts' pieces; the elements open after it; whether no card is."""
        kinds, out = self.kinds, []
        tags = list(around)        # open elements
        cards: list[tuple] = []    # open cards, with the number of elements open around each
        fields: list[tuple] = []   # open fields, alike
        fresh = True               # no text since the last tag
        own = None                 # an element that only holds text, to be closed by the next tag
        for i, number in enumerate(ids):
            kind, t, card, names, void, implied = kinds[number]
            if own is not None:
                if kind != _END or t != own:
                    raise NotPlain
                own = None
            elif kind <= _END:
                at = None
                if kind == _END:
                    if tags and tags[-1] == t:
                        at = len(tags) - 1
                    elif t in tags:
                        at = len(tags) - 1 - tags[::-1].index(t)
                    fresh = fresh or at is not None
                elif t == "template":
                    raise NotPlain
                elif implied and tags and tags[-1] not in SCOPE:
                    at = _implied_end(tags, t)
                if at is not None:
                    del tags[at:]
                    while fields and fields[-1][0] >= at:
                        fields.pop()
                    while cards and cards[-1][0] >= at:
                        cards.pop()
                if kind == _START:
                    fresh = True
                    if names and cards:
                        found = None
                        for _, c in cards:
                            for name in names:
                                if name not in c:
                                    found = found or (i, [])
                                    c[name] = found
                        if found and not void:
                            fields.append((len(tags), found[1]))
                    if card:
                        c = {}
                        out.append(c)
                        if not void:
                            cards.append((len(tags), c))
                    if not void:
                        tags.append(t)
            elif kind == _OWN_START:
                if card or names:
                    raise NotPlain
                own, fresh = t, True
                if t != "title":
                    continue
            for _, p in fields:  # an empty text adds nothing to its piece
                if fresh or not p:
                    p.append([i])
                else:
                    p[-1].append(i)
            fresh = own is not None
        if own is not None:
            raise NotPlain
        return out, tuple(tags), not cards


def _implied_end(tags: list[str], t: str) -> int | None:
    """Where the open elements that a start tag closes begin."""
    kinds = IMPLIED_END.get(t) or ("p",)
    for at in range(len(tags) - 1, -1, -1):
        if tags[at] in SCOPE:
            return None
        if tags[at] in kinds:
            return at
    return None
