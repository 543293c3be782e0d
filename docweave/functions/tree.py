"""A small mutable HTML tree on the standard library's tokenizer, and the CSS subset that the operators need."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Opening one of these ends an open element of the named kinds, up to a boundary (page mode only).
ENDS = {
    "li": ({"li"}, {"ul", "ol"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
P_ENDERS = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


class Node:
    """An element; its children are nodes and strings."""

    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None = None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def get(self, name: str) -> str:
        return self.attrs.get(name, "")

    def walk(self) -> list[Node]:
        """Elements below this one, in document order."""
        out, stack = [], [c for c in reversed(self.children) if c.__class__ is not str]
        while stack:
            n = stack.pop()
            out.append(n)
            if n.children:
                stack += [c for c in reversed(n.children) if c.__class__ is not str]
        return out

    def flow(self) -> list[Node | str]:
        """Elements and strings below this one, in document order."""
        out, stack = [], self.children[::-1]
        while stack:
            c = stack.pop()
            out.append(c)
            if c.__class__ is not str and c.children:
                stack += c.children[::-1]
        return out

    def strings(self) -> list[str]:
        out, stack = [], self.children[::-1]
        while stack:
            c = stack.pop()
            if c.__class__ is str:
                out.append(c)
            else:
                stack += reversed(c.children)
        return out

    def text(self) -> str:
        return "".join(self.strings())

    def words(self) -> str:
        """Text with white space collapsed, a space between strings."""
        return " ".join(" ".join(self.strings()).split())

    def has_words(self, least: int) -> bool:
        """Whether words() has so many characters; reads no further than that."""
        n, stack = -1, self.children[::-1]
        while stack:
            c = stack.pop()
            if c.__class__ is not str:
                stack += c.children[::-1]
                continue
            for w in c.split():
                n += len(w) + 1
            if n >= least:
                return True
        return least <= 0

    def stripped(self) -> str:
        """Each string stripped, joined without a separator."""
        return "".join(s.strip() for s in self.strings())

    def up(self) -> Iterator[Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def elements(self) -> list[Node]:
        return [c for c in self.children if c.__class__ is not str]

    def _until(self, hit) -> Node | None:
        """The first element below this one that is hit."""
        stack = self.elements()[::-1]
        while stack:
            n = stack.pop()
            if hit(n):
                return n
            if n.children:
                stack += [c for c in reversed(n.children) if c.__class__ is not str]
        return None

    def find(self, *tags: str) -> Node | None:
        return self._until(lambda n: n.tag in tags)

    def all(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n.tag in tags]

    def select(self, selector: str, nodes: list[Node] | None = None) -> list[Node]:
        """nodes: the elements below this one, where they are known."""
        by, loose = _plans.get(selector) or _plan(selector)
        nodes = self.walk() if nodes is None else nodes
        if not loose:  # a tag is wanted
            nodes = [n for n in nodes if n.tag in by]
        return [n for n in nodes if chosen(n, selector)]

    def first(self, selector: str) -> Node | None:
        return self._until(lambda n: chosen(n, selector))

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None

    def replace(self, *new: Node | str) -> None:
        parent, out = self.parent, []
        for c in parent.children:
            out.extend(new if c is self else [c])
        for n in new:
            if isinstance(n, Node):
                n.parent = parent
        parent.children, self.parent = out, None

    def copy(self, parent: Node | None = None) -> Node:
        new = Node(self.tag, dict(self.attrs), parent)
        new.children = [c if c.__class__ is str else c.copy(new) for c in self.children]
        return new

    def html(self) -> str:
        attrs, kids = "".join([f' {k}="{_escaped(v, True)}"' for k, v in self.attrs.items()]) if self.attrs else "", self.children
        if not kids and self.tag not in VOID:
            return f"<{self.tag}{attrs}></{self.tag}>"
        if self.tag in VOID:
            return f"<{self.tag}{attrs}/>"
        raw = self.tag in ("script", "style")
        inner = "".join([(c if raw else _escaped(c)) if c.__class__ is str else c.html() for c in kids])
        return f"<{self.tag}{attrs}>{inner}</{self.tag}>"

    def path(self) -> str:
        """Element-only path, like ``html/body[0]/p[3]``."""
        node, out = self, []
        while node.parent is not None and node.parent.tag != "#":
            out.append(f"{node.tag}[{next(i for i, c in enumerate(node.parent.elements()) if c is node)}]")
            node = node.parent
        return "/".join([node.tag, *reversed(out)])


def _escaped(s: str, quote: bool = False) -> str:
    s = s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    return s.replace('"', "&quot;") if quote else s


class _Builder(HTMLParser):
    def __init__(self, page: bool):
        super().__init__(convert_charrefs=True)
        self.page, self.root = page, Node("#", {})
        self.at = self.root

    def _close(self, kinds: set[str] | frozenset[str], stop: set[str]) -> None:
        self.at = _closed(self.at, self.root, kinds, stop)

    def handle_starttag(self, tag, attrs):
        if self.page:
            if tag in P_ENDERS:
                self._close({"p"}, {"table", "td", "th", "li", "button"})
            if tag in ENDS:
                self._close(*ENDS[tag])
        new = Node(tag, {k: v if v is not None else "" for k, v in reversed(attrs)}, self.at)
        if len(attrs) > 1:
            new.attrs = dict(reversed(new.attrs.items()))
        self.at.children.append(new)
        if tag not in VOID:
            self.at = new

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag and (not self.page or tag in ("svg", "path")):
            self.at = self.at.parent

    def handle_endtag(self, tag):
        node = self.at
        while node is not self.root and node.tag != tag:
            node = node.parent
        if node is not self.root:
            self.at = node.parent

    def handle_data(self, data):
        kids = self.at.children
        if kids and isinstance(kids[-1], str):
            kids[-1] += data
        else:
            kids.append(data)


_WS = r"[ \t\r\n\f]"
_ATTRS = rf"""((?:{_WS}+[a-zA-Z_][-a-zA-Z0-9_]*(?:="[^"]*"|='[^']*'|=[^\s"'=<>`/&]+(?=[ \t\r\n\f>]))?)*)"""
#: Text, end tag, tag, script or style with what it holds, comment; what else begins with ``<`` isn't plain.
_TOKEN = re.compile(rf"([^<]+)|</([a-z][a-z0-9]*){_WS}*>|<(?!script|style)([a-z][a-z0-9]*){_ATTRS}{_WS}*(/?)>|<(script|style){_ATTRS}{_WS}*>((?s:.*?))(?i:</\s*\6\s*>)|(<!--(?s:.*?)--\s*>|(?i:<!doctype)[^>]*>)|(<)")
_ATTR = re.compile(rf"""{_WS}+([a-zA-Z_][-a-zA-Z0-9_]*)(?:="([^"]*)"|='([^']*)'|=([^\s"'=<>`/&]+))?""")
_attrs: dict[str, dict[str, str]] = {}


def _attributes(text: str) -> dict[str, str]:
    """Of the attributes as they are written; of one that is there twice the first."""
    known = _attrs.get(text)
    if known is None:
        out: dict[str, str] = {}
        for m in reversed(list(_ATTR.finditer(text))):
            out[m[1].lower()] = unescape(m[2] or m[3] or m[4] or "")
        known = dict(reversed(out.items()))
        if len(text) < 200:
            if len(_attrs) >= 2_000:
                _attrs.clear()
            _attrs[text] = known
    return dict(known)


#: What stands between ``<`` and ``>``, where it is a tag or a document type.
_TAG = re.compile(rf"</([a-z][a-z0-9]*){_WS}*>|<(?!script|style)([a-z][a-z0-9]*){_ATTRS}{_WS}*(/?)>|<(script|style){_ATTRS}{_WS}*>|(?i:<!doctype)[^>]*>")
_END, _RAW, _NOTHING = "end", "raw", "nothing"
_SELF = frozenset(("svg", "path"))
_heads: dict[str, tuple] = {}


def _head(text: str) -> tuple | None:
    """Tag, kind (of a start tag None), attributes, whether it stays open as a page's and as others' element, and what it ends; None where it is none of these."""
    m = _TAG.fullmatch(f"<{text}>")
    if m is None:
        return None
    if m[1]:
        out = (m[1], _END, None, False, False, ())
    elif m[5]:
        out = (m[5], _RAW, _attributes(m[6]) if m[6] else None, False, False, ())
    elif m[2]:
        tag = m[2]
        ends = [({"p"}, {"table", "td", "th", "li", "button"})] * (tag in P_ENDERS) + ([ENDS[tag]] if tag in ENDS else [])
        out = (tag, None, _attributes(m[3]) if m[3] else None, tag not in VOID and not (m[4] and tag in _SELF), tag not in VOID and not m[4], ends)
    else:
        out = ("", _NOTHING, None, False, False, ())
    if len(text) < 200:
        if len(_heads) >= 4_000:
            _heads.clear()
        _heads[text] = out
    return out


def _cut(html: str, page: bool, seen: list[Node | str]) -> Node | None:
    """The tree of markup that is tags, text and scripts without ``<``, cut at each ``<``; every way to write a tag is read once.  None where there is more.  seen: gets the elements and strings in document order."""
    at = root = Node("#", {})
    parts = html.split("<")
    if parts[0]:
        root.children.append(unescape(parts[0]))
        seen.append(root.children[0])
    raw, heads = None, _heads
    for part in parts[1:]:
        text, end, after = part.partition(">")
        known = heads.get(text) or _head(text)
        if not end or known is None:
            return None
        tag, kind, attrs, stays, other, ends = known
        if raw is not None:
            if kind is not _END or tag != raw:
                return None
            raw = None
        elif kind is None:
            if page:
                for kinds, stop in ends:
                    at = _closed(at, root, kinds, stop)
            new = Node(tag, dict(attrs) if attrs else {}, at)
            at.children.append(new)
            seen.append(new)
            if stays if page else other:
                at = new
        elif kind is _END:
            node = at
            while node is not root and node.tag != tag:
                node = node.parent
            if node is not root:
                at = node.parent
        elif kind is _RAW:
            new = Node(tag, dict(attrs) if attrs else {}, at)
            at.children.append(new)
            seen.append(new)
            if after:
                new.children.append(after)
                seen.append(after)
            raw = tag
            continue
        if after:
            if "&" in after:
                after = unescape(after)
            kids = at.children
            if kids and kids[-1].__class__ is str:
                kids[-1] += after
                seen[-1] = kids[-1]  # nothing came after it, or it weren't the last
            else:
                kids.append(after)
                seen.append(after)
    return None if raw else root


def _plain(html: str, page: bool, seen: list[Node | str] | None = None) -> Node | None:
    """The same tree without the tokenizer, where the markup is plain: lower-case tags, attributes in quotes or single words; else None.  seen: gets the elements and strings in document order."""
    seen = [] if seen is None else seen
    root = _cut(html, page, seen)
    if root is None:
        seen.clear()
        root = _scanned(html, page, seen)
    return root


def _scanned(html: str, page: bool, seen: list[Node | str]) -> Node | None:
    """The same in one pass of a pattern, which knows comments and scripts with ``<`` too."""
    at = root = Node("#", {})
    for m in _TOKEN.finditer(html):
        kind = m.lastindex
        if kind == 1:
            text, kids = m[1], at.children
            if "&" in text:
                text = unescape(text)
            if kids and kids[-1].__class__ is str:
                kids[-1] += text
                seen[-1] = kids[-1]
            else:
                kids.append(text)
                seen.append(text)
        elif kind == 2:
            tag, node = m[2], at
            while node is not root and node.tag != tag:
                node = node.parent
            if node is not root:
                at = node.parent
        elif kind == 5:
            tag = m[3]
            if page:
                if tag in P_ENDERS:
                    at = _closed(at, root, {"p"}, {"table", "td", "th", "li", "button"})
                if tag in ENDS:
                    at = _closed(at, root, *ENDS[tag])
            new = Node(tag, _attributes(m[4]) if m[4] else {}, at)
            at.children.append(new)
            seen.append(new)
            if tag not in VOID and not (m[5] and (not page or tag in _SELF)):
                at = new
        elif kind == 8:
            new = Node(m[6], _attributes(m[7]) if m[7] else {}, at)
            at.children.append(new)
            seen.append(new)
            if m[8]:
                new.children.append(m[8])
                seen.append(m[8])
        elif kind == 10:
            return None
    return root


def _closed(node: Node, root: Node, kinds: set[str], stop: set[str]) -> Node:
    """Where what follows belongs, with the innermost element of these kinds closed."""
    at = node
    while node is not root and node.tag not in stop:
        if node.tag in kinds:
            return node.parent
        node = node.parent
    return at


def parse(html: str, page: bool = True) -> Node:
    """page: end tags of p, li, table parts may be missing, as browsers have it; else only what is written counts."""
    return parsed(html, page)[0]


def parsed(html: str, page: bool = True) -> tuple[Node, list[Node]]:
    """The tree, and its elements in document order."""
    root, flow = flowing(html, page)
    return root, [n for n in flow if n.__class__ is Node]


def flowing(html: str, page: bool = True) -> tuple[Node, list[Node | str]]:
    """The tree, and its elements and strings in document order."""
    seen: list[Node | str] = []
    root = _plain(html, page, seen)
    if root is not None:
        return root, seen
    b = _Builder(page)
    b.feed(html)
    b.close()
    return b.root, b.root.flow()


def below(node: Node, flow: list[Node | str]) -> list[Node | str]:
    """Elements and strings below a node, of those of its tree."""
    last, after = node, 0  # the last element, and how many strings come after it
    while True:
        kids = last.children
        k = len(kids)
        while k and kids[k - 1].__class__ is str:
            k -= 1
        after += len(kids) - k
        if not k:
            break
        last = kids[k - 1]
    end = len(flow) - 1
    while flow[end] is not last:
        end -= 1
    at = next(i for i, n in enumerate(flow) if n is node)
    return flow[at + 1 : end + 1 + after]


_shells: dict[str, int] = {}


def _shell(tag: str) -> int:
    """Bytes of an element's tags without attributes."""
    n = len(tag.encode())
    _shells[tag] = out = n + 3 if tag in VOID else 2 * n + 5
    if len(_shells) > 2_000:
        _shells.clear()
    return out


def html_bytes(nodes: list[Node], strings: list[str]) -> int:
    """How long the HTML of an element is that is made of these elements and strings, as UTF-8; none of them a script or style."""
    text = "".join(strings)
    out = len(text.encode()) + 4 * text.count("&") + 3 * text.count("<") + 3 * text.count(">")
    shells = _shells
    for n in nodes:
        out += shells.get(n.tag) or _shell(n.tag)
        if n.attrs:
            for k, v in n.attrs.items():
                out += 4 + len(k.encode()) + len(_escaped(v, True).encode())
    return out


def released(nodes: list[Node | str]) -> None:
    """Trees are cycles: without the ways up they go at once, and the next page takes their place in the cache."""
    for n in nodes:
        if n.__class__ is Node:
            n.parent = None


# -- selectors: lists of compounds with descendant and child combinators

_PART = re.compile(r"(?P<tag>[a-zA-Z][\w-]*|\*)|\.(?P<cls>[\w-]+)|#(?P<id>[\w-]+)|\[(?P<attr>[\w-]+)(?:(?P<op>[*^$~]?=)[\"']?(?P<val>[^\"'\]]*)[\"']?)?\]")
_known: dict[str, list] = {}


def compiled(selector: str) -> list:
    """Each alternative: compounds from right to left, with whether the next must be the parent."""
    if selector not in _known:
        out = []
        for one in selector.split(","):
            steps, child = [], False
            for word in one.replace(">", " > ").split():
                if word == ">":
                    child = True
                    continue
                steps.append(([m.groupdict() for m in _PART.finditer(word)], child))
                child = False
            out.append(steps[::-1])
        _known[selector] = out
    return _known[selector]


#: By selector: the alternatives by the tag that they want (None where the tag is all), and those of any tag with the attribute that they want.
_plans: dict[str, tuple[dict, list]] = {}


def _plan(selector: str) -> tuple[dict, list]:
    by, loose = {}, []
    for steps in compiled(selector):
        tests = steps[0][0]
        tag = tests[0]["tag"] if tests else None
        if not tag or tag == "*":
            loose.append((None if not tests or tag else "class" if tests[0]["cls"] else "id" if tests[0]["id"] else tests[0]["attr"], steps))
        elif len(tests) == len(steps) == 1 or by.get(tag.lower(), ()) is None:
            by[tag.lower()] = None
        else:
            by.setdefault(tag.lower(), []).append(steps)
    _plans[selector] = by, loose
    return by, loose


def chosen(node: Node, selector: str) -> bool:
    by, loose = _plans.get(selector) or _plan(selector)
    if node.tag in by:
        own = by[node.tag]
        if own is None or any([matches(node, t, node) for t in own]):
            return True
    attrs = node.attrs
    for need, t in loose:
        if (need is None or need in attrs) and matches(node, t, node):
            return True
    return False


class Seen:
    """The names of some elements' tags and attributes: what a selector can't find among them without a look at each."""

    def __init__(self, nodes: list[Node]):
        self.tags, self.attrs = {n.tag for n in nodes}, {k for n in nodes if n.attrs for k in n.attrs}

    def may(self, selector: str) -> bool:
        by, loose = _plans.get(selector) or _plan(selector)
        return not self.tags.isdisjoint(by) or any([need is None or need in self.attrs for need, _ in loose])


def _fits(node: Node, tests: list[dict]) -> bool:
    attrs = node.attrs
    for t in tests:
        if t["tag"]:
            if t["tag"] != "*" and node.tag != t["tag"].lower():
                return False
        elif t["cls"]:
            own = attrs.get("class")
            if not own or t["cls"] not in own.split():
                return False
        elif t["id"]:
            if attrs.get("id") != t["id"]:
                return False
        else:
            v, want = attrs.get(t["attr"]), t["val"]
            if v is None:
                return False
            if t["op"] and not (v == want if t["op"] == "=" else want in v if t["op"] == "*=" else v.startswith(want) if t["op"] == "^=" else v.endswith(want) if t["op"] == "$=" else want in v.split()):
                return False
    return True


def matches(node: Node, steps: list, root: Node) -> bool:
    if not _fits(node, steps[0][0]):
        return False
    child, rest = steps[0][1], steps[1:]
    if not rest:
        return True
    for up in node.up():
        if matches(up, rest, root):
            return True
        if child:
            return False
    return False
