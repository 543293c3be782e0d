"""What a page holds: its body, compacted, with its formulas, assets, counts and signals of risk."""

from __future__ import annotations

import hashlib
import re

from .tree import Node, Seen, below, chosen, flowing, html_bytes

BODIES = ("[data-slate-editor]", "article", "main", "[role=main]", "#js_content", ".rich_media_content")
LEAST = 80
HEADS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
DROPPED = ("script", "style", "noscript", "template")
RAW = frozenset(("script", "style"))
LAZY = ("data-src", "data-original", "data-lazy", "srcset")
LATEX = ("data-tex", "data-latex", "data-math", "data-formula", "alttext")
FORMULA = "[data-slate-type*=katex], .katex, math, [data-formula]"
CAPTIONS = "figure > figcaption, table > caption"
ASSETS = frozenset(("img", "iframe", "video"))
OUTER = "[data-slate-type*=katex], .katex, math"
NOTEBOOK = ("jp-cell", "command-input", "cell-output", "data-mode-id", "jupyter", "databricks", "colab")
EDITOR = ("monaco-editor", "codemirror", "cm-editor", "react-virtualized", "view-lines")
#: kind -> wrapper, native test
SEMANTIC = {
    "table": ("[data-slate-type=table]", lambda n: n.tag == "table"),
    "codeblock": ("[data-slate-type=pre]", lambda n: n.tag == "code" and n.parent is not None and n.parent.tag == "pre"),
    "list": ("[data-slate-type=list]", lambda n: n.tag in ("ul", "ol")),
    "list_item": ("[data-slate-type=list-line]", lambda n: n.tag == "li"),
}
#: The tags of the native elements.
NATIVE = {"table": {"table"}, "codeblock": {"code"}, "list": {"ul", "ol"}, "list_item": {"li"}}


class Blocked(ValueError):
    """The page can't be read without guessing."""


def protected(html: str) -> str:
    """Runs of blanks that are code indentation, as no-break spaces."""
    if "code-line" not in html:
        return html
    line = re.compile(r"""<([a-zA-Z]+)\b[^>]*\bdata-slate-type=(["']?)code-line\2[^>]*>.*?</\1>""", re.DOTALL)
    blank = re.compile(r"""(data-slate-string=(["']?)true\2>)( {2,})(?=</span>)""")
    return line.sub(lambda m: blank.sub(lambda b: b[1] + "\u00a0" * len(b[3]), m[0]), html)


def body_of(root: Node, nodes: list[Node] | None = None, seen: Seen | None = None) -> tuple[Node, str]:
    nodes = root.walk() if nodes is None else nodes
    seen = Seen(nodes) if seen is None else seen
    for selector in BODIES:
        if not seen.may(selector):
            continue
        found = [n for n in root.select(selector, nodes) if n.has_words(LEAST)]
        if len(found) > 1:
            raise Blocked(f"ambiguous body selector '{selector}': {len(found)} substantial matches")
        if found:
            return found[0], selector
    raise Blocked("no unique semantic body found; strict inspection is required")


def _in_formula(node: Node) -> bool:
    return any(_is(n, OUTER) for n in (node, *node.up()))


def _is(node: Node, selector: str) -> bool:
    return chosen(node, selector)


def title_of(root: Node, nodes: list[Node] | None = None) -> str:
    """Of the first heading that counts as the document's; empty without one."""
    n = next((n for n in (root.walk() if nodes is None else nodes) if chosen(n, "h1, [data-slate-type=heading-one]")), None)
    return n.words() if n is not None else ""


def stray_scripts(root: Node, nodes: list[Node] | None = None) -> int:
    return sum(s.tag == "script" and s.get("type").lower().startswith("math/tex") and not _in_formula(s) for s in (root.walk() if nodes is None else nodes))


def compacted(body: Node, flow: list[Node | str] | None = None) -> tuple[Node, list[Node | str]]:
    """The body taken out of its page, without what is dropped, and the elements and strings below it.  flow: those of the page, where they are known."""
    flow = body.flow() if flow is None else below(body, flow)
    body.parent = None
    nodes = [n for n in flow if n.__class__ is Node]
    if out := [n for n in nodes if n.tag in DROPPED]:
        for n in out:
            if n.parent is not None and not _in_formula(n):
                n.remove()
        flow = body.flow()
        nodes = [n for n in flow if n.__class__ is Node]
    for n in (body, *nodes):
        if n.attrs and any([k[:2] in ("on", "On", "oN", "ON") for k in n.attrs]):
            n.attrs = {k: v for k, v in n.attrs.items() if not k.lower().startswith("on")}
    return body, flow


# -- formulas


def canonical(node: Node) -> str:
    """The same for all ways to write the same element: order of attributes, classes and declarations, and white space, don't count."""

    def attr(k: str, v: str) -> str:
        if k == "class":
            v = " ".join(sorted(v.split()))
        elif k == "style":
            v = ";".join(f"{a}:{b}" for a, b in sorted((x.partition(":")[0].strip().lower(), " ".join(x.partition(":")[2].split())) for x in v.split(";") if x.strip() and ":" in x))
        return f"{k.lower()}={v}"

    inner = "".join(canonical(c) if isinstance(c, Node) else " ".join(c.split()) for c in node.children)
    return f"<{node.tag}|{','.join(attr(k, node.attrs[k]) for k in sorted(node.attrs) if not k.lower().startswith('on'))}>{inner}</{node.tag}>"


def _own(node: Node) -> str:
    return next((v for a in LATEX if (v := node.get(a).strip())), "")


def formula_nodes(root: Node, nodes: list[Node] | None = None) -> list[Node]:
    out = []
    for n in root.select(FORMULA, nodes):
        above = []
        for up in n.up():
            if up is root:
                break
            above.append(up)
        if not any(_is(up, OUTER) or (_own(n) and _own(up) == _own(n)) for up in above):
            out.append(n)
    return out


def _source(n: Node) -> tuple[str, str]:
    note = n.first("annotation[encoding=application/x-tex]")
    if note is not None and note.stripped():
        return "annotation", note.stripped()
    for a in LATEX:
        if v := n.get(a).strip():
            return a, v
    script = n.first("script[type^=math/tex]")
    if script is not None and script.stripped():
        return "math-tex-script", script.stripped()
    if n.tag == "math" or n.find("math"):
        return "mathml", ""
    return ("katex-html-only" if "katex" in n.classes or "katex" in n.get("data-slate-type") else "unknown"), ""


def _display(n: Node) -> str:
    wide = any("katex-display" in x.classes or "block-katex" in x.get("data-slate-type") for x in (n, *n.up()))
    return "block" if wide or ("data-formula" in n.attrs and "display:block" in n.get("style").replace(" ", "")) else "inline"


_formulas: dict[str, tuple[str, str, str]] = {}


def _formula(n: Node) -> tuple[str, str, str, str | None]:
    """Kind, LaTeX, hash and, where it must be read, HTML of a formula; of the same markup once."""
    html = n.html()
    known = _formulas.get(html)
    if known is None:
        known = (*_source(n), hashlib.sha256(canonical(n).encode()).hexdigest())
        # Dropped from other formulas, scripts can leave strings side by side, which HTML doesn't show.
        if _is(n, OUTER) and len(html) < 5_000:
            if len(_formulas) >= 2_000:
                _formulas.clear()
            _formulas[html] = known
    return (*known, html if known[0] == "katex-html-only" else None)


def formulas(root: Node, own: list[Node] | None = None) -> list[dict]:
    out = []
    for i, n in enumerate(formula_nodes(root) if own is None else own, 1):
        kind, latex, digest, html = _formula(n)
        out.append({"ord": i, "source_id": f"formula-{i:04d}", "display": _display(n), "source_kind": kind, "dom_hash": digest, "original_latex": latex, "html": html})
    return out


# -- assets


def _payload(src: str) -> int:
    """About how many bytes a data URI holds."""
    head, comma, data = src.partition(",")
    if not comma or not head.startswith("data:"):
        return 0
    return len("".join(data.split()).rstrip("=")) * 3 // 4 if ";base64" in head else len(data)


def asset_source(n: Node) -> tuple[str, str]:
    src = n.get("src").strip()
    if _payload(src) >= 512:
        return "data-uri", src
    lazy = [(a, v) for a in LAZY if (v := n.get(a).strip())]
    for a, v in lazy:
        if v != src:
            return f"lazy:{a}", v
    return ("data-uri" if src.startswith("data:") else "url" if src else "missing"), src


def assets(root: Node, own: list[Node] | None = None) -> list[dict]:
    out = []
    for i, n in enumerate(root.all("img", "iframe", "video") if own is None else own, 1):
        kind, src = asset_source(n)
        out.append({"ord": i, "source_id": f"asset-{i:04d}", "tag": n.tag, "source_kind": kind, "source_chars": len(src), "alt": n.get("alt"), "lazy": kind == "missing" or kind.startswith("lazy:")})
    return out


# -- semantic identity and counts


def candidates(root: Node, kind: str, nodes: list[Node] | None = None) -> list[dict]:
    """Wrappers and native elements of a kind with the identity that they share.  nodes: the elements below the root, where they are known."""
    wrapper, native = SEMANTIC[kind]
    out = []
    for n in root.walk() if nodes is None else nodes:
        if native(n):
            own, how, priority = n, f"native-{n.tag}", 0
        elif n.attrs and _is(n, wrapper):
            inner = [x for x in n.walk() if native(x) and not any(native(u) for u in _below(x, n))]
            if len(inner) > 1:
                raise Blocked(f"ambiguous {kind} wrapper {n.path()} contains {len(inner)} native nodes")
            own = inner[0] if inner else next((u for u in n.up() if native(u)), n)
            how, priority = f"slate-{kind}-wrapper", 10
        else:
            continue
        out.append({"kind": kind, "idx": len(out), "semantic_id": own.path(), "source_dom_id": n.path(), "representation": how, "priority": priority})
    return out


def _below(node: Node, top: Node):
    for u in node.up():
        if u is top:
            return
        yield u


def _identities(root: Node, kind: str, nodes: list[Node], seen: Seen) -> int:
    if "data-slate-type" in seen.attrs:
        return len({c["semantic_id"] for c in candidates(root, kind, nodes)})
    if seen.tags.isdisjoint(NATIVE[kind]):
        return 0
    native = SEMANTIC[kind][1]  # without wrappers each has its own
    return len([1 for n in nodes if native(n)])


def counts(root: Node, found: list[dict], nodes: list[Node] | None = None, seen: Seen | None = None) -> dict[str, int]:
    nodes = root.walk() if nodes is None else nodes
    seen = Seen(nodes) if seen is None else seen
    same = {k: _identities(root, k, nodes, seen) for k in SEMANTIC}
    heads = {id(n) for n in nodes if n.tag in HEADS} if not seen.tags.isdisjoint(HEADS) else ()
    wraps = [n for n in nodes if n.attrs and id(n) not in heads and n.get("data-slate-type").startswith("heading")] if "data-slate-type" in seen.attrs else []
    headings = len(heads) + sum(len([x for x in n.walk() if id(x) in heads]) != 1 for n in wraps)
    return {
        "headings": headings,
        "tables": same["table"],
        "lists": same["list"],
        "list_items": same["list_item"],
        "images": sum(n.tag == "img" for n in nodes) if "img" in seen.tags else 0,
        "codeblocks": same["codeblock"],
        "formula_block": sum([f["display"] == "block" for f in found]),
        "formula_inline": sum([f["display"] == "inline" for f in found]),
        "formula_total": len(found),
        "formula_unique": len({f["dom_hash"] for f in found}),
    }


def signals(html: str, lazy: int, frames: int, stray: int, captions: int) -> dict:
    low = html.lower()
    return {"notebook": any([m in low for m in NOTEBOOK]), "virtualized_editor": any([m in low for m in EDITOR]), "lazy": lazy, "iframes": frames, "stray_scripts": stray, "captions": captions}


def reasons(seen: dict) -> list[str]:
    """Of the signals."""
    checks = (
        (seen["notebook"], "notebook markers detected"),
        (seen["virtualized_editor"], "virtualized editor markers detected"),
        (seen["lazy"], f"{seen['lazy']} lazy or missing resource placeholders"),
        (seen["stray_scripts"], f"{seen['stray_scripts']} standalone math/tex script formulas require strict MathJax handling"),
    )
    return [text for hit, text in checks if hit]


def preflight(html: str, whole: bool = True) -> dict:
    """Everything that is known of a page before it is rendered; ``root`` is the compacted body, ``nodes`` are its formulas and its assets, ``every`` the page's elements and strings.  whole: with the compacted HTML."""
    tree, every = flowing(protected(html))
    nodes = [n for n in every if n.__class__ is Node]
    seen = Seen(nodes)
    stray = stray_scripts(tree, nodes) if "script" in seen.tags else 0
    body, selector = body_of(tree, nodes, seen)
    root, flow = compacted(body, every)
    nodes, strings = [n for n in flow if n.__class__ is Node], [n for n in flow if n.__class__ is str]
    mine = formula_nodes(root, nodes) if seen.may(FORMULA) else [], [n for n in nodes if n.tag in ASSETS] if not seen.tags.isdisjoint(ASSETS) else []
    f, a = formulas(root, mine[0]), assets(root, mine[1])
    text = " ".join(" ".join(strings).split())
    raw = any([n.tag in RAW for n in nodes]) if not seen.tags.isdisjoint(RAW) else False
    small = root.html() if whole or raw or root.tag in RAW else None
    held = root.select(CAPTIONS, nodes) if seen.may(CAPTIONS) else []
    signs = signals(html, sum([x["lazy"] for x in a]), sum([x["tag"] == "iframe" for x in a]), stray, len(held))
    why = reasons(signs)
    if held:
        why.append(f"{len(held)} captions require strict handling")
    size, compact = len(html.encode()), html_bytes([root, *nodes], strings) if small is None else len(small.encode())
    return {"root": root, "nodes": mine, "every": every, "selector": selector, "title": title_of(root, nodes), "signals": signs, "text_chars": len(text), "input_bytes": size, "compact_bytes": compact, "visible_bytes": len(text.encode()), "reduction_ratio": round(compact / size, 6) if size else 0.0, "counts": counts(root, f, nodes, seen), "formulas": f, "assets": a, "strict_reasons": why, "compact_html": small}
