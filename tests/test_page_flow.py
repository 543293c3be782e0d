"""What the parse already knows of a page isn't found out again."""

import pytest
from docweave.functions import preflight, tree
from docweave.operators import pages
from docweave.plans import held
from test_tasks import ODD, PLAIN

BODIES = [*PLAIN, *ODD, *(b for b, _, _ in held._REFUSED), held._REBUILT, held._CANDIDATES, "<p>é &amp; 中<br>x &lt;</p><a onclick='x' href='/q&amp;\"'>l</a>", "<span data-formula='x'>a<script>1</script>b</span>", "<span class='katex'>q<script type='math/tex'>a&amp;b</script></span>", "a</x>b<p>c<p>d"]


@pytest.mark.parametrize("body", BODIES)
def test_flow(body):
    """Elements and strings come in document order from every parser, and what is below a node is a part of them."""
    for whole in (True, False):
        root, flow = tree.flowing(held.HEAD + body + held.TAIL + " x", whole)
        want = root.flow()
        assert len(flow) == len(want) and all(a is b if isinstance(a, tree.Node) else a == b for a, b in zip(flow, want, strict=True))
        assert [n for n in want if isinstance(n, str)] == root.strings() and [n for n in want if isinstance(n, tree.Node)] == root.walk()
        for n in root.walk():
            assert [x if isinstance(x, str) else id(x) for x in tree.below(n, flow)] == [x if isinstance(x, str) else id(x) for x in n.flow()]
            assert all(n.has_words(k) == (len(n.words()) >= k) for k in range(0, 130, 7))


@pytest.mark.parametrize("body", BODIES)
def test_size_without_html(body):
    """The compacted body's bytes are counted, not written."""
    html = held.HEAD + body + held.TAIL
    try:
        whole = preflight.preflight(html)
    except preflight.Blocked:
        return
    bare = preflight.preflight(html, False)
    assert bare["compact_bytes"] == whole["compact_bytes"] == len(whole["compact_html"].encode())
    assert {k: v for k, v in bare.items() if k not in ("root", "nodes", "every", "compact_html")} == {k: v for k, v in whole.items() if k not in ("root", "nodes", "every", "compact_html")}


def test_trees_go_at_once(monkeypatch):
    """A converted page leaves no cycles for the collector."""
    made, real = [], pages.preflight
    monkeypatch.setattr(pages, "preflight", lambda *a: made.append(real(*a)) or made[-1])
    pages._converted({"page_id": 1, "html": held.HEAD + held._REBUILT + held.TAIL}, {}, False)
    assert all(n.parent is None for n in made[0]["every"] if isinstance(n, tree.Node))


def test_same_formula_is_hashed_once(monkeypatch):
    """Formulas of the same markup are read once, whatever page they are on; their place counts for each."""
    seen, real = [], preflight.canonical
    monkeypatch.setattr(preflight, "canonical", lambda n: seen.append(n.tag) or real(n))
    preflight._formulas.clear()
    one = '<span class="katex" data-tex="q">t</span>'
    got = [preflight.preflight(held.HEAD + x + held.TAIL)["formulas"] for x in (f"<p>{one} {one}</p>", f"<div class='katex-display'>{one}</div>")]
    assert len([t for t in seen if t == "span"]) == 1 and len({f["dom_hash"] for x in got for f in x}) == 1 and [f["display"] for x in got for f in x] == ["inline", "inline", "block"]
