"""How much the page kernels do for one page."""

import pytest
from docweave.functions import katex, markdown, render, tree
from docweave.operators import pages
from docweave.plans import catalog, held
from test_pages import KATEX, page
from test_tasks import PLAIN, SF, built

#: Queries of the page kernels; each is a finding of round 2.
WALKED = "f11_validation_jobs f12_confirmed_pages f7_katex k11_cache_entries p5_eligible v5_lists w2_parse_counts f6_cache_hits v11_tables v3_headings_paragraphs v8_quotes_marks r9_page_complexity f14_batch_stats b8_sizes r11_refusals f4_canonical_hash r14_package_collisions v9_code_blocks i2_assets".split()


class Caught(Exception):
    """Ends a query once its first kernel is known."""


@pytest.mark.parametrize("name", WALKED)
def test_pages_are_walked_rarely(spark, monkeypatch, name):
    """The parse gives the elements in order and says which names there are, so few steps need a walk of their own."""
    caught = []

    def rows(df, kernel, schema):
        caught.append((df, kernel))
        raise Caught

    monkeypatch.setattr(pages, "_rows", rows)
    with pytest.raises(Caught):
        catalog.queries()[name](spark, SF)
    (df, kernel), walks, walk = caught[0], [], tree.Node.walk
    monkeypatch.setattr(tree.Node, "walk", lambda n: walks.append(n.parent is None) or walk(n))
    n = sum(len(list(kernel(r.asDict()))) for r in df.limit(30).collect())
    assert n and sum(walks) <= 2 * n and len(walks) <= 4 * n  # of whole trees, and of all


def test_known_markup_is_cut():
    """Pages without comments or ``<`` in scripts don't need the pattern, and their elements come in document order."""
    for html in PLAIN + [page("<p>a > b</p><script>x > y</script>")]:
        for whole in (True, False):
            root, seen = tree.parsed(html, whole)
            assert [id(n) for n in seen] == [id(n) for n in root.walk()]
            if not any(x in html for x in ("<!--", "a<b", "a>b")):
                cut = tree._cut(html, whole, [])
                assert ([(n.path(), n.attrs, list(n.attrs), n.children and [c for c in n.children if isinstance(c, str)]) for n in cut.walk()], cut.html()) == built(html, whole)


def test_same_formula_is_read_once(monkeypatch):
    """One reading for each markup of all pages of a task."""
    seen, real = [], katex.latex_of
    monkeypatch.setattr(katex, "latex_of", lambda n: seen.append(n) or real(n))
    pages._read.clear()
    out = [pages._converted({"page_id": i, "html": page(KATEX.format("rare"))}, {}, False) for i in range(5)]
    assert len(seen) == 1 and len({str(x["jobs"]) for x in out}) == 1 and out[0]["stats"]["parsed_unique"] == 1


def test_short_ways_of_text():
    """Text that no rule can change is returned as it is, other text goes the long way."""
    assert markdown.postprocessed("\r\n# a\r\rb  c\n\n") == "# a\n\nb  c\n" and markdown.postprocessed("\n") == ""
    assert markdown.postprocessed("a****b\n") == "ab\n" and markdown.postprocessed("$a_b$\n") == "$$a_b$$\n" and "<div" in markdown.postprocessed("\u56fe 1\u3000x\n")
    with pytest.raises(markdown.Fence):
        markdown.postprocessed("```\na")
    assert [render.tidy(x) for x in ("a  b", "a\tb", "a\r\nb", " ( a ) , b", "\u00a0a\u00a0 b")] == ["a b", "a b", "a b", "(a), b", "a\u00a0 b"]


def test_compacted_body_has_no_page():
    """Taken out of its page: paths and displays end at the body, whatever stands around it."""
    p = pages.preflight(f"<html><body><div class='katex-display'><article onclick='x'><h1>t</h1><p>{held.PAD}</p><script>s</script><span class='katex' data-tex='a'>a</span></article></div></body></html>")
    assert p["root"].parent is None and p["formulas"][0]["display"] == "inline" and "script" not in p["compact_html"] and "onclick" not in p["compact_html"] and p["compact_html"] == p["root"].html()
