import pytest
from docweave.functions import docsite, katex, names
from docweave.functions.language import guess
from docweave.functions.preflight import Blocked, canonical, preflight
from docweave.functions.tree import parse
from docweave.operators import pages

LONG = "This paragraph is long enough to count as the text of an article, with more than eighty characters in it."


def page(body):
    return f"<html><body><nav>x</nav><article><h1>Title</h1><p>{LONG}</p>{body}</article></body></html>"


def outcome(spark, *bodies, **kw):
    df = spark.createDataFrame([(i, b if b is None or b.startswith("<html") else page(b)) for i, b in enumerate(bodies)], "page_id bigint, html string")
    return [r.asDict(True) for r in pages.convert_pages(df, **kw).orderBy("page_id").collect()]


def test_conversion(spark):
    rows = outcome(
        spark,
        "<h2>Sub</h2><ul><li>one<ul><li>two</li></ul></li></ul><ol><li><section><p>x</p></section></li></ol><blockquote><p>q</p></blockquote>",
        "<table><tr><th>a</th><th>b</th></tr><tr><td>1|2</td><td><b>3</b></td></tr></table><pre><code class='language-python'>\nprint(1)\n</code></pre>",
        '<p>See <span class="katex" data-tex="x_i">x</span> and <a href="/u">link <em>it</em></a><br>end , yes.</p>',
        '<img src="data:image/png;base64,iVBORw0KGgo=" alt="a]b">',
        "<table><tr><td rowspan=2>a</td></tr></table>",
        "<p><strong>x</strong></p><strong>alone</strong>",
        '<img src="https://x/y.png">',
        "<pre>bare</pre>",
        '<p><span class="katex"><span class="katex-html"><span class="mord">z</span></span></span></p>',
        "<figure><img src='data:image/png;base64,AAAA'><figcaption>c</figcaption></figure>",
    )
    text = [r["markdown"] for r in rows]
    assert [r["status"] for r in rows] == ["converted"] * 4 + ["strict_required"] * 3 + ["blocked"] * 2 + ["strict_required"]
    assert "## Sub\n\n- one\n  - two\n\n1. x\n\n> q" in text[0]
    assert "| a | b |\n| --- | --- |\n| 1\\|2 | **3** |" in text[1] and "```python\nprint(1)\n```" in text[1]
    assert "See $x\\_i$ and [link *it*](/u) end, yes." in text[2]
    assert "![a\\]b](files/Title/asset-0001.png)" in text[3] and rows[3]["files"][0]["name"] == "asset-0001.png"
    assert rows[7]["reasons"] == ["codeblocks: expected 0, emitted 1"] and rows[8]["reasons"] == ["1 formulas await batch KaTeX validation"]
    assert text[4:7] == [None] * 3 and text[7] and "{{FORMULA:formula-0001}}" in text[8] and text[9] is None


def test_outcomes_of_odd_pages(spark):
    rows = outcome(spark, None, "<html><body><p>short</p></body></html>", f"<html><article>{LONG}</article><article>{LONG}</article></html>", "<p>jupyter</p>")
    assert [r["status"] for r in rows] == ["strict_required"] * 4
    assert "no unique" in rows[0]["reasons"][0] and "ambiguous" in rows[2]["reasons"][0] and rows[3]["reasons"] == ["notebook markers detected"]
    assert outcome(spark, "", mode="strict")[0]["reasons"] == ["strict mode explicitly requested"]
    with pytest.raises(ValueError, match="mode"):
        outcome(spark, "", mode="guess")


def test_formulas_once_per_hash(spark):
    def k(x):
        return f'<span class="katex"><span class="katex-html"><span class="mord">{x}</span></span></span>'

    rows = [(1, page(f"<p>{k('α')} {k('α')} {k('x')}</p>")), (2, page(f"<p>{k('α')} <span class='katex'><span class='katex-html'><span class='accent'>q</span></span></span></p>"))]
    f = pages.formula_rows(pages.preflights(spark.createDataFrame(rows, "page_id bigint, html string")))
    res = pages.resolve_formulas(f)
    got = {r["latex"]: r["success"] for r in res.collect()}
    assert got == {"\\alpha": True, "x": True, None: False}
    jobs = {r["latex"]: r["source_ids"] for r in pages.validation_jobs(f, res).collect()}
    assert jobs == {"\\alpha": ["formula-0001", "formula-0002", "formula-0001"], "x": ["formula-0003"]}
    latex = f.join(res.select("dom_hash", "latex"), "dom_hash").select("page_id", "source_id", "latex")
    out = {r["page_id"]: r["status"] for r in pages.convert_pages(spark.createDataFrame(rows, "page_id bigint, html string"), latex).collect()}
    assert out == {1: "converted", 2: "blocked"}


def test_one_pass(spark):
    """The conversion is one Arrow kernel, and each page is parsed once."""
    df = pages.convert_pages(spark.createDataFrame([(1, page(""))], "page_id bigint, html string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan
    r = df.collect()[0]
    assert r["parses"].asDict() == {"full_document": 1, "detached_body": 0, "compact_snapshot": 0}
    assert r["package"] == "Title" and r["title"] == "Title" and r["timings"]["total"] >= r["timings"]["preflight"] > 0 and r["timings"]["resume"] == 0


KATEX = '<p><span class="katex"><span class="katex-html"><span class="mord">{}</span></span></span></p>'


def test_blockers_and_gate(spark):
    """Rebuilt formulas block their page until a report confirms the batch; failures block it for good."""
    rows = [(1, page(KATEX.format("z") * 2 + KATEX.format("y"))), (2, page(KATEX.format("z"))), (3, page('<p><span class="katex"><span class="munder">z</span></span></p>')), (4, page("<p>plain</p>"))]
    df = spark.createDataFrame(rows, "page_id bigint, html string")
    got = {r["page_id"]: r for r in pages.convert_pages(df).collect()}
    assert [got[i]["status"] for i in (1, 2, 3, 4)] == ["blocked"] * 3 + ["converted"]
    assert "3 formulas await batch KaTeX validation" in got[1]["reasons"] and "1 formula parse failures" in got[3]["reasons"]
    assert "{{FORMULA:formula-0001}}" in got[1]["markdown"] and got[1]["unresolved"] == ["formula-0001", "formula-0002", "formula-0003"]
    s = got[1]["formula_batch"].asDict()
    assert s == {"formula_total": 3, "formula_unique": 2, "cache_hits": 0, "cache_written": 1, "parsed_unique": 2, "resolved": 0, "failures": 0, "pending_validation": 3, "validation_jobs": 2, "validation_html_written": 1, "validation_nodes_saved": 1, "browser_batches_planned": 1}
    staged = pages.staged_pages(df)
    jobs = pages.pending_jobs(staged).collect()
    assert sorted((j["latex"], j["formulas"]) for j in jobs) == [("y", 1), ("z", 3)]
    items = [{"source_id": j["source_id"], "dom_hash": j["dom_hash"], "latex": j["latex"]} for j in jobs]
    say = lambda n: spark.createDataFrame([("0.16", True, True, n, n, [], items)], "katex_version string, runtime_loaded boolean, completed boolean, total int, passed int, failures array<string>, items array<struct<source_id:string,dom_hash:string,latex:string>>")
    good = {r["page_id"]: r for r in pages.convert_pages(df, report=say(2)).collect()}
    assert [good[i]["status"] for i in (1, 2, 3, 4)] == ["converted", "converted", "blocked", "converted"]
    assert "$z$" in good[1]["markdown"] and good[1]["formula_batch"]["resolved"] == 3 and good[1]["formula_batch"]["pending_validation"] == 0
    bad = {r["page_id"]: r for r in pages.convert_pages(df, report=say(1)).collect()}
    assert bad[1]["status"] == "blocked" and "counts do not match the pending batch" in bad[1]["reasons"]
    # What one run found out is the next one's cache.
    cache = pages.new_cache_entries(staged)
    assert {(r["latex"], r["success"], r["validation"]) for r in cache.collect()} == {("z", True, "not_validated"), ("y", True, "not_validated"), (None, False, "not_validated")}
    again = {r["page_id"]: r["formula_batch"] for r in pages.convert_pages(df, cache=cache).collect()}
    assert again[1]["cache_hits"] == 2 and again[1]["parsed_unique"] == 0 and again[1]["cache_written"] == 0
    assert pages.new_cache_entries(pages.staged_pages(df, cache=cache), cache).isEmpty()
    pages.KNOWN_ROWS, before = 1, pages.KNOWN_ROWS
    try:
        far = {r["page_id"]: r["formula_batch"]["cache_hits"] for r in pages.convert_pages(df, cache=cache).collect()}
    finally:
        pages.KNOWN_ROWS = before
    assert far == {1: 2, 2: 1, 3: 1, 4: 0}


def test_kernels_without_the_package(tmp_path):
    """Executors needn't have the package: the job runs from another folder, where workers can't import it."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    code = f"""
import sys
sys.path.insert(0, {str(root)!r})
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local-cluster[1,1,1024]").config("spark.ui.enabled", "false").config("spark.executorEnv.PYTHONPATH", "").getOrCreate()
from docweave.operators import pages
df = s.createDataFrame([(1, {page('<ul><li>a</li></ul>')!r})], "page_id bigint, html string")
print([r["status"] for r in pages.convert_pages(df).collect()], pages.docsite_pages(df).collect()[0]["error"])
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env | {"SPARK_SCALA_VERSION": "2.13"}, capture_output=True, text=True, timeout=240, check=False)
    assert "['converted'] None" in done.stdout, done.stderr[-2000:]


def test_docsite_images(spark):
    html = '<div class="vp-doc"><h1>T</h1><img src="/p/assets/i.png" alt="a"><img src="gone.png" alt="b"><img src="data:image/gif;base64,QUI="><img src="../assets/%2e%2e/%2e%2e/x"></div>'
    df = spark.createDataFrame([(1, "https://x/docs/a", html), (2, "https://x/docs/b", html), (3, "https://x/docs/c", "<p>no body</p>")], "page_id bigint, url string, html string")
    images = pages.page_images(df, "https://x/docs")
    assert images.filter("path is null").count() == 2
    stored = pages.stored_images(images, lambda u: b"PNG" if u.endswith("i.png") else None)
    got = {r["url"]: r["data"] for r in stored.collect()}
    assert got["https://x/p/assets/i.png"] == b"PNG" and got["https://x/docs/gone.png"] is None and got["data:image/gif;base64,QUI="] == b"AB"
    out = {r["page_id"]: r for r in pages.localized_pages(df, stored, "https://x/docs").collect()}
    assert out[1]["path"] == "a.md" and "![a](assets/i.png)" in out[1]["markdown"] and "*[图片: b]*" in out[1]["markdown"] and out[3]["error"]
    clash = spark.createDataFrame([(1, "https://x/docs/a", '<main><p>t</p><img src="https://y/assets/i.png"><img src="https://z/q/assets/i.png"></main>')], "page_id bigint, url string, html string")
    with pytest.raises(ValueError, match="clash"):
        pages.stored_images(pages.page_images(clash, ""), lambda u: b"")


def test_canonical_hash_and_nesting():
    a, b = (parse(f'<span {x}> t  u </span>').elements()[0] for x in ('class="katex b" style="top: 1em;left:2px" onclick="x"', 'style="left:2px ; top: 1em" class="b katex"'))
    assert canonical(a) == canonical(b)
    p = preflight(page('<p><span data-formula="x"><span data-formula="x">x</span></span><math alttext="y"></math></p>'))
    assert [(f["source_kind"], f["original_latex"]) for f in p["formulas"]] == [("data-formula", "x"), ("alttext", "y")]


def test_lazy_and_assets():
    big = "data:image/png;base64," + "A" * 800
    p = preflight(page(f'<img src="{big}" data-src="u"><img src="data:x,1" data-src="u"><img><iframe src="v"></iframe>'))
    assert [(a["source_kind"], a["lazy"]) for a in p["assets"]] == [("data-uri", False), ("lazy:data-src", True), ("missing", True), ("url", False)]
    assert p["strict_reasons"] == ["2 lazy or missing resource placeholders"]


def test_semantic_identity(spark):
    body = '<div data-slate-type="table"><table><tr><td>a</td></tr></table></div><div data-slate-type="list"><ol><li>x<ul><li>y</li></ul></li></ol></div>'
    df = pages.semantic_candidates(spark.createDataFrame([(1, page(body))], "page_id bigint, html string"))
    one = pages.canonical_candidates(df, ["page_id", "kind"]).groupBy("kind").count().collect()
    assert {r["kind"]: r["count"] for r in one} == {"table": 1, "list": 2, "list_item": 2}
    with pytest.raises(Blocked, match="ambiguous"):
        preflight(page('<div data-slate-type="table"><table></table><table></table></div>'))


def test_node_table(spark):
    rows = {r["tag"]: r for r in pages.node_table(spark.createDataFrame([(1, "<div><p>a<p>b<br></div>"), (2, None)], "page_id bigint, html string")).collect()}
    assert rows["div"]["pre"] < rows["br"]["pre"] and rows["br"]["post"] < rows["div"]["post"] and rows["p"]["depth"] == 1


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ('<span class="mfrac"><span class="vlist"><span style="top:-3em">1</span><span style="top:-2em">n</span></span></span>', r"\frac{1}{n}"),
        ('x<span class="msupsub"><span class="vlist-t2"><span class="vlist"><span style="top:-2.5em">i</span></span></span></span>', "x_{i}"),
        ('<span class="mord text"><span class="mord">a_b</span></span>', r"\text{a\_b}"),
        ('<span class="mop">log</span><span class="mord">x</span>', r"\log x"),
        ('<span class="mop op-limits"><span class="vlist-t2"><span class="vlist"><span style="top:-1em">i</span><span style="top:-3em"><span class="op-symbol">∑</span></span><span style="top:-4em">n</span></span></span></span>', r"\sum_{i}^{n}"),
        ('<span class="munder">x</span>', None),
        ("<span></span>", None),
    ],
)
def test_katex(html, want):
    assert katex.latex_of(parse(f'<span class="katex"><span class="katex-html">{html}</span></span>').elements()[0])[0] == want


def test_formula_checks():
    assert katex.mapping(r"x_t \leftarrow \text{observed\_at}") == ("x_t", "observed_at")
    assert katex.mapping(r"y \leftarrow \text{a} \leftarrow \text{b}") is None and katex.mapping(r"x \leftarrow \text{a`b}") is None
    assert katex.bare_identifier("field_coverage") and katex.bare_identifier(r"field\_coverage")
    assert not katex.bare_identifier(r"x_i + \text{a {b} c_def} + \sum_{ij}")


@pytest.mark.parametrize(
    ("code", "want"),
    [("def f(x):\n    return 1", "python"), ("const a = 1;", "javascript"), ("$env:A=1; python -m pytest\ngit add", "powershell"), ('{"a": 1}', "json"), ("$ ls\n", "bash"), ("the def of done", None), ("pip install x", None), ("", None)],
)
def test_language(code, want):
    assert guess(code) == want


@pytest.mark.parametrize(("title", "want"), [("Ａ/b__c!", "A-b-c"), ("  ", "article"), ("con", "article-con"), ("图 1：x", "图-1-x")])
def test_names(title, want):
    assert names.package_name(title) == want


def test_numbers_uris_paths():
    assert names.numbered_name("01 | Intro", 1) == "01-Intro" and names.numbered_name("2026 research", 1) == "01-2026-research"
    with pytest.raises(ValueError):
        names.numbered_name("x", 0)
    assert names.data_uri("data:,a%20b") == ("text/plain", b"a b") and names.data_uri("DATA:image/PNG;base64,QUI=") == ("image/png", b"AB")
    for bad in ("data:x", "data:image,1", "data:image/png;base64,?", "data:,%zz", "http://x"):
        with pytest.raises(ValueError):
            names.data_uri(bad)
    assert [names.page_path(u, "https://x/docs") for u in ("https://x/docs", "https://x/docs/a/b?q#h", "https://x/docs/a/")] == ["index.md", "a/b.md", "a/index.md"]
    with pytest.raises(ValueError):
        names.page_path("https://x/docs-old/a", "https://x/docs")
    assert names.relative_link("assets/a b.png", "x/y.md") == "../assets/a%20b.png"


def test_docsite():
    html = '<div class="vp-doc"><h1>T<a href="#t">#</a></h1><script>x</script><p>a <code>b</code></p><div class="language-js"><button>copy</button><pre><code>1 &amp;amp; 2\n</code></pre></div><table><tr><th>k</th></tr><tr><td>&lt;wbr&gt;&amp;lt;key&amp;gt;</td></tr></table><h2></h2><p><a href="x"><img src="i"></a></p></div>'
    out = docsite.page_markdown(html)
    assert out == "# T\n\na `b`\n\n```js\n1 & 2\n```\n\n| k |\n| --- |\n| &lt;key&gt; |\n"
    assert docsite.decoded("&currentschema &amp; &#x41; &notreal;") == "&currentschema & A &notreal;"
    card = '<div class="vp-doc"><a class="VPFeature" href="/g/start"><article class="box"><h2>H</h2><p>d</p></article></a></div>'
    assert docsite.page_markdown(card) == "## H\n\nd\n\n[H](/g/start)\n"
    assert docsite.page_markdown("<main><p>a</p><img src='/p/assets/i.png' alt='z'></main>", url="https://x/", page_file="a.md", fetch=lambda u: u.endswith("png")) == "a\n\n![z](assets/i.png)\n"
    with pytest.raises(ValueError):
        docsite.page_markdown("<p>x</p>")
