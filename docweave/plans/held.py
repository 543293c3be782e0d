"""Registered queries that run the page, formula, Markdown and naming kernels and hold their results against plain SQL.

The given pages have headings and paragraphs only.  So these queries write the markup that an operator works on around
the columns of a whole table, run the operator itself, and the SQL puts together what must come out.  A template has its
columns between « and »; the same template serves Spark and SQL.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import docsite, images, language, markdown, names, render
from ..operators import images as image_ops
from ..operators import ledgers, pages
from ..sources import sinks
from ..sources.readers import spread, table

_made: dict = {}
_sql: dict[str, str] = {}

PAD = "This paragraph is long enough to count as the text of an article, with more than eighty characters in it."
HEAD, TAIL = f"<html><head><title>t</title></head><body><nav>n</nav><article><h1>Held</h1><p>{PAD}</p>", "</article></body></html>"
MD = f"# Held\n\n{PAD}\n\n"

Cases = str | list[str]


def _query(sql: str):
    def keep(f):
        _made[f.__name__], _sql[f.__name__] = f, sql
        return f

    return keep


def _split(template: str) -> list[str]:
    return re.split("«(.*?)»", template)


def _column(template: Cases, by: str = "") -> Column:
    """The template with its columns; of a list the one whose number is ``by`` modulo their number."""
    if isinstance(template, list):
        return F.element_at(F.array(*(_column(t) for t in template)), (F.expr(by) % len(template)).cast("int") + 1)
    return F.concat(F.lit(""), *(F.expr(x).cast("string") if i % 2 else F.lit(x) for i, x in enumerate(_split(template)) if x))


def _text(template: Cases, by: str = "") -> str:
    """The same as SQL."""
    if isinstance(template, list):
        return f"case ({by}) % {len(template)} " + " ".join(f"when {i} then {_text(t)}" for i, t in enumerate(template)) + " end"
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return "(" + (" || ".join(f"({x})::varchar" if i % 2 else quoted(x) for i, x in enumerate(_split(template)) if x) or "''") + ")"


def _pages(spark: SparkSession, d: str, source: str, key: str, body: Cases, head: str = HEAD, tail: str = TAIL) -> DataFrame:
    """page_id, url, html: a page around the body for each row of a table."""
    df = spread(table(spark, d, source))
    return df.select(F.col(key).alias("page_id"), F.concat(F.lit("https://held.example/docs/p"), F.col(key).cast("string")).alias("url"), F.concat(F.lit(head), _column(body, key), F.lit(tail)).alias("html"))


# -- pages to Markdown


def _markdown(name: str, note: str, source: str, key: str, body: Cases, want: Cases, counts: dict[str, int]) -> None:
    """Registers a query of the whole conversion: status, Markdown and what was counted."""
    fields = list(counts)

    def query(spark: SparkSession, d: str) -> DataFrame:
        df = pages.convert_pages(_pages(spark, d, source, key, body))
        return df.select("page_id", "status", "package", F.size("reasons").alias("reasons"), "markdown", *(F.col(f"emitted.{k}").alias(k) for k in fields))

    query.__name__, query.__doc__ = name, note
    _made[name] = query
    _sql[name] = f"select {key} as page_id, 'converted' as status, 'Held' as package, 0 as reasons, {_text(MD)} || {_text(want, key)} || chr(10) as markdown, " + ", ".join(f"{v}::bigint as {k}" for k, v in counts.items()) + f" from {source}"


_markdown(
    "v3_headings_paragraphs", "V0-V4, V14, V17, V21, B2, B4, B9, B10, P1, R4, R5, R11-R13: blocks, containers, dropped scripts.", "orders", "o_orderkey",
    "<h2>Order «o_orderkey»</h2><p onclick=\"x\">Status   «o_orderstatus» , priority ( «o_orderpriority»)\n</p><script>drop()</script><style>p{}</style><div><p>Customer «o_custkey»</p></div><section>plain «o_orderkey»</section><hr><h3>End</h3>",
    "## Order «o_orderkey»\n\nStatus «o_orderstatus», priority («o_orderpriority»)\n\nCustomer «o_custkey»\n\nplain «o_orderkey»\n\n---\n\n### End", {"headings": 3, "tables": 0, "lists": 0, "images": 0},
)
_markdown(
    "v4_split_paragraphs", "V4: a paragraph whose trailing wrappers hold blocks is split.", "supplier", "s_suppkey",
    "<main><span>in «s_name»</span></main><div><h2>A «s_nationkey»</h2><ul><li>x</li></ul></div>",
    "in «s_name»\n\n## A «s_nationkey»\n\n- x", {"headings": 2, "lists": 1, "list_items": 1},
)
_markdown(
    "v5_lists", "V5, V6, R6, R7: nested and numbered lists, wrapped items; counts by identity.", "customer", "c_custkey",
    "<ul><li>«c_name»<ul><li>«c_mktsegment»</li><li>nation «c_nationkey»</li></ul></li><li><div><p>wrapped «c_custkey»</p></div></li></ul><ol><li>a</li><li>b <b>«c_custkey»</b></li></ol>",
    "- «c_name»\n  - «c_mktsegment»\n  - nation «c_nationkey»\n- wrapped «c_custkey»\n\n1. a\n2. b **«c_custkey»**", {"lists": 3, "list_items": 6},
)
_markdown(
    "v7_slate_lists", "V7, R5, R6: editor lists without native elements, and wrappers around native ones.", "supplier", "s_suppkey",
    ['<div data-slate-type="list"><div data-slate-type="list-line">a «s_suppkey»</div><div data-slate-type="list-line">b</div></div>', '<div data-slate-type="list"><ol><li>n «s_name»</li><li>m</li></ol></div>'],
    ["- a «s_suppkey»\n- b", "1. n «s_name»\n2. m"], {"lists": 1, "list_items": 2, "tables": 0},
)
_markdown(
    "v8_quotes_marks", "V8, V16, V18, V20: quotes, marks, code with backticks, links, breaks.", "part", "p_partkey",
    '<blockquote><p>«p_name»</p><p>second</p></blockquote><p><b>«p_brand»</b> <em>«p_type»</em> <del>x</del> <code>a`«p_size»</code> <a href="/p/«p_partkey»">link</a><br>end H<sub>2</sub><strong></strong> <a href="/q"></a></p>',
    "> «p_name»\n>\n> second\n\n**«p_brand»** *«p_type»* ~~x~~ ``a`«p_size»`` [link](/p/«p_partkey») end H<sub>2</sub> [/q](/q)", {"headings": 1, "lists": 0},
)
_markdown(
    "v9_code_blocks", "V9, V10, V19, V20: named, guessed and unnamed blocks, rows of divs, fences longer than what they hold.", "part", "p_partkey",
    ['<pre><code class="language-sql">\nselect «p_partkey»\n    from t\n\n</code></pre>', "<pre><code>a ``` «p_partkey»</code></pre>", "<pre><code><div><span>l1 «p_size»</span></div><div><span>l2</span></div></code></pre>", "<pre><code>def f«p_partkey»(x):\n    return x</code></pre>", '<pre><code>{"k": «p_partkey»}</code></pre>', "<pre><code>const a = «p_size»;</code></pre>", "<pre><code>$ ls «p_size»\n</code></pre>", "<pre><code>$env:A = «p_size»\n</code></pre>"],
    ["```sql\nselect «p_partkey»\n    from t\n```", "````text\na ``` «p_partkey»\n````", "```text\nl1 «p_size»\nl2\n```", "```python\ndef f«p_partkey»(x):\n    return x\n```", '```json\n{"k": «p_partkey»}\n```', "```javascript\nconst a = «p_size»;\n```", "```bash\n$ ls «p_size»\n```", "```powershell\n$env:A = «p_size»\n```"], {"codeblocks": 1, "tables": 0},
)
_markdown(
    "b5_code_indent", "B5, R5: indentation of editor code lines survives the parse.", "supplier", "s_suppkey",
    '<pre data-slate-type="pre"><div data-slate-type="code-line"><span data-slate-string="true">  if x:</span></div><div data-slate-type="code-line"><span data-slate-string="true">    </span><span data-slate-string="true">y(«s_suppkey»)</span></div></pre>',
    "```text\n  if x:\n    y(«s_suppkey»)\n```", {"codeblocks": 1},
)
_markdown(
    "i11_images", "I1, I10, I11, S10, K4: images in data URIs, their file names and text.", "supplier", "s_suppkey",
    ['<img alt="a]«s_suppkey»" src="data:image/png;base64,«base64(encode(s_name, \'utf-8\'))»">', '<img alt="" src="data:image/jpeg;base64,QUI=">', '<p>x <img alt="«s_name»" src="data:image/svg+xml,%3Csvg%3E"></p>', '<figure><img alt="f" src="data:image/x-own;base64,QUI="></figure>'],
    ["![a\\]«s_suppkey»](files/Held/asset-0001.png)", "![](files/Held/asset-0001.jpg)", "x![«s_name»](files/Held/asset-0001.svg)", "![f](files/Held/asset-0001.bin)"], {"images": 1},
)
_markdown(
    "f15_formulas", "F0-F3, F10, F15, V0, P-7, P-8: formulas that the page spells out, inline, displayed and split into variable and name.", "supplier", "s_suppkey",
    ['<p>See <span class="katex" data-tex="x_{«s_suppkey»}\\,y">x</span> here</p>', '<div class="katex katex-display" data-latex="E_«s_suppkey»">E</div>', '<p><span class="katex"><math><annotation encoding="application/x-tex">a+«s_suppkey»</annotation></math></span><span data-formula="b=«s_nationkey»">b</span></p>', '<p>so <span class="katex" data-tex="t \\leftarrow \\text{n\\_«s_suppkey»}">t</span></p>'],
    ["See $x\\_{«s_suppkey»}\\\\,y$ here", "$$\nE_«s_suppkey»\n$$", "$a+«s_suppkey»$ $b=«s_nationkey»$", "so $t$ ← `n_«s_suppkey»`"], {"tables": 0},
)


@_query(f"""with c as (select l_orderkey as k, string_agg('| ' || l_partkey || '\\|' || l_suppkey || ' | ' || l_quantity::bigint || ' | **' || l_returnflag || '** |', chr(10) order by l_linenumber, l_partkey, l_suppkey, l_quantity::bigint || '<', l_returnflag) as rows, count(*) as n from lineitem group by l_orderkey)
select k as page_id, 'converted' as status, {_text(MD)} || '| part | q | flag |' || chr(10) || '| --- | --- | --- |' || chr(10) || rows || chr(10) as markdown, 1::bigint as tables, 0::bigint as warnings from c""")
def v11_tables(spark: SparkSession, d: str) -> DataFrame:
    """A table of each order's lines."""
    row = F.concat(F.lit("<tr><td>"), F.col("l_partkey").cast("string"), F.lit("|"), F.col("l_suppkey").cast("string"), F.lit("</td><td>"), F.col("l_quantity").cast("bigint").cast("string"), F.lit("</td><td><b>"), "l_returnflag", F.lit("</b></td></tr>"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", F.concat(F.col("l_quantity").cast("bigint").cast("string"), F.lit("<")), "l_returnflag", row.alias("row")))), lambda x: x["row"])
    df = spread(table(spark, d, "lineitem"), "l_orderkey").groupBy(F.col("l_orderkey").alias("page_id")).agg(F.array_join(rows, "").alias("rows"))
    df = df.select("page_id", F.concat(F.lit(HEAD + "<table><thead><tr><th>part</th><th>q</th><th>flag</th></tr></thead><tbody>"), "rows", F.lit("</tbody></table>" + TAIL)).alias("html"))
    return pages.convert_pages(df).select("page_id", "status", "markdown", F.col("emitted.tables").alias("tables"), F.size("warnings").cast("bigint").alias("warnings"))


_REFUSED = [
    ("<figure><img src='data:image/png;base64,QUI='><figcaption>c«c_custkey»</figcaption></figure>", "strict_required", "1 captions require strict handling"),
    ("<table><tr><td rowspan=2>«c_custkey»</td></tr></table>", "strict_required", "rowspan/colspan table requires strict handling"),
    ("<iframe src='u«c_custkey»'></iframe>", "strict_required", "iframe requires strict resource handling"),
    ("<img src='https://x/«c_custkey».png'>", "strict_required", "external image asset-0001 must be localized by strict handling"),
    ("<p>a</p><strong>«c_custkey»</strong>", "strict_required", "unsupported semantic element <strong>"),
    ("<p><img></p><img data-src='l«c_custkey»'>", "strict_required", "2 lazy or missing resource placeholders"),
    ("<pre>bare «c_custkey»</pre>", "blocked", "codeblocks: expected 0, emitted 1"),
    ("<div class='jp-cell'>«c_custkey»</div>", "strict_required", "notebook markers detected"),
    ("<table><tr><td>a</td></tr><tr><td>b</td><td>«c_custkey»</td></tr></table>", "strict_required", "empty or ragged table requires strict handling"),
    ("<script type='math/tex'>x«c_custkey»</script>", "strict_required", "1 standalone math/tex script formulas require strict MathJax handling"),
    ("<div class='monaco-editor'>«c_custkey»</div>", "strict_required", "virtualized editor markers detected"),
    ("<video src='v«c_custkey»'></video>", "strict_required", "video requires strict resource handling"),
    ("<p>ok</p><pre><code>a\n b\n  «c_custkey»</code></pre>", "strict_required", "code block indentation looks collapsed; requires strict handling"),
    ("<p><math><mi>x</mi></math> «c_custkey»</p>", "blocked", "1 formula parse failures"),
    ("<ul><li><p>«c_custkey»</p></li></ul>", "strict_required", "unsupported inline semantic element <p>"),
]


@_query(f"select c_custkey as page_id, {_text([s for _, s, _ in _REFUSED], 'c_custkey')} as status, {_text([r for _, _, r in _REFUSED], 'c_custkey')} as reason from customer")
def r11_refusals(spark: SparkSession, d: str) -> DataFrame:
    """What isn't guessed, with its reason."""
    df = pages.convert_pages(_pages(spark, d, "customer", "c_custkey", [b for b, _, _ in _REFUSED]))
    return df.select("page_id", "status", F.get("reasons", F.lit(0)).alias("reason"))


_SHORT = "<nav>menu</nav>"
_BODY = [(f"<article><p>{PAD}</p>«s_suppkey»</article>", "article", None), (f"<main><p>{PAD}</p></main><article>short «s_suppkey»</article>", "main", None), (f"<article>{PAD}</article><article>{PAD}«s_suppkey»</article>", None, "ambiguous body selector 'article': 2 substantial matches"), ("<p>«s_suppkey»</p>", None, "no unique semantic body found; strict inspection is required"), (f"<div id='js_content'>{PAD}</div>", "#js_content", None), (f"<div data-slate-editor='true'>{PAD}</div><article>{PAD}</article>", "[data-slate-editor]", None)]


@_query(f"select s_suppkey as page_id, {_text([b or '' for _, b, _ in _BODY], 's_suppkey')} as selector, {_text([e or '' for _, _, e in _BODY], 's_suppkey')} as error from supplier")
def b2_body_choice(spark: SparkSession, d: str) -> DataFrame:
    """The one body, or why there is none."""
    df = pages.preflights(_pages(spark, d, "supplier", "s_suppkey", [b for b, _, _ in _BODY], f"<html><body>{_SHORT}", "</body></html>"))
    return df.select("page_id", F.coalesce("selector", F.lit("")).alias("selector"), F.coalesce("error", F.lit("")).alias("error"))


_SIZES = "<p>«p_name» é</p><script>s«p_partkey»</script>"


@_query(f"""with h as (select p_partkey as page_id, {_text(HEAD)} || {_text(_SIZES)} || {_text(TAIL)} as html, {_text('<article><h1>Held</h1><p>' + PAD + '</p><p>«p_name» é</p></article>')} as compact, {_text('Held ' + PAD + ' «p_name» é')} as words from part)
select page_id, octet_length(encode(html))::bigint as input_bytes, octet_length(encode(compact))::bigint as compact_bytes, octet_length(encode(words))::bigint as visible_bytes, length(words)::bigint as text_chars, round(octet_length(encode(compact)) * 1.0e0 / octet_length(encode(html)), 6) as reduction_ratio, compact as compact_html from h""")
def b8_sizes(spark: SparkSession, d: str) -> DataFrame:
    """The compacted body, normalised text and sizes."""
    return pages.preflights(_pages(spark, d, "part", "p_partkey", _SIZES)).select("page_id", "input_bytes", "compact_bytes", "visible_bytes", "text_chars", "reduction_ratio", "compact_html")


@_query("""select p_partkey as page_id, ['asset-0001', 'asset-0002', 'asset-0003', 'asset-0004'] as ids, [case when p_size * 20 * 3 // 4 >= 512 then 'data-uri' else 'lazy:data-src' end, 'missing', 'url', 'data-uri'] as kinds,
[case when p_size * 20 * 3 // 4 >= 512 then 22 + p_size * 20 else 1 end, 0, length('v' || p_partkey), 7]::bigint[] as chars, case when p_size * 20 * 3 // 4 >= 512 then 1 else 2 end::bigint as lazy, 1::bigint as iframes from part""")
def i2_assets(spark: SparkSession, d: str) -> DataFrame:
    """Where each asset's bytes are, by the size of what a data URI holds."""
    body = "<img src='data:image/png;base64,«repeat('A', p_size * 20)»' data-src='u'><img><iframe src='v«p_partkey»'></iframe><img src='data:,x' data-src='data:,x'>"
    of = lambda k: F.transform("assets", lambda a: a[k])
    return pages.preflights(_pages(spark, d, "part", "p_partkey", body)).select("page_id", of("source_id").alias("ids"), of("source_kind").alias("kinds"), of("source_chars").alias("chars"), F.col("signals.lazy").alias("lazy"), F.col("signals.iframes").alias("iframes"))


_CANDIDATES = '<div data-slate-type="table"><table><tbody><tr><td>«s_suppkey»</td></tr></tbody></table></div><ul><li>x</li></ul><div data-slate-type="list"><p>no list</p></div>'


@_query("""select s_suppkey as page_id, k.* from supplier, (values ('table', 'article/div[2]/table[0]', 'native-table', 0, 1, 2), ('list', 'article/ul[3]', 'native-ul', 0, 0, 1), ('list', 'article/div[4]', 'slate-list-wrapper', 10, 1, 1), ('list_item', 'article/ul[3]/li[0]', 'native-li', 0, 0, 1)) k(kind, semantic_id, representation, priority, idx, several)""")
def r6_semantic_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Identities of wrappers and native elements, one of each kept."""
    c = pages.semantic_candidates(_pages(spark, d, "supplier", "s_suppkey", _CANDIDATES))
    several = c.groupBy("page_id", "kind", "semantic_id").agg(F.count(F.lit(1)).cast("int").alias("several"))
    one = pages.canonical_candidates(c, ["page_id", "kind"])
    return one.join(several, ["page_id", "kind", "semantic_id"]).select("page_id", "kind", "semantic_id", "representation", "priority", "idx", "several")


_LEVELS = [("<p>«c_custkey»</p>", 0), ("<pre><code>«c_custkey»</code></pre>", 1), ("<p><span class='katex' data-tex='«c_custkey»'>x</span></p>", 2), ("<p><span class='katex'><span class='katex-html'><span class='mord'>x</span></span></span></p>", 3), ("<table><tr><th>«c_custkey»</th></tr></table>", 1)]


@_query(f"select c_custkey as page_id, {_text([str(n) for _, n in _LEVELS], 'c_custkey')}::int as level, {_text(['0', '0', '1', '1', '0'], 'c_custkey')}::bigint as formulas from customer")
def r9_page_complexity(spark: SparkSession, d: str) -> DataFrame:
    """R9 on converted pages."""
    df = pages.convert_pages(_pages(spark, d, "customer", "c_custkey", [b for b, _ in _LEVELS]))
    return df.select("page_id", F.col("complexity").alias("level"), F.col("counts.formula_total").alias("formulas"))


@_query("select c_mktsegment as output, list_sort(list(c_custkey::varchar)) as packages from customer group by c_mktsegment having count(*) > 1")
def r14_package_collisions(spark: SparkSession, d: str) -> DataFrame:
    """Pages of one title want one package."""
    df = pages.convert_pages(_pages(spark, d, "customer", "c_custkey", f"<h1>«c_mktsegment»</h1><p>{PAD}</p>", "<html><body><article>"))
    return ledgers.collisions(df.select(F.col("package").alias("output"), F.col("page_id").cast("string").alias("package")))


@_query("select s_suppkey as page_id, 'converted' as status, 'Held' as title, 1 as images, 'keep' as decision, octet_length(encode(s_name))::bigint as bytes from supplier")
def k6_reports(spark: SparkSession, d: str) -> DataFrame:
    """The status document."""
    body = "<img src=\"data:image/png;base64,«base64(encode(s_name, 'utf-8'))»\">"
    r = sinks.reports(pages.convert_pages(_pages(spark, d, "supplier", "s_suppkey", body)))
    of = lambda path: F.get_json_object("report", path)
    return r.select("page_id", of("$.status").alias("status"), of("$.title").alias("title"), of("$.emitted.images").cast("int").alias("images"), of("$.images[0].decision").alias("decision"), of("$.images[0].bytes").cast("bigint").alias("bytes"))


# -- formulas


@_query("select c_custkey as page_id, 'formula-0001' as source_id, 'inline' as display, 'data-tex' as source_kind, sha256('<span|class=b katex,data-tex=x' || c_nationkey || ',style=left:2px;top:1em>t u</span>') as dom_hash from customer")
def f4_canonical_hash(spark: SparkSession, d: str) -> DataFrame:
    """The hash doesn't depend on how the element is written."""
    ways = ['<p><span class="b katex" style="left:2px; top:1em" onclick="x" data-tex="x«c_nationkey»"> t  u</span></p>', '<p><span data-tex="x«c_nationkey»" style="top: 1em;left :2px" class="katex  b">t u </span></p>']
    return pages.formula_rows(pages.preflights(_pages(spark, d, "customer", "c_custkey", ways))).select("page_id", "source_id", "display", "source_kind", "dom_hash")


def _stack(*rows: tuple[str, str]) -> str:
    return '<span class="vlist">' + "".join(f'<span style="top:{top}em"><span class="pstrut"></span><span class="mord">{x}</span></span>' for top, x in rows) + "</span>"


_KATEX = [
    (f'<span class="mfrac">{_stack(("-3", "«p_partkey»"), ("-2", "n"))}</span>', "\\frac{«p_partkey»}{n}"),
    (f'<span class="mord">x</span><span class="msupsub"><span class="vlist-t2">{_stack(("-2.5", "«p_size»"))}</span></span>', "x_{«p_size»}"),
    (f'<span class="mord">x</span><span class="msupsub">{_stack(("-3", "«p_size»"))}</span>', "x^{«p_size»}"),
    (f'<span class="mord">x</span><span class="msupsub">{_stack(("-2", "i"), ("-3", "«p_size»"))}</span>', "x^{«p_size»}_{i}"),
    ('<span class="mop op-limits"><span class="vlist-t2"><span class="vlist"><span style="top:-1em">i</span><span style="top:-3em"><span class="op-symbol">∑</span></span><span style="top:-4em">«p_partkey»</span></span></span></span>', "\\sum_{i}^{«p_partkey»}"),
    ('<span class="msqrt"><span class="sqrt">s</span><span class="mord">«p_partkey»</span></span>', "\\sqrt{«p_partkey»}"),
    ('<span class="mord text"><span class="mord">«p_name»_%</span></span>', "\\text{«p_name»\\_\\%}"),
    ('<span class="mop">log</span><span class="mord">x</span><span class="mrel">≤</span><span class="mord">«p_partkey»</span>', "\\log x\\leq«p_partkey»"),
    ('<span class="overline"><span class="mord">«p_partkey»</span></span><span class="mspace"></span><span class="mathbb">R</span>', "\\overline{«p_partkey»} \\mathbb{R}"),
    ('<span class="munder">«p_partkey»</span>', None),
    ('<span class="mord"></span>', None),
    ('<span class="mord">α</span><span class="mord">β</span><span class="mbin">−</span><span class="mord">«p_partkey»#</span>', "\\alpha \\beta-«p_partkey»\\#"),
]


@_query(f"select p_partkey as page_id, 'formula-0001' as source_id, nullif({_text([x or '' for _, x in _KATEX], 'p_partkey')}, '') as latex, {_text([str(x is not None).lower() for _, x in _KATEX], 'p_partkey')}::boolean as success from part")
def f7_katex(spark: SparkSession, d: str) -> DataFrame:
    """LaTeX out of KaTeX's HTML, once for each hash."""
    body = [f'<p><span class="katex"><span class="katex-html"><span class="base">{x}</span></span></span></p>' for x, _ in _KATEX]
    rows = pages.formula_rows(pages.preflights(_pages(spark, d, "part", "p_partkey", body))).select("page_id", "source_id", "ord", "dom_hash", "source_kind", "original_latex", "html")
    rows = rows.persist()  # read twice
    return rows.select("page_id", "source_id", "dom_hash").join(pages.resolve_formulas(rows), "dom_hash").select("page_id", "source_id", "latex", "success")


_REBUILT = '<p><span class="katex"><span class="katex-html"><span class="mord">z«c_nationkey»</span></span></span> and <span class="katex"><span class="katex-html"><span class="mord">z«c_nationkey»</span></span></span></p>'


@_query("select 'z' || c_nationkey as latex, 'page-' || min(c_custkey) || '/formula-0001' as source_id, count(*)::bigint as pages, (2 * count(*))::bigint as formulas from customer group by c_nationkey")
def f11_validation_jobs(spark: SparkSession, d: str) -> DataFrame:
    """one job for each rebuilt formula of all pages."""
    return pages.pending_jobs(pages.staged_pages(_pages(spark, d, "customer", "c_custkey", _REBUILT))).select("latex", "source_id", "pages", "formulas")


@_query(f"select c_custkey as page_id, 'converted' as status, {_text(MD)} || '$z' || c_nationkey || '$ and $z' || c_nationkey || '$' || chr(10) as markdown, 2::bigint as resolved, 0::bigint as pending from customer")
def f12_confirmed_pages(spark: SparkSession, d: str) -> DataFrame:
    """A report that confirms the batch unlocks its pages."""
    df = _pages(spark, d, "customer", "c_custkey", _REBUILT)
    staged = pages.staged_pages(df).persist()
    jobs = pages.pending_jobs(staged).agg(F.collect_list(F.struct("source_id", "dom_hash", "latex")).alias("items"))  # of 25 nations
    n = F.size("items")
    report = jobs.select("items", n.alias("total"), n.alias("passed"), F.lit(True).alias("runtime_loaded"), F.lit(True).alias("completed"), F.lit("0.16").alias("katex_version"), F.array().cast("array<string>").alias("failures"))
    return pages.convert_pages(df, report=report, staged=staged).select("page_id", "status", "markdown", F.col("formula_batch.resolved").alias("resolved"), F.col("formula_batch.pending_validation").alias("pending"))


_MIXED = [_REBUILT, "<p><span class='katex' data-tex='a«c_custkey»'>a</span></p>", "<p><math><mi>q</mi></math></p>", "<p>none</p>"]


@_query("""with b as (select c_custkey as page_id, c_custkey % 4 as k from customer)
select page_id, case k when 0 then 'blocked' when 2 then 'blocked' else 'converted' end as status, [case k when 0 then 2 when 3 then 0 else 1 end, case k when 3 then 0 else 1 end, 0, case k when 3 then 0 else 1 end, case k when 0 then 1 else 0 end, case k when 1 then 1 else 0 end, case k when 2 then 1 else 0 end, case k when 0 then 2 else 0 end, case k when 0 then 1 else 0 end, 1, case k when 0 then 1 else 0 end, case k when 0 then 1 else 0 end]::bigint[] as stats from b""")
def f14_batch_stats(spark: SparkSession, d: str) -> DataFrame:
    """The twelve figures of every page's formulas."""
    df = pages.convert_pages(_pages(spark, d, "customer", "c_custkey", _MIXED))
    return df.select("page_id", "status", F.array(*(F.col(f"formula_batch.{k}") for k in pages.STATS)).alias("stats"))


@_query("""select c_custkey as page_id, case when c_nationkey % 2 = 0 then 1 else 0 end::bigint as cache_hits, case when c_nationkey % 2 = 0 then 0 else 1 end::bigint as parsed_unique, case when c_nationkey % 2 = 0 then 0 else 1 end::bigint as cache_written from customer""")
def f6_cache_hits(spark: SparkSession, d: str) -> DataFrame:
    """Hashes that a cache has aren't parsed again."""
    df = _pages(spark, d, "customer", "c_custkey", _REBUILT)
    made = pages.new_cache_entries(pages.staged_pages(df)).filter(F.regexp_extract("latex", "([0-9]+)", 1).cast("int") % 2 == 0)
    got = pages.convert_pages(df, cache=made)
    return got.select("page_id", *(F.col(f"formula_batch.{k}").alias(k) for k in ("cache_hits", "parsed_unique", "cache_written")))


@_query("select 'z' || c_nationkey as latex, true as success, 'not_validated' as validation, 'github' as target_platform from customer where c_nationkey % 2 = 1 group by c_nationkey")
def k11_cache_entries(spark: SparkSession, d: str) -> DataFrame:
    """What the cache doesn't have yet."""
    staged = pages.staged_pages(_pages(spark, d, "customer", "c_custkey", _REBUILT))
    every = pages.new_cache_entries(staged).persist()  # a row for each hash
    have = every.filter(F.regexp_extract("latex", "([0-9]+)", 1).cast("int") % 2 == 0)
    return pages.new_cache_entries(staged, have).select("latex", "success", "validation", "target_platform")


_IDENT = [("a_bc«p_partkey»", True), ("a_{bc}«p_partkey»", False), ("\\text{a_bc}«p_partkey»", False), ("f\\_old«p_partkey»", True), ("x_i«p_partkey»", False)]


@_query(f"select p_partkey, {_text([x for x, _ in _IDENT], 'p_partkey')} as latex, {_text([str(b).lower() for _, b in _IDENT], 'p_partkey')}::boolean as bare from part")
def f13_identifiers(spark: SparkSession, d: str) -> DataFrame:
    """identifiers that would be read as subscripts."""
    from ..functions.katex import bare_identifier

    df = spread(table(spark, d, "part")).select("p_partkey", _column([x for x, _ in _IDENT], "p_partkey").alias("latex"))
    return _mapped(df, "latex", lambda t: str(bare_identifier(t)), "bare").withColumn("bare", F.col("bare").cast("boolean"))


def _mapped(df: DataFrame, column: str, f, name: str) -> DataFrame:
    """Adds what a kernel makes of a text column; null for null."""

    @F.pandas_udf("string")
    def each(texts):
        return texts.map(f, na_action="ignore")

    return df.withColumn(name, each(column))


# -- Markdown rules


def _rules(name: str, note: str, before: Cases, after: Cases) -> None:
    def query(spark: SparkSession, d: str) -> DataFrame:
        df = spread(table(spark, d, "part")).select(F.col("p_partkey").alias("k"), _column(before, "p_partkey").alias("t"))
        return pages.postprocess(df, "k", "t").select("k", "markdown", "changed", "error")

    query.__name__, query.__doc__ = name, note
    _made[name] = query
    b, a = _text(before, "p_partkey"), _text(after, "p_partkey")
    _sql[name] = f"select p_partkey as k, {a} as markdown, ({a}) <> ({b}) as changed, null::varchar as error from part"


_rules(
    "p1_greetings", "P-1: greetings at either end go, structure stays.",
    ["大家好，我是「«p_name»」。正文«p_partkey»。\n\nbody\n\n我们下节课见！\n", "**欢迎来到第«p_partkey»课。内容在此。**\n\nend\n", "# 大家好，标题\n\n文«p_partkey»\n", "text «p_partkey»\n\n好的。期待你的反馈。\n", "你好，我是谁？\n\nx«p_partkey»\n", "a\r\nb«p_partkey»\r\n"],
    ["正文«p_partkey»。\n\nbody\n", "**内容在此。**\n\nend\n", "# 大家好，标题\n\n文«p_partkey»\n", "text «p_partkey»\n\n好的。\n", "你好，我是谁？\n\nx«p_partkey»\n", "a\nb«p_partkey»\n"],
)
_rules(
    "p2_math_spacing", "P-2 to P-6: blanks beside formulas, CJK, seams, display formulas; fenced lines stay.",
    ["a\u00a0$x«p_partkey»$\u00a0b\n", "a  $x«p_partkey»$   b\n", "中$x«p_partkey»$文\n", "**a****b** «p_partkey»\n", "  $x+«p_partkey»$\n", "```\n中$x$文  $y$ **** «p_partkey»\n```\n", "$$x$$中«p_partkey»\n", "价格（$«p_size»$）\n"],
    ["a $x«p_partkey»$ b\n", "a $x«p_partkey»$ b\n", "中 $x«p_partkey»$ 文\n", "**ab** «p_partkey»\n", "$$x+«p_partkey»$$\n", "```\n中$x$文  $y$ **** «p_partkey»\n```\n", "$$x$$中«p_partkey»\n", "价格（ $«p_size»$ ）\n"],
)
_rules(
    "p7_math_escapes", "P-7, P-8: backslashes and underscores as GitHub reads them.",
    ["$a_{«p_partkey»}\\,b$ c_d\n", "$$\nx \\\\ y_«p_partkey»\n$$\n", "$\\alpha_«p_partkey»$ and $\\{«p_size»\\}$\n", "$$\nopen «p_partkey» \\,\n", "`$a_b$` $c_«p_size»$\n"],
    ["$a\\_{«p_partkey»}\\\\,b$ c_d\n", "$$\nx \\\\\\\\ y_«p_partkey»\n$$\n", "$\\alpha\\_«p_partkey»$ and $\\\\{«p_size»\\\\}$\n", "$$\nopen «p_partkey» \\,\n", "`$a\\_b$` $c\\_«p_size»$\n"],
)
_rules(
    "p9_captions", "P-9: captions in their one form.",
    ["图 «p_partkey»\u3000标题 «p_name»\n", '<div align="center"><strong>表 «p_partkey»\u3000数据</strong></div>\n', '<div align="center">\n\n代码 «p_partkey»\u3000程序\n\n</div>\n', '<div align="center">\n\na\n\nb«p_partkey»\n\n</div>\n', "图 «p_partkey» 不是标题\n"],
    ['<div align="center">\n\n**图 «p_partkey»\u3000标题 «p_name»**\n\n</div>\n', '<div align="center">\n\n**表 «p_partkey»\u3000数据**\n\n</div>\n', '<div align="center">\n\n**代码 «p_partkey»\u3000程序**\n\n</div>\n', '<div align="center">\n\na\n\nb«p_partkey»\n\n</div>\n', "图 «p_partkey» 不是标题\n"],
)


_LEFT = ["a {{FORMULA:formula-«p_partkey»}} b\n", "```\n{{FORMULA:f«p_partkey»}}\n```\n", "x\n\n{{FORMULA:a«p_size»}} {{FORMULA:b}}\n", "plain «p_partkey»\n", "a  $x$ «p_partkey»\n", "```\nopen «p_partkey»\n"]


@_query(f"select p_partkey as k, l.line, l.placeholder from part, (select p_partkey as q, 1::bigint as line, '{{{{FORMULA:formula-' || p_partkey || '}}}}' as placeholder from part where p_partkey % 6 = 0 union all select p_partkey, 3, '{{{{FORMULA:a' || p_size || '}}}}' from part where p_partkey % 6 = 2 union all select p_partkey, 3, '{{{{FORMULA:b}}}}' from part where p_partkey % 6 = 2) l where l.q = p_partkey")
def p10_placeholders(spark: SparkSession, d: str) -> DataFrame:
    """P-10: formulas that were left, outside fences."""
    return pages.residual_placeholders(spread(table(spark, d, "part")).select(F.col("p_partkey").alias("k"), _column(_LEFT, "p_partkey").alias("t")), "k", "t")


@_query("select p_partkey as k, [1, 0, 1, 0, 1, 2][p_partkey % 6 + 1] as code, case p_partkey % 6 when 0 then 1 when 2 then 2 when 5 then null else 0 end::bigint as residual from part")
def p11_gate(spark: SparkSession, d: str) -> DataFrame:
    """P-11: clean, to be changed, or unreadable."""
    return pages.gate(spread(table(spark, d, "part")).select(F.col("p_partkey").alias("k"), _column(_LEFT, "p_partkey").alias("t")), "k", "t").select("k", "code", "residual")


_FENCES = [
    ("```py\ncode «p_partkey»\n```\n\n~~~~\n~~~\n~~~~\n", [(1, 3, "`", 3, 0, 0), (5, 7, "~", 4, 0, 0)], None),
    ("> ```\n> «p_partkey»\n> ```\n", [(1, 3, "`", 3, 1, 0)], None),
    ("- ```\n  «p_partkey»\n  ```\n", [(1, 3, "`", 3, 0, 2)], None),
    ("a «p_partkey»\n```\nb\n", [], "unclosed fenced code block opened at line 2"),
    ("````\n```\n«p_partkey»\n", [], "invalid closing fence at line 2: closing fence is shorter than the opener; block opened at line 1"),
    ("plain «p_partkey»\n", [], None),
]
_FENCE_ROWS = " union all ".join([f"select {i} as i, {b[0]} as start_line, {b[1]} as end_line, '{b[2]}' as marker, {b[3]} as marker_length, {b[4]} as blockquote_depth, {b[5]} as container_indent, null::varchar as error" for i, (_, blocks, _) in enumerate(_FENCES) for b in blocks] + [f"select {i}, null, null, null, null, null, null, '{e}'" for i, (_, _, e) in enumerate(_FENCES) if e])


@_query(f"select p_partkey as k, f.* exclude (i) from part join ({_FENCE_ROWS}) f on f.i = p_partkey % {len(_FENCES)}")
def e1_fences(spark: SparkSession, d: str) -> DataFrame:
    """Closed blocks, or the reason why one isn't."""
    return pages.fence_blocks(spread(table(spark, d, "part")).select(F.col("p_partkey").alias("k"), _column([t for t, _, _ in _FENCES], "p_partkey").alias("t")), "k", "t")


@_query("select p_partkey, case p_partkey % 3 when 0 then chr(10) || chr(10) || chr(10) || chr(10) || chr(10) || chr(10) || chr(10) when 1 then chr(10) || chr(10) || chr(10) else chr(10) || chr(10) || chr(10) end as rest, case p_partkey % 3 when 0 then [1, 2, 3, 5, 6, 7] else [1, 2, 3] end as lines from part")
def e2_stripped_fences(spark: SparkSession, d: str) -> DataFrame:
    """Fenced lines emptied, and which ones they are."""
    df = spread(table(spark, d, "part")).select("p_partkey", _column([t for t, _, _ in _FENCES[:3]], "p_partkey").alias("t"))
    df = _mapped(_mapped(df, "t", markdown.without_fences, "rest"), "t", lambda t: ",".join(map(str, sorted(markdown.fenced_lines(t)))), "lines")
    return df.select("p_partkey", "rest", F.split("lines", ",").cast("array<int>").alias("lines"))


# -- kernels on text


@_query(r"select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '[\t\r\n ]+', ' ', 'g'), ' +([,.;:!?，。；：！？、)])', '\1', 'g'), '([(]) +', '\1', 'g'), chr(32) || chr(9) || chr(10) || chr(13)) as tidy, coalesce(list_max(list_transform(regexp_extract_all(text, '(`+)', 1), lambda x: length(x))), 0)::int as ticks from documents")
def v17_tidy_kernel(spark: SparkSession, d: str) -> DataFrame:
    """The renderer's own functions over all documents."""
    df = table(spark, d, "documents").select("doc_id", "text")
    df = _mapped(_mapped(df, "text", render.tidy, "tidy"), "text", lambda t: str(render.longest_ticks(t)), "ticks")
    return df.select("doc_id", "tidy", F.col("ticks").cast("int").alias("ticks"))


@_query(f"select doc_id, {language.sql('text')} as language from documents")
def v19_language_kernel(spark: SparkSession, d: str) -> DataFrame:
    """The renderer's own guess over all documents."""
    return _mapped(table(spark, d, "documents").select("doc_id", "text"), "text", language.guess, "language").select("doc_id", "language")


@_query("select doc_id, ['`code`  $', 'x_', '$', '|'][doc_id % 4 + 1] as mark, text is not null as there from documents")
def v18_joined(spark: SparkSession, d: str) -> DataFrame:
    """One blank between adjacent formulas, none elsewhere."""
    df = table(spark, d, "documents").select("doc_id", F.element_at(F.array(*map(F.lit, ("`code`  $", "x_", "$", "|"))), (F.col("doc_id") % 4).cast("int") + 1).alias("mark"), F.col("text").isNotNull().alias("there"))
    return _mapped(df, "mark", lambda m: m if render.joined(["$a$", "$b$", m]).startswith("$a$ $b$") and render.joined(["a", m, "c"]) == f"a{m}c" else "wrong", "mark").select("doc_id", "mark", "there")


_NAMES = "«p_name»/«p_brand» __ («p_partkey»)!"


@_query(f"select p_partkey, trim(regexp_replace({_text(_NAMES)}, '[^A-Za-z0-9]+', '-', 'g'), '-') as name, case when p_partkey % 3 = 0 then lpad((p_partkey % 50 + 1)::varchar, 2, '0') || '-Intro' when p_partkey % 3 = 1 then lpad((p_partkey % 50 + 1)::varchar, 2, '0') || '-9999-Intro' else lpad((p_partkey % 50 + 1)::varchar, 2, '0') || '-article-con' end as numbered from part")
def n1_names(spark: SparkSession, d: str) -> DataFrame:
    """Canonical and numbered names."""
    df = spread(table(spark, d, "part")).select("p_partkey", _column(_NAMES).alias("title"), (F.col("p_partkey") % 50 + 1).alias("n"))
    df = pages.package_names(df, "title").withColumnRenamed("package_name", "name")
    title = F.element_at(F.array(F.concat(F.col("n").cast("string"), F.lit(" | Intro")), F.lit("9999 Intro"), F.lit("con")), (F.col("p_partkey") % 3).cast("int") + 1)
    return pages.package_names(df.withColumn("t", title), "t", "n").select("p_partkey", "name", F.col("package_name").alias("numbered"))


# -- images


@_query("""select s_suppkey as page_id, case s_suppkey % 3 when 0 then 8 + s_suppkey % 7 else 0 end as width, case s_suppkey % 3 when 0 then 9 else 0 end as height, s_suppkey % 3 = 2 as fallback, ['no_watermark', '', ''][s_suppkey % 3 + 1] as reason, false as dewatermarked, case s_suppkey % 3 when 0 then 0 else octet_length(encode(s_name)) end::bigint as bytes, case s_suppkey % 3 when 0 then '' else sha256(s_name) end as sha, case s_suppkey % 3 when 2 then 'keep: kept' else 'keep: ' end as entry from supplier""")
def i6_image_processing(spark: SparkSession, d: str) -> DataFrame:
    """Images that pass, have no logo, or can't be read."""

    @F.pandas_udf("binary")
    def drawn(keys):
        return keys.map(lambda k: images.encode_png(np.full((9, 8 + k % 7, 3), 200, np.uint8)))

    k = F.col("s_suppkey") % 3
    df = spread(table(spark, d, "supplier")).select(F.col("s_suppkey").alias("page_id"), F.lit("asset-0001").alias("source_id"), F.when(k == 1, "image/svg+xml").otherwise("image/png").alias("mime"), F.when(k == 0, drawn("s_suppkey")).otherwise(F.encode("s_name", "utf-8")).alias("data"))
    done = image_ops.processed_images(df).persist()  # read twice
    entries = image_ops.image_ledger(done).select("page_id", F.concat("decision", F.lit(": "), F.substring("reason", 1, 4)).alias("entry"))
    same = F.col("mime") == "image/png"
    drawn_one = same & ~F.col("fallback_to_original")
    out = done.select("page_id", "width", "height", F.col("fallback_to_original").alias("fallback"), F.col("validation_reason").alias("reason"), "dewatermarked", F.when(drawn_one, 0).otherwise(F.col("final_bytes")).cast("bigint").alias("bytes"), F.when(drawn_one, "").otherwise(F.sha2("data", 256)).alias("sha"))
    return out.join(entries, "page_id")


# -- documentation pages

_SITE = (
    '<header>h</header><div class="vp-doc"><h1 id="t">«p_name» <a href="#t">#</a></h1><script>x</script><div class="edit-info">edit</div><p>a_b <code>c«p_partkey»</code> <strong>s</strong></p>'
    '<div class="language-js"><button>copy</button><span class="lang">js</span><pre><code>1 &amp;amp; «p_partkey»\n</code></pre></div><table><tr><th>k</th></tr><tr><td>&lt;wbr&gt;&amp;lt;v«p_size»&amp;gt;<br>x</td></tr></table>'
    '<h2>\u200b</h2><figure></figure><p><a href="x"><img src="i"></a></p><ul><li>one</li><li>two<ul><li>in «p_size»</li></ul></li></ul><a class="VPFeature" href="/g/s«p_partkey»"><article class="box"><h3>H</h3><p>d</p></article></a><blockquote><p>q</p></blockquote></div>'
)
_SITE_MD = "# «p_name»\n\na\\_b `c«p_partkey»` **s**\n\n```js\n1 & «p_partkey»\n```\n\n| k |\n| --- |\n| &lt;v«p_size»&gt; x |\n\n- one\n- two\n  - in «p_size»\n\n### H\n\nd\n\n[H](/g/s«p_partkey»)\n\n> q\n"


@_query(f"select p_partkey as page_id, {_text(_SITE_MD)} as markdown, null::varchar as error from part")
def d8_docsite(spark: SparkSession, d: str) -> DataFrame:
    """Documentation pages."""
    return pages.docsite_pages(_pages(spark, d, "part", "p_partkey", _SITE, "<html><body>", "</body></html>"))


@_query("select sum(case when p_partkey % 5 = 0 then 0 else 1 end)::bigint as ok, sum(case when p_partkey % 5 = 0 then 1 else 0 end)::bigint as fail from part")
def k7_totals(spark: SparkSession, d: str) -> DataFrame:
    """One page's failure leaves the others alone."""
    df = pages.docsite_pages(_pages(spark, d, "part", "p_partkey", ["<p>no body «p_partkey»</p>", *["<main><p>«p_name»</p></main>"] * 4], "<html><body>", "</body></html>"))
    return df.agg(F.count_if(F.col("error").isNull()).alias("ok"), F.count_if(F.col("error").isNotNull()).alias("fail"))


_ENTITIES = "&currency«p_partkey» &amp; &#x41;&#66; &notreal; &lt;«p_size»"


@_query(f"select p_partkey, {_text('&currency«p_partkey» & AB &notreal; <«p_size»')} as text from part")
def d3_entities(spark: SparkSession, d: str) -> DataFrame:
    """D3: whole entities only."""
    return _mapped(spread(table(spark, d, "part")).select("p_partkey", _column(_ENTITIES).alias("t")), "t", docsite.decoded, "text").select("p_partkey", "text")


_PICTURES = '<main><p>«s_name»</p><img src="/static/assets/i«s_suppkey».png" alt="a"><img src="b%20«s_suppkey».png" alt="b"><img src="data:image/gif;base64,QUI="><img src="../assets/../../x"></main>'


@_query("""select s_suppkey as page_id, k.* from supplier s, lateral (values ('https://held.example/static/assets/i' || s.s_suppkey || '.png', 'assets/i' || s.s_suppkey || '.png'), ('https://held.example/docs/b%20' || s.s_suppkey || '.png', 'assets/docs/b ' || s.s_suppkey || '.png'), ('data:image/gif;base64,QUI=', 'assets/inline/06d945942aa26a61.gif'), ('https://held.example/x', 'assets/x')) k(url, path)""")
def i12_image_places(spark: SparkSession, d: str) -> DataFrame:
    """Absolute URLs and where each image is kept."""
    return pages.page_images(_pages(spark, d, "supplier", "s_suppkey", _PICTURES, "<html><body>", "</body></html>"), "https://held.example/docs")


@_query("""select s_suppkey as page_id, 'p' || s_suppkey || '.md' as path, s_name || chr(10) || chr(10) || case when s_suppkey % 2 = 0 then '![a](assets/i' || s_suppkey || '.png)' else '*[图片: a]*' end || '*[图片: b]*![](assets/inline/06d945942aa26a61.gif)*[图片]*' || chr(10) as markdown from supplier""")
def i18_local_images(spark: SparkSession, d: str) -> DataFrame:
    """Links to stored images, placeholders for the others."""
    df, base = _pages(spark, d, "supplier", "s_suppkey", _PICTURES, "<html><body>", "</body></html>"), "https://held.example/docs"

    def get(url: str) -> bytes | None:
        m = re.search(r"/i(\d+)\.png$", url)
        return b"x" if m and int(m[1]) % 2 == 0 else None

    found = pages.page_images(df, base).persist()  # read three times
    return pages.localized_pages(df, pages.stored_images(found, get), base, images=found).select("page_id", "path", "markdown")


_PATHS = ["https://x/docs", "https://x/docs/a«p_partkey»/b?q#h", "https://x/docs/a«p_partkey»/", "https://x/docs-old/«p_partkey»"]


@_query(f"select p_partkey, {_text(['index.md', 'a«p_partkey»/b.md', 'a«p_partkey»/index.md', ''], 'p_partkey')} as path from part")
def n3_path_kernel(spark: SparkSession, d: str) -> DataFrame:
    """A page's file below the base; empty outside it."""

    def path(url: str) -> str:
        try:
            return names.page_path(url, "https://x/docs")
        except ValueError:
            return ""

    return _mapped(spread(table(spark, d, "part")).select("p_partkey", _column(_PATHS, "p_partkey").alias("t")), "t", path, "path").select("p_partkey", "path")


# -- ledgers

_LEDGER = """select event_id::varchar as source_id, ['keep', 'remove_as_ui', 'manual_review', 'other'][event_id % 4 + 1] as decision, (event_id // 4 % 3 - (case when event_id % 60 = 59 then 3 else 0 end))::int as emitted_count,
case when event_id // 12 % 2 = 0 then 'why' else ' ' end as reason, case when event_id // 24 % 2 = 0 then '' else 'u' end as decoded_url, event_id // 48 % 2 = 1 as decoded_link_emitted from events"""


@_query(f"""with e as ({_LEDGER}), g as (select *, decision in ('keep', 'remove_as_ui', 'manual_review') as known, decision in ('keep', 'remove_as_ui', 'manual_review') and emitted_count >= 0 as good from e), s as (select event_id::varchar as source_id from events where event_id % 7 <> 0 union all select event_id::varchar from events where event_id % 100 = 1),
x as (select source_id, unnest([case when not known then 'unknown decision' end, case when known and emitted_count < 0 then 'negative emitted_count' end, case when good and decoded_link_emitted and decoded_url = '' then 'decoded link emitted without decoded_url' end,
case when good and decision = 'remove_as_ui' and emitted_count <> 0 then 'removed, yet emitted' end, case when good and decision = 'remove_as_ui' and trim(reason) = '' then 'removed without evidence' end, case when good and decision = 'remove_as_ui' and decoded_link_emitted then 'removed, yet its link was emitted' end,
case when good and decision <> 'remove_as_ui' and emitted_count <> 1 then 'preserved, yet not emitted once' end, case when good and decision = 'manual_review' and trim(reason) = '' then 'manual_review without a reason' end, case when good and decision <> 'remove_as_ui' and decoded_url <> '' and not decoded_link_emitted then 'decoded URL without a link' end]) as t from g)
select 'image ' || source_id || ': ' || t as error from x where t is not null union all select 'duplicate source image id: ' || source_id from s group by source_id having count(*) > 1 union all select 'unexpected source image id: ' || source_id from e where source_id not in (select source_id from s)""")
def i4_image_rules(spark: SparkSession, d: str) -> DataFrame:
    """I4: every rule of the image ledger fires."""
    n = F.col("event_id")
    at = lambda k: F.floor(n / k)
    e = table(spark, d, "events").select(n.cast("string").alias("source_id"), F.element_at(F.array(*map(F.lit, ("keep", "remove_as_ui", "manual_review", "other"))), (n % 4).cast("int") + 1).alias("decision"), (at(4) % 3 - F.when(n % 60 == 59, 3).otherwise(0)).cast("int").alias("emitted_count"), F.when(at(12) % 2 == 0, "why").otherwise(" ").alias("reason"), F.when(at(24) % 2 == 0, "").otherwise("u").alias("decoded_url"), (at(48) % 2 == 1).alias("decoded_link_emitted"))
    src = table(spark, d, "events").select(n.cast("string").alias("source_id"), "event_id")
    return ledgers.image_ledger_errors(e, src.filter("event_id % 7 <> 0").union(src.filter("event_id % 100 = 1")).select("source_id"))


@_query("""with e as (select event_id::varchar as source_id, ['kept', 'removed_as_noise', 'failed', 'manual_review', 'other'][event_id % 5 + 1] as status, (event_id // 5 % 3 - (case when event_id % 45 = 44 then 3 else 0 end))::int as n, case when event_id // 15 % 2 = 0 then 'why' else '' end as reason from events),
x as (select source_id, unnest([case when status = 'other' then 'unknown status' end, case when status <> 'other' and n < 0 then 'negative emitted_count' end, case when status = 'kept' and n >= 0 and n <> 1 then 'kept, yet not emitted once' end, case when status not in ('kept', 'other') and n > 0 then 'not kept, yet emitted' end, case when status not in ('kept', 'other') and n >= 0 and reason = '' then 'not kept without a reason' end]) as t from e)
select 'comment ' || source_id || ': ' || t as error from x where t is not null""")
def i5_comment_rules(spark: SparkSession, d: str) -> DataFrame:
    """Every rule of the comment ledger fires."""
    n = F.col("event_id")
    at = lambda k: F.floor(n / k)
    e = table(spark, d, "events").select(n.cast("string").alias("source_id"), F.element_at(F.array(*map(F.lit, ("kept", "removed_as_noise", "failed", "manual_review", "other"))), (n % 5).cast("int") + 1).alias("status"), (at(5) % 3 - F.when(n % 45 == 44, 3).otherwise(0)).cast("int").alias("emitted_count"), F.when(at(15) % 2 == 0, "why").otherwise("").alias("reason"))
    return ledgers.comment_ledger_errors(e, e.select("source_id"))


@_query("""select p_partkey, sha256('{"brand":"' || p_brand || '","none":null,"size":' || p_size || '}') as fingerprint from part""")
def p3_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """The digest of fields in a fixed order."""
    df = table(spark, d, "part").select("p_partkey", F.col("p_size").alias("size"), F.col("p_brand").alias("brand"), F.lit(None).cast("string").alias("none"))
    return ledgers.fingerprint(df, ["size", "none", "brand"]).select("p_partkey", "fingerprint")


_FOUND = ["", "resume artifact missing or unreadable: preflight/manifest", "resume artifact size mismatch: preflight/content", "resume artifact digest mismatch: formula-results", "resume artifact schema mismatch: preflight/assets", "resume ledger artifact set mismatch", "unsafe resume artifact path: ../x"]


@_query(f"select c_custkey as page_id, {_text(_FOUND, 'c_custkey')} as error from customer")
def p4_artifacts(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with a page's artifacts."""
    made = table(spark, d, "customer").select(F.col("c_custkey").alias("page_id"), F.explode(F.array(*map(F.lit, ledgers.ARTIFACTS))).alias("path"), F.col("c_name").alias("content"), F.lit("1.0").alias("schema_version"))
    k = F.col("page_id") % len(_FOUND)
    ledger = ledgers.artifact_ledger(made)
    ledger = ledger.withColumn("artifacts", F.when(k == 5, F.slice("artifacts", 1, 3)).when(k == 6, F.transform("artifacts", lambda a: a.withField("path", F.when(a["path"] == "preflight/assets", "../x").otherwise(a["path"])))).otherwise(F.col("artifacts")))
    hit = lambda i, path: (k == i) & (F.col("path") == path)
    now = made.filter(~hit(1, "preflight/manifest")).withColumn("content", F.when(hit(2, "preflight/content"), F.concat("content", F.lit("x"))).when(hit(3, "formula-results"), F.translate("content", "C", "c")).otherwise(F.col("content")))
    now = now.withColumn("schema_version", F.when(hit(4, "preflight/assets"), "2.0").otherwise(F.col("schema_version")))
    odd = ledger.filter(k == 6)
    found = ledgers.artifact_errors(ledger.filter(k != 6), now).union(ledgers.artifact_errors(odd, now, tuple("../x" if a == "preflight/assets" else a for a in ledgers.ARTIFACTS)))
    return found.select("page_id", F.coalesce("error", F.lit("")).alias("error"))


_ELIGIBLE = [(_REBUILT, True), ("<p>plain «c_custkey»</p>", False), (_REBUILT + "<p><math><mi>q</mi></math></p>", False), (_REBUILT + "<pre>bare</pre>", False)]


@_query(f"select c_custkey as page_id, {_text([str(b).lower() for _, b in _ELIGIBLE], 'c_custkey')}::boolean as eligible from customer")
def p5_eligible(spark: SparkSession, d: str) -> DataFrame:
    """P5: whose results may serve a later run."""
    df = pages.convert_pages(_pages(spark, d, "customer", "c_custkey", [b for b, _ in _ELIGIBLE]))
    return df.select("page_id", ledgers.resume_eligible(F.col("jobs"), F.col("failures"), pages.count_errors(F.col("counts"), F.col("emitted")), F.col("unresolved")).alias("eligible"))


@_query("""select c_custkey as page_id, r is null as reuse, r as reason from (select c_custkey, case when c_custkey % 5 = 0 then 'resume ledger does not exist' when c_custkey % 5 = 1 then 'resume fingerprint mismatch: source_sha256' when c_custkey % 5 = 2 then 'resume fingerprint mismatch: mode' end as r from customer)""")
def p6_resume_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Whether the last run stands, else the first field that differs."""
    now = table(spark, d, "customer").select(F.col("c_custkey").alias("page_id"), F.sha2("c_name", 256).alias("source_sha256"), F.lit("auto").alias("mode"), F.lit("v6").alias("parser_version"))
    k = F.col("page_id") % 5
    old = now.filter(k != 0).withColumns({"source_sha256": F.when(k == 1, "old").otherwise(F.col("source_sha256")), "mode": F.when(k <= 2, "fast").otherwise(F.col("mode"))})
    return ledgers.resumable(now, old, "page_id")


@_query("select c_custkey as page_id, 1 as full_document, 0 as detached_body, 0 as compact_snapshot, true as timed from customer")
def w2_parse_counts(spark: SparkSession, d: str) -> DataFrame:
    """One parse for each page, and its stages' times."""
    df = pages.convert_pages(_pages(spark, d, "customer", "c_custkey", _REBUILT))
    timed = (F.col("timings.total") >= F.col("timings.preflight") + F.col("timings.formula") - 0.01) & (F.col("timings.preflight") > 0) & (F.col("timings.resume") == 0)
    return df.select("page_id", "parses.*", timed.alias("timed"))


def queries() -> dict:
    return dict(_made)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
