"""How the work of the page kernels is cut and how often it is done."""

import pandas as pd
import pytest
from docweave.functions import tree
from docweave.operators import pages
from docweave.plans import catalog, held
from docweave.sources import readers
from pyspark.sql import functions as F
from test_pages import KATEX, page

SF = "/root/testdata/sf0.001"
#: Queries whose tables come as one row group; each is a finding of round 2.
SPREAD = "d8_docsite f11_validation_jobs f12_confirmed_pages f7_katex k11_cache_entries p5_eligible v5_lists w2_parse_counts f6_cache_hits v11_tables v3_headings_paragraphs v8_quotes_marks r9_page_complexity f14_batch_stats b8_sizes r11_refusals f4_canonical_hash r14_package_collisions v9_code_blocks i2_assets i6_image_processing k7_totals i18_local_images".split()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", SPREAD)
def test_kernels_get_even_tasks(spark, monkeypatch, name):
    """One row group isn't one task: short rows are spread before they grow to pages."""
    monkeypatch.setattr(readers, "TASK_ROWS", 4, raising=False)
    plan = plan_of(catalog.queries()[name](spark, SF))
    assert "MapInArrow" in plan and "REPARTITION_BY_NUM" in plan
    spark.catalog.clearCache()


def test_spread(spark, monkeypatch):
    df = spark.range(4_001).coalesce(1)
    assert readers.spread(df).rdd.getNumPartitions() == 3 and readers.spread(df.limit(9)).rdd.getNumPartitions() == 1 and readers.spread(df.limit(0)).count() == 0
    sizes = [r["n"] for r in readers.spread(df).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 4_001 and max(sizes) - min(sizes) <= 1
    monkeypatch.setattr(readers, "MOST_TASKS", 2)
    assert readers.spread(df).rdd.getNumPartitions() == 2 and readers.spread(df).distinct().count() == 4_001


def passes(spark, make):
    """How often a table's rows are computed while make() uses it."""
    seen = spark.sparkContext.accumulator(0)

    def kernel(batches):
        for b in batches:
            seen.add(len(b))
            yield pd.DataFrame({"dom_hash": ["h"] * len(b), "latex": ["x"] * len(b), "success": [True] * len(b)})

    make(spark.range(1).mapInPandas(kernel, "dom_hash string, latex string, success boolean"))
    return seen.value


def test_cache_is_read_once(spark):
    df = spark.createDataFrame([(1, page(KATEX.format("z")))], "page_id bigint, html string")
    assert passes(spark, lambda cache: pages.staged_pages(df, cache=cache)) == 1


def test_staged_pass_serves_jobs_and_pages(spark):
    """A report over pages whose pass is kept needs no second one, and says the same."""
    df = spark.createDataFrame([(1, page(KATEX.format("z"))), (2, page("<p>x</p>"))], "page_id bigint, html string")
    staged = pages.staged_pages(df).persist()
    j = pages.pending_jobs(staged).collect()
    report = spark.createDataFrame([("0.16", True, True, 1, 1, [], [{k: x[k] for k in ("source_id", "dom_hash", "latex")} for x in j])], "katex_version string, runtime_loaded boolean, completed boolean, total int, passed int, failures array<string>, items array<struct<source_id:string,dom_hash:string,latex:string>>")
    rows = lambda out: [(r["page_id"], r["status"], r["markdown"]) for r in out.orderBy("page_id").collect()]
    got = pages.convert_pages(df, report=report, staged=staged)
    assert rows(got) == rows(pages.convert_pages(df, report=report)) and rows(got)[0][1] == "converted"
    staged.unpersist()


PLAIN = [
    "<p>a<p class='x' class=\"y\">b &amp; c&lt</p></p><br/><td><td>x<li>y<li>z</ul>", "<!DOCTYPE html><html><!-- c --><body>t<!-- d -->u</body>", "<script type=a>if (a<b) '</p>'</SCRIPT >x<style>p{}</style>", "<input disabled><img src='data:,x' data-n=1><svg/><path d='m'/>q<div/>r",
    "<span data-q=\"a>b &quot;c&quot;\" style='top: 1em'>&notit; &#x41; &</span>", "<table><tr><td>1<table><tr><td>2</table><td>3", "", "text & only", "</p></x>a", held.HEAD + held._REBUILT + held.TAIL,
]
ODD = ["<P>a</P>", "a < b", "<p", "<a href=/x>", "<x-y>a</x-y>", "<!-- open", "<script>a", "<p a = 'x'>", "<? php ?>", "</ p>", "<p a>", "<script/>x"]


def built(html, whole):
    b = tree._Builder(whole)
    b.feed(html)
    b.close()
    return [(n.path(), n.attrs, list(n.attrs), n.children and [c for c in n.children if isinstance(c, str)]) for n in b.root.walk()], b.root.html()


@pytest.mark.parametrize("html", PLAIN + ODD)
def test_plain_markup(html):
    """One pass of a pattern gives the tree that the tokenizer gives; what isn't plain is left to the tokenizer."""
    for whole in (True, False):
        assert (tree._plain(html, whole) is None) == (html in ODD)
        root = tree.parse(html, whole)
        assert ([(n.path(), n.attrs, list(n.attrs), n.children and [c for c in n.children if isinstance(c, str)]) for n in root.walk()], root.html()) == built(html, whole)
