"""The registered queries of the library and their SQL counterparts.

Names begin with the id of the operator that they show.  Where the given tables have no such rows as an
operator works on (ledgers, reports), a query takes the columns of another table for them; the SQL does the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.markdown import CJK
from ..functions.preflight import EDITOR, NOTEBOOK
from ..operators import ledgers, pages, text
from ..sources.readers import table
from . import benchmark, held

_made: dict = {}
_sql: dict[str, str] = {}


def _query(sql: str | None = None):
    def keep(f):
        _made[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return keep


# -- pages through the kernel


#: The given pages hold one article of a heading and paragraphs, the first of them bold and left open.
_PAGE = r"""a as (select page_id, html, regexp_extract(html, '(?s)<article>(.*?)(?:</article>|$)', 1) as art from pages),
b as (select page_id, unnest(regexp_split_to_array(art, '</?(?:p|h1)>')) as s, unnest(range(len(regexp_split_to_array(art, '</?(?:p|h1)>')))) as k from a),
c as (select page_id, k, contains(s, '<b>') as bold, regexp_replace(replace(replace(replace(regexp_replace(s, '</?(?:b|br)>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;?', '&', 'g') as s from b),
x as (select page_id, trim(regexp_replace(string_agg(s, ' ' order by k), '[ \t\r\n]+', ' ', 'g')) as words from c group by page_id),
d as (select page_id, k, bold, trim(regexp_replace(regexp_replace(regexp_replace(s, '[\t\r\n ]+', ' ', 'g'), ' +([,.;:!?，。；：！？、)])', '\1', 'g'), '([(]) +', '\1', 'g')) as s from c),
e as (select page_id, k, case when k = 1 then '# ' || s when bold then '**' || s || '**' else s end as s from d where s <> ''),
m as (select page_id, replace(string_agg(s, chr(10) || chr(10) order by k), '****', '') || chr(10) as markdown from e group by page_id),
o as (select a.page_id, html, art, coalesce(words, '') as words, length(coalesce(words, '')) >= 80 as found, markdown from a left join x using (page_id) left join m using (page_id))"""
_NONE = "no unique semantic body found; strict inspection is required"


@_query(f"with {_PAGE} select case when found then 'converted' else 'strict_required' end as status, case when not found then '{_NONE}' end as reason, count(*) as pages from o group by all")
def page_outcome(spark: SparkSession, d: str) -> DataFrame:
    """Outcome of the page conversion by status and reason."""
    df = pages.convert_pages(table(spark, d, "pages"))
    return df.select("status", F.explode_outer("reasons").alias("reason")).groupBy("status", "reason").agg(F.count(F.lit(1)).alias("pages"))


@_query(f"with {_PAGE} select page_id, case when found then 'converted' else 'strict_required' end as status, case when not found then '{_NONE}' end as reason, case when found then markdown end as markdown, octet_length(encode(html))::bigint as input_bytes from o")
def v1_page_markdown(spark: SparkSession, d: str) -> DataFrame:
    """The given pages, recovered from what they leave open."""
    df = pages.convert_pages(table(spark, d, "pages"))
    own = table(spark, d, "pages").select("page_id", F.octet_length("html").cast("bigint").alias("input_bytes"))
    return df.select("page_id", "status", F.get("reasons", F.lit(0)).alias("reason"), "markdown").join(own, "page_id")


@_query(f"with {_PAGE} select page_id, case when found then 'article' end as selector, case when found then length(words) end::bigint as text_chars, case when found then octet_length(encode(html)) end::bigint as input_bytes, case when found then octet_length(encode(words)) end::bigint as visible_bytes, case when found then len(regexp_extract_all(art, '<h1>')) end::bigint as headings, case when found then 0 end::bigint as images, case when found then 0 end::bigint as formula_total, case when not found then '{_NONE}' end as error from o")
def b2_page_preflight(spark: SparkSession, d: str) -> DataFrame:
    """What the given pages hold."""
    return pages.preflights(table(spark, d, "pages")).select("page_id", "selector", "text_chars", "input_bytes", "visible_bytes", "counts.headings", "counts.images", "counts.formula_total", "error")


@_query("with t as (select page_id, unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1)) as tag from pages) select tag, count(*) as nodes, count(distinct page_id) as pages from t group by tag")
def b1_node_tags(spark: SparkSession, d: str) -> DataFrame:
    """B1, M2: the node table."""
    n = pages.node_table(table(spark, d, "pages"))
    return n.groupBy("tag").agg(F.count(F.lit(1)).alias("nodes"), F.countDistinct("page_id").alias("pages"))


@_query(f"with {_PAGE} select page_id, 'article' as top, len(regexp_extract_all(art, '<[a-zA-Z]'))::bigint as below from o where regexp_matches(art, '<[a-zA-Z]')")
def r6_ancestor_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Containment by pre and post order: how many elements lie below each page's body candidates."""
    n = pages.node_table(table(spark, d, "pages"))
    top = n.filter("tag in ('article', 'main')").select(F.col("page_id").alias("p"), F.col("pre").alias("a"), F.col("post").alias("z"), F.col("tag").alias("top"))
    return n.join(top, (F.col("page_id") == F.col("p")) & (F.col("pre") > F.col("a")) & (F.col("post") < F.col("z"))).groupBy("page_id", "top").agg(F.count(F.lit(1)).alias("below"))


@_query()
def d8_docsite_markdown(spark: SparkSession, d: str) -> DataFrame:
    return pages.docsite_pages(table(spark, d, "pages"))


@_query("select count(*) filter (where regexp_matches(html, '<article>')) as ok, count(*) filter (where not regexp_matches(html, '<article>')) as fail from pages")
def k7_corpus_totals(spark: SparkSession, d: str) -> DataFrame:
    df = pages.docsite_pages(table(spark, d, "pages"))
    return df.agg(F.count_if(F.col("error").isNull()).alias("ok"), F.count_if(F.col("error").isNotNull()).alias("fail"))


@_query()
def p0_postprocess(spark: SparkSession, d: str) -> DataFrame:
    return pages.postprocess(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "markdown", "changed", "residual", "error")


# -- expressions, held against SQL


@_query("select page_id, sha256(html) as fingerprint, cast(octet_length(encode(html)) as bigint) as input_bytes, cast(length(html) as bigint) as chars from pages")
def s1_page_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.sha2("html", 256).alias("fingerprint"), F.octet_length("html").cast("bigint").alias("input_bytes"), F.length("html").cast("bigint").alias("chars"))


def _any(col: str, words) -> str:
    return "(" + " or ".join(f"contains(lower({col}), '{w}')" for w in words) + ")"


@_query(f"with {_PAGE} select page_id, case when found then {_any('html', NOTEBOOK)} end as notebook, case when found then {_any('html', EDITOR)} end as virtualized_editor, case when found then 0 end::bigint as lazy from o")
def r1_strict_markers(spark: SparkSession, d: str) -> DataFrame:
    """The signals of the given pages."""
    return pages.preflights(table(spark, d, "pages")).select("page_id", "signals.notebook", "signals.virtualized_editor", "signals.lazy")



@_query(r"select doc_id, trim(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g')) as normalized from documents")
def b3_normalized_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.normalized(F.col("text")).alias("normalized"))




@_query("select doc_id, coalesce(list_max(list_transform(regexp_extract_all(text, '(`+)', 1), lambda x: length(x))), 0)::int as ticks, coalesce(list_max(list_transform(regexp_extract_all(text, '(\\$+)', 1), lambda x: length(x))), 0)::int as dollars from documents".replace("\\\\", "\\"))
def v20_longest_run(spark: SparkSession, d: str) -> DataFrame:
    dollars = F.coalesce(F.array_max(F.transform(F.regexp_extract_all("text", F.lit(r"(\$+)"), 1), F.length)), F.lit(0))
    return table(spark, d, "documents").select("doc_id", text.longest_ticks(F.col("text")).alias("ticks"), dollars.alias("dollars"))


@_query("""with l as (select doc_id, unnest(string_split(text, chr(10))) as line from documents),
s as (select doc_id, line, trim(line, chr(32) || chr(9) || chr(13)) as s from l),
p as (select doc_id, case when length(s) > 2 and starts_with(s, '$') and ends_with(s, '$') and not contains(substr(s, 2, length(s) - 2), '$') and trim(substr(s, 2, length(s) - 2)) <> '' then '$$' || substr(s, 2, length(s) - 2) || '$$' else line end as new, line from s)
select doc_id, count(*) as lines, count(*) filter (where new <> line) as promoted, sum(length(new))::bigint as chars from p group by doc_id""")
def p6_promoted_formulas(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line")).withColumn("new", text.promoted(F.col("line")))
    return df.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("new") != F.col("line")).alias("promoted"), F.sum(F.length("new")).cast("bigint").alias("chars"))


@_query(rf"""with t as (select doc_id, regexp_replace(regexp_replace(text, chr(160) || '\$', ' $', 'g'), '\$' || chr(160), '$ ', 'g') as a from documents),
u as (select doc_id, regexp_replace(regexp_replace(a, ' {{2,}}\$', ' $', 'g'), '\$ {{2,}}', '$ ', 'g') as a from t)
select doc_id, replace(a, '****', '') as text from u where not regexp_matches(a, '[{CJK}]')""")
def p2_dollar_spacing(spark: SparkSession, d: str) -> DataFrame:
    """All documents.  The SQL leaves out those with CJK, whose two replacements it lacks; the given tables have none."""
    return table(spark, d, "documents").select("doc_id", F.replace(text.dollar_spacing(F.col("text")), F.lit("****"), F.lit("")).alias("text"))




@_query("select ord, url from (select page_id as ord, trim(url) as url from pages) where url <> '' and not contains(url, 'blog') and not contains(url, '?') order by ord limit 20")
def s5_url_list(spark: SparkSession, d: str) -> DataFrame:
    """Skipped parts and the first N in order, as asked for on the command line."""
    return text.url_list(table(spark, d, "pages").select(F.col("page_id").alias("ord"), "url"), ["blog", "?"], 20)


# -- relational operators


@_query("""with c as (select user_id as semantic_id, event_id as idx, event_type as representation, case when event_type = 'click' then 0 else 10 end as priority from events),
r as (select *, row_number() over (partition by semantic_id order by priority, idx) as nth, min(idx) over (partition by semantic_id) as first_idx from c)
select semantic_id, idx, representation, priority, first_idx from r where nth = 1""")
def r7_canonical_candidates(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "events").select(F.col("user_id").alias("semantic_id"), F.col("event_id").alias("idx"), F.col("event_type").alias("representation"), F.when(F.col("event_type") == "click", 0).otherwise(10).alias("priority"))
    return ledgers_order(pages.canonical_candidates(df))


def ledgers_order(df: DataFrame) -> DataFrame:
    return df.select("semantic_id", "idx", "representation", "priority", "first_idx")



@_query("select doc_id, lang, source from (select doc_id, lang, source, row_number() over (partition by doc_id order by source) as nth from documents) n where nth = 1 and doc_id not in (select doc_id from labels where doc_id is not null)")
def f6_cache_merge(spark: SparkSession, d: str) -> DataFrame:
    """Entries that the cache (labels) doesn't have."""
    return ledgers.merge_cache(table(spark, d, "labels"), table(spark, d, "documents").select("doc_id", "lang", "source"), ["doc_id"])


_LEDGER = "select doc_id::varchar as source_id, case when toxic = 1 then 'remove_as_ui' else 'keep' end as decision, quality as emitted_count from labels"


@_query(f"""with e as ({_LEDGER}), s as (select doc_id::varchar as source_id from documents),
k as (select distinct source_id from e), x as (
select 'image ' || source_id || ': removed, yet emitted' as error from e where decision = 'remove_as_ui' and emitted_count <> 0
union all select 'image ' || source_id || ': removed without evidence' from e where decision = 'remove_as_ui'
union all select 'image ' || source_id || ': preserved, yet not emitted once' from e where decision = 'keep' and emitted_count <> 1
union all select 'duplicate image source_id: ' || source_id from e group by source_id having count(*) > 1
union all select 'duplicate source image id: ' || source_id from s group by source_id having count(*) > 1
union all select 'missing source image id: ' || source_id from (select distinct source_id from s) where source_id not in (select source_id from k)
union all select 'unexpected source image id: ' || source_id from k where source_id not in (select source_id from s)) select error from x""")
def i4_image_ledger(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("source_id"), F.when(F.col("toxic") == 1, "remove_as_ui").otherwise("keep").alias("decision"), F.col("quality").alias("emitted_count"), F.lit("").alias("reason"), F.lit("").alias("decoded_url"), F.lit(False).alias("decoded_link_emitted"))
    return ledgers.image_ledger_errors(e, table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("source_id")))


@_query("""with e as (select doc_id::varchar as source_id, case when quality = 1 then 'kept' else 'failed' end as status, quality as emitted_count, case when toxic = 1 then 'toxic' else '' end as reason from labels),
s as (select doc_id::varchar as source_id from documents), k as (select distinct source_id from e)
select 'comment ' || source_id || ': not kept without a reason' as error from e where status = 'failed' and reason = ''
union all select 'duplicate comment source_id: ' || source_id from e group by source_id having count(*) > 1
union all select 'duplicate source comment id: ' || source_id from s group by source_id having count(*) > 1
union all select 'missing source comment id: ' || source_id from (select distinct source_id from s) where source_id not in (select source_id from k)
union all select 'unexpected source comment id: ' || source_id from k where source_id not in (select source_id from s)""")
def i5_comment_ledger(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("source_id"), F.when(F.col("quality") == 1, "kept").otherwise("failed").alias("status"), F.col("quality").alias("emitted_count"), F.when(F.col("toxic") == 1, "toxic").otherwise("").alias("reason"))
    return ledgers.comment_ledger_errors(e, table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("source_id")))


@_query("""select event_id as n, in_body, related, qr, in_ui, decorative, case when not (in_body or related) and (in_ui or (not qr and decorative)) then 'remove_as_ui' when qr and not (in_body or related) then 'manual_review' else 'keep' end as decision
from (select event_id, event_id % 2 = 1 as in_body, event_id // 2 % 2 = 1 as related, event_id // 4 % 2 = 1 as qr, event_id // 8 % 2 = 1 as in_ui, event_id // 16 % 2 = 1 as decorative from events)""")
def i3_image_decision(spark: SparkSession, d: str) -> DataFrame:
    bit = lambda k: F.floor(F.col("event_id") / k) % 2 == 1
    df = table(spark, d, "events").select(F.col("event_id").alias("n"), *(bit(k).alias(c) for k, c in ((1, "in_body"), (2, "related"), (4, "qr"), (8, "in_ui"), (16, "decorative"))))
    return df.withColumn("decision", ledgers.decide_image(*(F.col(c) for c in ("in_body", "related", "qr", "in_ui", "decorative"))))


@_query("""with e as (select o_orderkey as k, count(*) as lines, sum(l_linenumber)::bigint as numbers from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey), a as (select l_orderkey as k, max(l_linenumber)::bigint as lines, sum(l_linenumber)::bigint as numbers from lineitem group by l_orderkey),
f as (select k, 'lines' as field, lines as v from e union all select k, 'numbers', numbers from e), g as (select k, 'lines' as field, lines as v from a union all select k, 'numbers', numbers from a)
select coalesce(f.k, g.k) as k, coalesce(f.field, g.field) as field, f.v as expected, g.v as actual from f full join g on f.k = g.k and f.field = g.field where f.v is distinct from g.v""")
def r12_conservation(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    e = table(spark, d, "orders").join(li, F.col("l_orderkey") == F.col("o_orderkey"), "left").groupBy(F.col("o_orderkey").alias("k")).agg(F.count(F.lit(1)).alias("lines"), F.sum("l_linenumber").alias("numbers"))
    a = li.groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_linenumber").cast("bigint").alias("lines"), F.sum("l_linenumber").alias("numbers"))
    return ledgers.conservation(e, a, "k", ["lines", "numbers"])


@_query("select lang as output, list_sort(list(distinct source)) as packages from documents group by lang having count(distinct source) > 1")
def r14_collisions(spark: SparkSession, d: str) -> DataFrame:
    return ledgers.collisions(table(spark, d, "documents").select(F.col("lang").alias("output"), F.col("source").alias("package")))



@_query("select event_type as scenario, count(*) as passes, median(value) as median_ms, round(avg(value), 6) as mean_ms, min(value) as least_ms, max(value) as most_ms from events group by event_type")
def w1_medians(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col("event_type").alias("scenario")).agg(F.count(F.lit(1)).alias("passes"), F.median("value").alias("median_ms"), F.round(F.avg("value"), 6).alias("mean_ms"), F.min("value").alias("least_ms"), F.max("value").alias("most_ms"))



@_query("""with p as (select count(*) as n from supplier), k(scenario, pass, hits, written, jobs, saved, converted) as (values ('original', 'cold', 0, 1, 0, 0, 1), ('original', 'warm 1', 3, 0, 0, 0, 1), ('rebuilt', 'cold', 0, 1, 3, 9, 0), ('rebuilt', 'validation', 3, 0, 3, 9, 1), ('rebuilt', 'warm 1', 3, 0, 3, 9, 0))
select scenario, pass, n::bigint as pages, (converted * n)::bigint as converted, (hits * n)::bigint as cache_hits, (written * n)::bigint as cache_written, (jobs * n)::bigint as validation_jobs, (saved * n)::bigint as validation_nodes_saved, n::bigint as full_document from p, k""")
def w1_benchmark(spark: SparkSession, d: str) -> DataFrame:
    """The benchmark's work counts, with as many pages as there are suppliers."""
    records = benchmark.run(spark, table(spark, d, "supplier").count(), 2, 20, 768, 12, 3)
    if wrong := benchmark.conserved(records):
        raise ValueError("; ".join(wrong))
    keep = "scenario pass pages converted cache_hits cache_written validation_jobs validation_nodes_saved full_document".split()
    return spark.createDataFrame([tuple(r[k] for k in keep) for r in records], "scenario string, pass string, " + ", ".join(f"{k} bigint" for k in keep[2:]))


def queries() -> dict:
    return _made | held.queries()


def oracle_sql() -> dict[str, str]:
    return _sql | held.oracle_sql()
