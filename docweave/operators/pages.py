"""Page conversion: one Arrow-batched kernel per page, everything else relational."""

from __future__ import annotations

import gc
import time

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import docsite, katex, markdown
from ..functions.names import data_uri, image_url, numbered_name, package_name, page_path, safe_path
from ..functions.preflight import Blocked, candidates, preflight
from ..functions.render import COUNTED, Refused, Renderer
from ..functions.tree import Node, parse, released
from ..sources.readers import downloaded
from . import ledgers

COUNTS = "struct<" + ",".join(f"{k}:bigint" for k in (*COUNTED, "formula_total", "formula_unique")) + ">"
FORMULA = "array<struct<ord:int,source_id:string,display:string,source_kind:string,dom_hash:string,original_latex:string,html:string>>"
ASSET = "array<struct<ord:int,source_id:string,tag:string,source_kind:string,source_chars:bigint,alt:string,lazy:boolean>>"
SIGNALS = "struct<notebook:boolean,virtualized_editor:boolean,lazy:bigint,iframes:bigint,stray_scripts:bigint,captions:bigint>"
PREFLIGHT = f"page_id bigint, selector string, title string, signals {SIGNALS}, text_chars bigint, input_bytes bigint, compact_bytes bigint, visible_bytes bigint, reduction_ratio double, counts {COUNTS}, formulas {FORMULA}, assets {ASSET}, strict_reasons array<string>, compact_html string, error string"
NODES = "page_id bigint, node_id int, parent_id int, pre int, post int, depth int, tag string, attrs map<string,string>, classes array<string>, text string"


def _rows(df: DataFrame, kernel, schema: str) -> DataFrame:
    """kernel: from a dict of a row to dicts of rows."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        # Trees are cycles: the collector takes many pages at a time.
        gc.set_threshold(50_000, 10, 10)
        for b in batches:
            # Pages are large: a few at a time.
            for lo in range(0, b.num_rows, 200):
                out = [x for r in b.slice(lo, 200).to_pylist() for x in kernel(r)]
                if out:
                    yield pa.RecordBatch.from_pylist([{k: x.get(k) for k in kinds.names} for x in out], schema=kinds)

    return df.mapInArrow(run, schema)


def node_table(pages: DataFrame) -> DataFrame:
    """Every element of every page, by pre and post order; text is its own strings.  Null HTML has none."""

    def kernel(r: dict):
        if r["html"] is None:
            return
        out: list[dict] = []
        clock = 0

        def enter(n: Node, parent: int | None, depth: int) -> dict:
            nonlocal clock
            clock += 1
            out.append({"page_id": r["page_id"], "node_id": len(out), "parent_id": parent, "pre": clock, "depth": depth, "tag": n.tag, "attrs": list(n.attrs.items()), "classes": n.classes, "text": "".join(c for c in n.children if isinstance(c, str))})
            return out[-1]

        stack = [(c, None, 0, False) for c in reversed(parse(r["html"]).elements())]
        while stack:
            n, parent, depth, over = stack.pop()
            if over:
                clock += 1
                parent["post"] = clock
                continue
            row = enter(n, parent, depth)
            stack.append((n, row, depth, True))
            stack.extend((c, row["node_id"], depth + 1, False) for c in reversed(n.elements()))
        yield from out

    return _rows(pages.select("page_id", "html"), kernel, NODES)


def preflights(pages: DataFrame) -> DataFrame:
    """A row for each page; where the body can't be chosen, only error is set."""

    def kernel(r: dict):
        try:
            p = preflight(r["html"] or "")
        except Blocked as bad:
            yield {"page_id": r["page_id"], "error": str(bad)}
            return
        released(p.pop("every"))
        yield {"page_id": r["page_id"], **{k: v for k, v in p.items() if k not in ("root", "nodes")}}

    return _rows(pages.select("page_id", "html"), kernel, PREFLIGHT)


def semantic_candidates(pages: DataFrame) -> DataFrame:
    """page_id, kind, idx, semantic_id, source_dom_id, representation, priority of the compacted bodies."""

    def kernel(r: dict):
        root = next(iter(parse(r["compact_html"]).elements()), None)
        if root is not None:
            for kind in ("table", "codeblock", "list", "list_item"):
                for c in candidates(root, kind):
                    yield {"page_id": r["page_id"], **c}

    src = preflights(pages).filter("error is null").select("page_id", "compact_html")
    return _rows(src, kernel, "page_id bigint, kind string, idx int, semantic_id string, source_dom_id string, representation string, priority int")


def canonical_candidates(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One candidate for each (keys, semantic_id): that of least priority, then of least idx; ``first_idx`` is the order in which the identities appear."""
    by = [*(keys or []), "semantic_id"]
    rest = [c for c in df.columns if c not in by]
    best = df.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct("priority", "idx")).alias("best"), F.min("idx").alias("first_idx"))
    return best.select(*by, *(F.col(f"best.{c}").alias(c) for c in rest), "first_idx")


def count_errors(expected: Column, emitted: Column) -> Column:
    """Fields that were emitted in another number than was found."""
    one = lambda k: F.when(expected[k] != emitted[k], F.concat(F.lit(f"{k}: expected "), expected[k].cast("string"), F.lit(", emitted "), emitted[k].cast("string")))
    return F.array_compact(F.array(*(one(k) for k in (*COUNTED, "formula_total"))))


JOB = "array<struct<source_id:string,dom_hash:string,latex:string,source_ids:array<string>>>"
FAILURE = "array<struct<source_id:string,dom_hash:string,source_kind:string,unknown_nodes:array<string>>>"
STATS = "formula_total formula_unique cache_hits cache_written parsed_unique resolved failures pending_validation validation_jobs validation_html_written validation_nodes_saved browser_batches_planned".split()
TIMES = "resume preflight snapshot formula validation conversion package total".split()
IMAGE = "array<struct<source_id:string,decision:string,emitted_count:int,reason:string,bytes:bigint>>"
#: What one pass over a page gives.  ``sure`` has the Markdown and the counts as they are once the jobs are confirmed.
STAGED = (
    f"page_id bigint, title string, package string, strict array<string>, counts {COUNTS}, signals {SIGNALS}, input_bytes bigint, compact_bytes bigint, latex boolean, jobs {JOB}, failures {FAILURE}, new_hashes array<struct<dom_hash:string,latex:string,success:boolean,unknown_nodes:array<string>>>, "
    f"stats struct<{','.join(f'{k}:bigint' for k in STATS)}>, draft struct<markdown:string,emitted:{COUNTS},unresolved:array<string>>, sure struct<markdown:string,emitted:{COUNTS},unresolved:array<string>>, "
    f"warnings array<string>, files array<struct<name:string,data:binary>>, images {IMAGE}, timings struct<{','.join(f'{k}:double' for k in TIMES)}>, parses struct<full_document:int,detached_body:int,compact_snapshot:int>"
)
#: A cache or list of LaTeX of up to so many rows goes to every task; a larger one is joined by page and hash.
KNOWN_ROWS = 100_000


_read: dict[str, tuple[str | None, list[str]]] = {}


def _rebuilt(html: str) -> tuple[str | None, list[str]]:
    """LaTeX of a KaTeX element, or None with what wasn't understood; of the same markup once."""
    known = _read.get(html)
    if known is None:
        latex, unknown = katex.latex_of(next(iter(parse(html).elements())))
        known = (None, ["identifier-subscript"]) if latex and katex.bare_identifier(latex) else (latex, unknown)
        if len(_read) >= 2_000:
            _read.clear()
        _read[html] = known
    return known


def _resolved(formulas: list[dict], known: dict, given: dict) -> tuple[dict, dict]:
    """By hash: LaTeX, success, what wasn't understood, and where it came from.  known: the cache's entries; given: LaTeX by source_id from elsewhere."""
    found, counts = {}, {"cache_hits": 0, "parsed_unique": 0}
    for f in formulas:
        h = f["dom_hash"]
        if h in found:
            continue
        own = given.get(f["source_id"])
        if own:
            found[h] = (own, True, [], "given")
        elif h in known:
            latex, success = known[h]
            found[h] = (latex, bool(success), [], "cache")
            counts["cache_hits"] += 1
        elif f["original_latex"].strip():
            found[h] = (f["original_latex"].strip(), True, [], "original")
        elif f["source_kind"] != "katex-html-only":
            found[h] = (None, False, [f"unsupported-source:{f['source_kind']}"], "none")
        else:
            latex, unknown = _rebuilt(f["html"])
            found[h] = (latex, latex is not None, unknown, "parsed")
            counts["parsed_unique"] += 1
    return found, counts


def _rendered(root: Node, p: dict, latex: dict[str, str], package: str) -> tuple[dict, Renderer]:
    m = Renderer(root, p["formulas"], p["assets"], latex, package, p["nodes"])
    text = m.page(root)
    return {"markdown": text, "emitted": m.counts | {"formula_total": m.counts["formula_block"] + m.counts["formula_inline"]}, "unresolved": m.unresolved}, m


def _converted(r: dict, known: dict, strict: bool) -> dict:
    """One parse of the page, and everything that follows from it."""
    began = last = time.perf_counter()
    times = dict.fromkeys(TIMES, 0.0)

    def clock(name: str) -> float:
        nonlocal last
        now = time.perf_counter()
        times[name], last = round(1000 * (now - last), 3), now
        return now

    out = {"page_id": r["page_id"], "package": f"page-{r['page_id']}", "parses": {"full_document": 1, "detached_body": 0, "compact_snapshot": 0}, "timings": times}
    try:
        p = preflight(r["html"] or "", False)
    except Blocked as bad:
        clock("preflight")
        times["total"] = times["preflight"]
        return {**out, "strict": [str(bad)] + ["strict mode explicitly requested"] * strict}
    try:
        return _staged(r, p, out, known, strict, clock, began)
    finally:
        released(p["every"])


def _staged(r: dict, p: dict, out: dict, known: dict, strict: bool, clock, began: float) -> dict:
    """What follows from a page's preflight."""
    times, last = out["timings"], clock("preflight")
    if p["title"]:
        out["package"] = package_name(p["title"])
    out |= {k: p[k] for k in ("title", "counts", "signals", "input_bytes", "compact_bytes")}
    out["latex"] = any(f["original_latex"] for f in p["formulas"])
    why = p["strict_reasons"] + ["strict mode explicitly requested"] * strict
    if why:
        times["total"] = round(1000 * (last - began), 3)
        return {**out, "strict": why}
    given = {x["source_id"]: x["latex"] for x in r.get("resolved") or [] if x["latex"]}
    mine = {x["dom_hash"]: (x["latex"], x["success"]) for x in r.get("cached") or []}
    found, seen = _resolved(p["formulas"], known | mine, given)
    jobs: dict[str, dict] = {}
    failures, latex, unsure = [], {}, {}
    for f in p["formulas"]:
        text, success, unknown, origin = found[f["dom_hash"]]
        if not success or not text:
            failures.append({k: f[k] for k in ("source_id", "dom_hash", "source_kind")} | {"unknown_nodes": unknown})
        elif f["source_kind"] == "katex-html-only" and origin != "given":
            unsure[f["source_id"]] = text
            split = katex.mapping(text)
            jobs.setdefault(f["dom_hash"], {"source_id": f["source_id"], "dom_hash": f["dom_hash"], "latex": split[0] if split else text, "source_ids": []})["source_ids"].append(f["source_id"])
        else:
            latex[f["source_id"]] = text
    clock("formula")
    fresh = [{"dom_hash": h, "latex": x[0], "success": x[1], "unknown_nodes": x[2]} for h, x in found.items() if x[3] not in ("cache", "given")]
    out |= {
        "jobs": list(jobs.values()), "failures": failures, "new_hashes": fresh,
        "stats": seen | {"formula_total": len(p["formulas"]), "formula_unique": len(found), "cache_written": int(bool(fresh)), "resolved": len(latex), "failures": len(failures), "pending_validation": len(unsure), "validation_jobs": len(jobs), "validation_html_written": 1, "validation_nodes_saved": len(unsure) - len(jobs), "browser_batches_planned": int(bool(jobs))},
    }
    # What the page itself doesn't spell out is open until it is confirmed; original LaTeX stays.
    try:
        out["draft"], m = _rendered(p["root"], p, latex, out["package"])
        out["sure"] = _rendered(p["root"], p, latex | unsure, out["package"])[0] if unsure else None
    except (Refused, Blocked, markdown.Fence) as bad:
        last = clock("conversion")
        times["total"] = round(1000 * (last - began), 3)
        return {**out, "strict": [str(bad)]}
    clock("conversion")
    out |= {"strict": [], "warnings": m.warnings, "files": [{"name": n, "data": d} for n, d in m.files], "images": [{"source_id": n.rpartition(".")[0], "decision": "keep", "emitted_count": 1, "reason": "", "bytes": len(d)} for n, d in m.files]}
    last = clock("package")
    times["total"] = round(1000 * (last - began), 3)
    return out


def staged_pages(pages: DataFrame, resolved: DataFrame | None = None, mode: str = "auto", cache: DataFrame | None = None) -> DataFrame:
    """One Arrow kernel over the pages, without a join where nothing is given from elsewhere.  cache: dom_hash, latex, success (of this parser version); resolved: page_id, source_id, latex."""
    if mode not in ("auto", "fast", "strict"):
        raise ValueError(f"mode {mode}: auto, fast or strict")
    src, known, strict = pages.select("page_id", "html"), {}, mode == "strict"
    if resolved is not None:
        own = resolved.groupBy(F.col("page_id").alias("_p")).agg(F.collect_list(F.struct("source_id", "latex")).alias("resolved"))
        src = src.join(own, F.col("page_id") == F.col("_p"), "left").drop("_p")
    if cache is not None:
        own = cache.filter(F.col("parser_version") == katex.PARSER_VERSION) if "parser_version" in cache.columns else cache
        own = own.groupBy("dom_hash").agg(F.first("latex").alias("latex"), F.first("success").alias("success"))
        rows = own.limit(KNOWN_ROWS + 1).collect()  # once: what makes the cache may be a pass over pages
        if len(rows) <= KNOWN_ROWS:
            known = {x["dom_hash"]: (x["latex"], x["success"]) for x in rows}
        else:  # the pages' hashes must be known first: one more pass
            hits = formula_rows(preflights(pages)).select("page_id", "dom_hash").distinct().join(own, "dom_hash").groupBy(F.col("page_id").alias("_p")).agg(F.collect_list(F.struct("dom_hash", "latex", "success")).alias("cached"))
            src = src.join(hits, F.col("page_id") == F.col("_p"), "left").drop("_p")
    sent = pages.sparkSession.sparkContext.broadcast(known)

    def kernel(r: dict):
        yield _converted(r, sent.value, strict)

    return _rows(src, kernel, STAGED)


def pending_jobs(staged: DataFrame) -> DataFrame:
    """source_id, dom_hash, latex, pages, source_ids: what a browser must still confirm, once for each hash of all pages; a source_id names its page."""
    j = staged.filter("size(strict) = 0").select("page_id", F.explode("jobs").alias("j")).withColumn("id", F.concat(F.lit("page-"), F.col("page_id").cast("string"), F.lit("/"), F.col("j.source_id")))
    best = F.min_by(F.struct("id", F.col("j.latex").alias("latex")), F.struct("page_id", "j.source_id"))
    df = j.groupBy(F.col("j.dom_hash").alias("dom_hash")).agg(best.alias("b"), F.count(F.lit(1)).alias("pages"), F.sum(F.size("j.source_ids")).alias("formulas"))
    return df.select(F.col("b.id").alias("source_id"), "dom_hash", F.col("b.latex").alias("latex"), "pages", "formulas")


def convert_pages(pages: DataFrame, resolved: DataFrame | None = None, mode: str = "auto", cache: DataFrame | None = None, report: DataFrame | None = None, versions: dict[str, str] | None = None, staged: DataFrame | None = None) -> DataFrame:
    """page_id, package, status (converted, blocked, strict_required), reasons, markdown and what was counted.

    Formulas that had to be rebuilt stay placeholders, and block their page, until a validation report confirms the batch: all
    of its jobs or none.  Without a report the pages are parsed once; with one the first pass is kept while it is checked.
    staged: that pass, where it was made (and is kept) for the report.
    """
    df = staged_pages(pages, resolved, mode, cache) if staged is None else staged
    unlocked, message = F.lit(False), F.lit(None).cast("string")
    if report is not None:
        df = df if df.is_cached else df.persist()
        said = ledgers.report_unlocks(pending_jobs(df).select("source_id", "dom_hash", "latex"), report, versions or {}).agg(F.bool_and("unlocked").alias("_ok"), F.first("message").alias("_said"))
        df = df.crossJoin(F.broadcast(said))  # one row
        unlocked, message = F.coalesce("_ok", F.lit(False)), F.col("_said")
    own = F.when(unlocked & F.col("sure").isNotNull(), F.col("sure")).otherwise(F.col("draft"))
    df = df.withColumn("_own", own).withColumn("emitted", F.col("_own.emitted"))
    failed, waiting = F.size(F.coalesce("failures", F.array())), F.when(unlocked, 0).otherwise(F.coalesce(F.col("stats.pending_validation"), F.lit(0)))
    open_ = F.size(F.coalesce("_own.unresolved", F.array()))
    say = lambda n, text: F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {text}")))
    blockers = F.concat(
        F.coalesce(count_errors(F.col("counts"), F.col("emitted")), F.array().cast("array<string>")),
        F.array_compact(F.array(say(failed, "formula parse failures"), say(waiting, "formulas await batch KaTeX validation"), F.when(waiting > 0, message), F.when((failed == 0) & (waiting == 0), say(open_, "formulas require batch resolution")))),
    )
    refused = F.size("strict") > 0
    df = df.withColumn("_block", F.when(refused, F.array().cast("array<string>")).otherwise(blockers))
    status = F.when(refused, "strict_required").when(F.size("_block") > 0, "blocked").otherwise("converted")
    stats = F.when(~refused, F.col("stats").withField("resolved", F.col("stats.resolved") + F.when(unlocked, F.col("stats.pending_validation")).otherwise(0)).withField("pending_validation", waiting.cast("bigint")))
    keep = lambda c: F.when(~refused, F.col(c))
    return df.select(
        "page_id", "title", "package", status.alias("status"), F.concat("strict", "_block").alias("reasons"), keep("_own.markdown").alias("markdown"), "counts", "signals", F.when(~refused, F.col("emitted")).alias("emitted"), keep("_own.unresolved").alias("unresolved"),
        stats.alias("formula_batch"), keep("failures").alias("failures"), keep("jobs").alias("jobs"), complexity(F.col("counts"), F.col("latex")).alias("complexity"), keep("warnings").alias("warnings"), "input_bytes", "compact_bytes", keep("files").alias("files"), keep("images").alias("images"), "timings", "parses",
    )


def new_cache_entries(staged: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """dom_hash, latex, success, unknown_nodes, parser_version, target_platform, validation of what the pass found out and the cache doesn't have."""
    df = staged.select(F.explode("new_hashes").alias("n")).groupBy("n.dom_hash").agg(F.first("n").alias("n")).select("n.*")
    df = df.withColumns({"parser_version": F.lit(katex.PARSER_VERSION), "target_platform": F.lit("github"), "validation": F.lit("not_validated")})
    return df if cache is None else ledgers.merge_cache(cache, df, ["dom_hash"])


def complexity(counts: Column, original_latex: Column) -> Column:
    rich = (counts["images"] > 0) | (counts["codeblocks"] > 0) | (counts["tables"] > 0)
    return F.when(counts["formula_total"] == 0, F.when(rich, 1).otherwise(0)).otherwise(F.when(original_latex, 2).otherwise(3))


# -- formulas


def formula_rows(pre: DataFrame) -> DataFrame:
    return pre.select("page_id", F.explode("formulas").alias("f")).select("page_id", "f.*")


def resolve_formulas(rows: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """LaTeX once for each hash: the original, else what the cache has, else what KaTeX's HTML gives; dom_hash, latex, success, unknown_nodes."""
    one = rows.groupBy("dom_hash").agg(F.min_by(F.struct("original_latex", "source_kind", "html"), F.struct("page_id", "ord")).alias("f")).select("dom_hash", "f.*")
    if cache is not None:
        known = cache.filter(F.col("parser_version") == katex.PARSER_VERSION).select("dom_hash", F.col("latex").alias("_latex"), F.col("success").alias("_success"))
        one = one.join(known.dropDuplicates(["dom_hash"]), "dom_hash", "left")
    else:
        one = one.withColumns({"_latex": F.lit(None).cast("string"), "_success": F.lit(None).cast("boolean")})

    def kernel(r: dict):
        if r["original_latex"]:
            yield {**r, "latex": r["original_latex"], "success": True, "unknown_nodes": []}
        elif r["_success"] is not None:
            yield {**r, "latex": r["_latex"], "success": r["_success"], "unknown_nodes": []}
        elif r["source_kind"] != "katex-html-only":
            yield {**r, "latex": None, "success": False, "unknown_nodes": [f"unsupported-source:{r['source_kind']}"]}
        else:
            latex, unknown = _rebuilt(r["html"])
            yield {**r, "latex": latex, "success": latex is not None, "unknown_nodes": unknown}

    return _rows(one, kernel, "dom_hash string, source_kind string, latex string, success boolean, unknown_nodes array<string>")


def validation_jobs(rows: DataFrame, resolved: DataFrame) -> DataFrame:
    """What a browser must still confirm: one job for each rebuilt hash with the ids that it stands for."""
    rebuilt = resolved.filter("success and source_kind = 'katex-html-only'").select("dom_hash", "latex")
    ids = F.array_sort(F.collect_list(F.struct("page_id", "ord", "source_id")))
    return rows.join(rebuilt, "dom_hash").groupBy("dom_hash", "latex").agg(ids.alias("ids")).select("dom_hash", "latex", F.get("ids", F.lit(0))["source_id"].alias("source_id"), F.transform("ids", lambda x: x["source_id"]).alias("source_ids"))


# -- names, documentation pages, Markdown gate


def package_names(df: DataFrame, title: str, ordinal: str | None = None) -> DataFrame:
    """Adds package_name (numbered where an ordinal column is given)."""

    @F.pandas_udf("string")
    def plain(titles: pd.Series) -> pd.Series:
        return titles.map(package_name, na_action="ignore")

    @F.pandas_udf("string")
    def numbered(titles: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else numbered_name(t, int(k)) for t, k in zip(titles, n, strict=True)])

    return df.withColumn("package_name", plain(title) if ordinal is None else numbered(title, ordinal))


def docsite_pages(pages: DataFrame, selector: str | None = None) -> DataFrame:
    """page_id, markdown or error of every page; one page's failure leaves the others alone."""

    def kernel(r: dict):
        try:
            yield {"page_id": r["page_id"], "markdown": docsite.page_markdown(r["html"] or "", selector)}
        except ValueError as bad:
            yield {"page_id": r["page_id"], "error": str(bad)}

    return _rows(pages.select("page_id", "html"), kernel, "page_id bigint, markdown string, error string")


def postprocess(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, markdown (all rules applied), changed, residual (formula placeholders left), error (a fence that isn't closed) for every row."""

    def kernel(r: dict):
        if r["t"] is None:
            yield {"k": r["k"]}
            return
        try:
            new = markdown.postprocessed(r["t"])
            yield {"k": r["k"], "markdown": new, "changed": new != r["t"], "residual": len(markdown.placeholders(new))}
        except markdown.Fence as bad:
            yield {"k": r["k"], "error": str(bad)}

    out = _rows(df.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t")), kernel, "k bigint, markdown string, changed boolean, residual bigint, error string")
    return out.withColumnRenamed("k", key)


def fence_blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """A row for each closed block, or one with error."""

    def kernel(r: dict):
        try:
            for b in markdown.fences(r["t"] or ""):
                yield {"k": r["k"], **b}
        except markdown.Fence as bad:
            yield {"k": r["k"], "error": str(bad)}

    out = _rows(df.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t")), kernel, "k bigint, start_line int, end_line int, marker string, marker_length int, blockquote_depth int, container_indent int, error string")
    return out.withColumnRenamed("k", key)


def gate(df: DataFrame, key: str, text: str, apply: bool = False) -> DataFrame:
    """key, code, changed, residual, error: 0 where nothing would change (or all was applied), 1 where something would, or a placeholder is left, 2 where the text can't be read."""
    p = postprocess(df, key, text)
    bad = F.col("error").isNotNull() | F.col("markdown").isNull()
    code = F.when(bad, 2).when((F.col("changed") & F.lit(not apply)) | (F.col("residual") > 0), 1).otherwise(0)
    return p.select(key, code.alias("code"), "changed", "residual", "error", *(["markdown"] if apply else []))


def exit_code(gated: DataFrame) -> int:
    return gated.agg(F.max("code")).first()[0] or 0


def residual_placeholders(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, line, placeholder: formulas left outside fences."""

    def kernel(r: dict):
        try:
            for line, found in markdown.placeholders(r["t"] or ""):
                yield {"k": r["k"], "line": line, "placeholder": found}
        except markdown.Fence:
            return

    return _rows(df.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t")), kernel, "k bigint, line bigint, placeholder string").withColumnRenamed("k", key)


# -- images of documentation pages


def page_images(pages: DataFrame, base: str) -> DataFrame:
    """page_id, url, path: the images of the pages (page_id, url, html), absolute, with the place where each is kept; path is null where that would be outside the folder."""

    def kernel(r: dict):
        try:
            body = docsite.body_of(parse(r["html"] or "", page=False))
        except ValueError:
            return
        for n in body.all("img"):
            if whole := image_url(n.get("src"), r["url"] or base):
                yield {"page_id": r["page_id"], "url": whole, "path": safe_path(whole)}

    return _rows(pages.select("page_id", "url", "html"), kernel, "page_id bigint, url string, path string")


def clashing_images(images: DataFrame) -> DataFrame:
    """path, urls: places that several URLs would be kept at."""
    return images.filter("path is not null").select("path", "url").distinct().groupBy("path").agg(F.array_sort(F.collect_list("url")).alias("urls")).filter("size(urls) > 1")


def stored_images(images: DataFrame, get=None) -> DataFrame:
    """url, path, data of every image that could be had, each fetched once; a data URI brings its own bytes.  Two URLs of one path are an error."""
    bad = clashing_images(images).limit(1).collect()
    if bad:
        raise ValueError(f"images clash at {bad[0]['path']}: {', '.join(bad[0]['urls'])}")
    get = get or downloaded

    def kernel(r: dict):
        data = None
        if r["path"] is not None:
            if r["url"].startswith("data:"):
                try:
                    data = data_uri(r["url"])[1]
                except ValueError:
                    data = None
            else:
                data = get(r["url"])
        yield {**r, "data": data}

    one = images.select("url", "path").distinct()
    return _rows(one.repartition("url"), kernel, "url string, path string, data binary")


def localized_pages(pages: DataFrame, stored: DataFrame, base: str, selector: str | None = None, images: DataFrame | None = None) -> DataFrame:
    """page_id, path, markdown or error: images that are stored get a link to their file, others a placeholder with their text.  images: the pages' images, where they are kept."""
    have = (page_images(pages, base) if images is None else images).join(stored.filter("data is not null").select("url").distinct(), "url").groupBy(F.col("page_id").alias("_p")).agg(F.collect_set("url").alias("have"))
    src = pages.select("page_id", "url", "html").join(have, F.col("page_id") == F.col("_p"), "left").drop("_p")

    def kernel(r: dict):
        have = set(r["have"] or ())
        try:
            file = page_path(r["url"] or base, base)
            yield {"page_id": r["page_id"], "path": file, "markdown": docsite.page_markdown(r["html"] or "", selector, r["url"] or base, file, have.__contains__)}
        except ValueError as bad:
            yield {"page_id": r["page_id"], "error": str(bad)}

    return _rows(src, kernel, "page_id bigint, path string, markdown string, error string")
