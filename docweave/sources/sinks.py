"""Sinks: Spark's commit protocol makes each write all or nothing."""

from __future__ import annotations

import hashlib
import io
import json
import os
import tempfile
import zipfile
from html import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def archive(files: list[tuple[str, bytes]]) -> bytes:
    """A ZIP whose bytes depend on names and contents only."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in sorted(files):
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.external_attr, info.compress_type = 0o644 << 16, zipfile.ZIP_DEFLATED
            z.writestr(info, data)
    return out.getvalue()


def packages(converted: DataFrame) -> DataFrame:
    """page_id, package, zip of every converted page, under its canonical name."""

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 100):
                rows = b.slice(lo, 100).to_pylist()
                zips = [archive([(f"{r['package']}/{r['package']}.md", r["markdown"].encode())] + [(f"{r['package']}/files/{r['package']}/{f['name']}", f["data"]) for f in r["files"] or []]) for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array([r["page_id"] for r in rows], pa.int64()), pa.array([r["package"] for r in rows], pa.string()), pa.array(zips, pa.binary())], names=["page_id", "package", "zip"])

    return converted.filter("status = 'converted'").select("page_id", "package", "markdown", "files").mapInArrow(run, "page_id bigint, package string, zip binary")


def reports(converted: DataFrame) -> DataFrame:
    """page_id, report: the whole status document as JSON."""
    known = ("status", "package", "title", "reasons", "counts", "signals", "emitted", "unresolved", "warnings", "images", "failures", "jobs", "formula_batch", "complexity", "input_bytes", "compact_bytes", "timings")
    return converted.select("page_id", F.to_json(F.struct(F.lit("1.0").alias("schema_version"), *(c for c in known if c in converted.columns))).alias("report"))


def write_preflight(pre: DataFrame, path: str) -> None:
    """The four artifacts of the pages' first look: content, manifest, formulas, assets; an earlier one is replaced."""
    good = pre.filter("error is null")
    good.select("page_id", F.col("compact_html").alias("content")).write.mode("overwrite").parquet(f"{path}/content")
    manifest = F.struct(F.lit("1.0").alias("schema_version"), "title", "selector", "text_chars", "input_bytes", "compact_bytes", "visible_bytes", "reduction_ratio", "counts", "signals", "strict_reasons", F.when(F.size("strict_reasons") > 0, "strict").otherwise("fast").alias("recommended_mode"))
    good.select("page_id", F.to_json(manifest).alias("manifest")).write.mode("overwrite").parquet(f"{path}/manifest")
    for name in ("formulas", "assets"):
        good.select("page_id", F.explode(name).alias("x")).select("page_id", "x.*").write.mode("overwrite").parquet(f"{path}/{name}")


def write_corpus(converted: DataFrame, path: str) -> None:
    """Markdown, reports, assets, and the images as they came, as tables below path; an earlier delivery is replaced."""
    converted.select("page_id", "package", "markdown").filter("markdown is not null").write.mode("overwrite").parquet(f"{path}/markdown")
    reports(converted).write.mode("overwrite").parquet(f"{path}/reports")
    files = converted.select("page_id", "package", F.explode("files").alias("f")).select("page_id", F.concat("package", F.lit("/files/"), "package", F.lit("/"), "f.name").alias("path"), "f.data")
    files.write.mode("overwrite").parquet(f"{path}/assets")
    files.select("page_id", F.regexp_replace("path", "^([^/]+)/files/[^/]+/", "$1__images_orig/").alias("path"), "data").write.mode("overwrite").parquet(f"{path}/originals")


def append_cache(new: DataFrame, path: str) -> None:
    """Only where there is something new."""
    if not new.isEmpty():
        new.write.mode("append").parquet(path)


def validation_document(jobs: list[dict], katex: str = "katex.min.js") -> str:
    """A page on which a browser renders every job once and offers the report; the same jobs give the same bytes."""
    items = "\n".join(f'<div class="job" data-source-id="{escape(j["source_id"])}" data-hash="{escape(j["dom_hash"])}" data-latex="{escape(j["latex"])}"></div>' for j in sorted(jobs, key=lambda j: j["source_id"]))
    script = "const failures=[];document.querySelectorAll('.job').forEach(e=>{try{katex.render(e.dataset.latex,e,{throwOnError:true})}catch(x){failures.push({source_id:e.dataset.sourceId,error:String(x)})}});window.report={completed:true,runtime_loaded:true,failures};"
    return f'<!doctype html>\n<meta charset="utf-8">\n<script src="{escape(katex)}"></script>\n<body>\n{items}\n<script>{script}</script>\n</body>\n'


def validation_documents(jobs: DataFrame, size: int = 5000) -> DataFrame:
    """batch, html: jobs (source_id, dom_hash, latex) by the thousand, each batch a page of its own; no job reaches the driver."""

    def run(t: pa.Table) -> pa.Table:
        return pa.table({"batch": t.column("batch").slice(0, 1), "html": [validation_document(t.to_pylist())]})

    n = max(1, -(-jobs.count() // size))
    return jobs.select(F.pmod(F.xxhash64("dom_hash"), F.lit(n)).alias("batch"), "source_id", "dom_hash", "latex").groupBy("batch").applyInArrow(run, "batch bigint, html string")


def _replaced(path: str, data: bytes) -> None:
    """The file is there whole or not at all, and keeps its mode."""
    fd, new = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    try:
        with os.fdopen(fd, "wb") as out:
            out.write(data)
            out.flush()
            os.fsync(out.fileno())
        os.chmod(new, os.stat(path).st_mode & 0o777 if os.path.exists(path) else 0o644)
        os.replace(new, path)
    except BaseException:
        os.unlink(new)
        raise


def write_if_changed(path: str, text: str) -> bool:
    """Whether the file was written: one with the same bytes stays untouched."""
    data = text.encode()
    if os.path.exists(path):
        with open(path, "rb") as old:
            if hashlib.sha256(old.read()).digest() == hashlib.sha256(data).digest():
                return False
    _replaced(path, data)
    return True


def write_json(path: str, payload: dict) -> None:
    _replaced(path, (json.dumps(payload, ensure_ascii=False, indent=2, sort_keys=True) + "\n").encode())


def copy_runtime(source: str, folder: str) -> str:
    """The formula renderer beside the validation pages; an error where it isn't there, before anything is written."""
    with open(source, "rb") as f:
        data = f.read()
    if not data:
        raise ValueError(f"{source} is empty")
    path = os.path.join(folder, os.path.basename(source))
    _replaced(path, data)
    return path
