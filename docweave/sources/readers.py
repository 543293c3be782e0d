"""Sources: page tables, saved HTML files, URL lists, sitemaps, fetched pages, reports, caches."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AGENT = "docweave/0.1"
REPORT = "schema_version string, parser_version string, validator_version string, katex_version string, runtime_loaded boolean, completed boolean, total int, passed int, failures array<struct<source_id:string,dom_hash:string,latex:string,error:string>>, items array<struct<source_id:string,dom_hash:string,latex:string>>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a task of the kernels, and the most tasks; beyond that a task gets more rows.
TASK_ROWS, MOST_TASKS = 2_000, 2_000


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The same rows in even tasks (by keys, where some are given).  Short rows come as one row group, hence as one task, however long a kernel takes with each; take this before they grow to pages."""
    tasks = min(MOST_TASKS, -(-df.count() // TASK_ROWS))  # of a Parquet table, its footers say it
    return df.repartition(tasks, *keys) if tasks > 1 else df


def html_files(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256, html (null where it isn't UTF-8), error."""
    df = spark.read.format("binaryFile").load(path)
    good = F.is_valid_utf8(F.col("content").cast("string"))
    return df.select("path", F.sha2("content", 256).alias("sha256"), F.when(good, F.col("content").cast("string")).alias("html"), F.when(~good, F.lit("not valid UTF-8")).alias("error"))


def url_file(spark: SparkSession, path: str) -> DataFrame:
    """ord, url of the lines that aren't blank."""
    df = spark.read.option("wholetext", True).text(path)
    return df.select(F.posexplode(F.split("value", r"\r?\n")).alias("ord", "url")).withColumn("url", F.trim("url")).filter("url <> ''")


def http_get(url: str, timeout: int = 30, retries: int = 3, pause: float = 1.5) -> str:
    """Text of a page; client errors end at once, others are tried again after a growing pause."""
    for k in range(retries):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": AGENT}), timeout=timeout) as got:  # noqa: S310
                return got.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as bad:
            if bad.code < 500 or k + 1 == retries:
                raise
        except OSError:
            if k + 1 == retries:
                raise
        time.sleep(pause * (k + 1))
    raise OSError(url)


#: An image of more bytes is skipped.
IMAGE_BYTES = 50 << 20


def downloaded(url: str, timeout: int = 30, delay: float = 0.0, most: int = IMAGE_BYTES) -> bytes | None:
    """An image's bytes; None where it can't be had or is too large, so that one image fails by itself."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": AGENT}), timeout=timeout) as got:  # noqa: S310
            data = got.read(most + 1)  # one more than allowed: what a header says of the length isn't sure
    except (OSError, ValueError):
        return None
    if delay:
        time.sleep(delay)
    return data if len(data) <= most else None


def fetched(urls: DataFrame, get: Callable[[str], str] = http_get) -> DataFrame:
    """ord, url, html, error; the transport is a parameter, and one failure leaves the rest alone."""

    def run(batches):
        for b in batches:
            html, error = [], []
            for u in b.column(1).to_pylist():
                try:
                    html.append(get(u)), error.append(None)
                except Exception as bad:  # reported in its row
                    html.append(None), error.append(f"{type(bad).__name__}: {bad}")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(html, pa.string()), pa.array(error, pa.string())], names=["ord", "url", "html", "error"])

    return urls.select(F.col("ord").cast("bigint").alias("ord"), "url").mapInArrow(run, "ord bigint, url string, html string, error string")


def sitemap(url: str, get: Callable[[str], str] = http_get, depth: int = 0) -> list[str]:
    """Page URLs of a sitemap; an index is followed to five levels."""
    root = ElementTree.fromstring(get(url))  # noqa: S314
    found = [e.text.strip() for e in root.iter() if e.tag.rpartition("}")[2] == "loc" and e.text]
    if root.tag.rpartition("}")[2] != "sitemapindex":
        return found
    if depth > 5:
        raise ValueError(f"sitemap index nested too deeply: {url}")
    return [page for child in found for page in sitemap(child, get, depth + 1)]


def sitemap_frame(spark: SparkSession, url: str, get: Callable[[str], str] = http_get) -> DataFrame:
    return spark.createDataFrame(list(enumerate(sitemap(url, get))), "ord bigint, url string")


def validation_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REPORT).option("multiLine", True).json(path)


def formula_cache(spark: SparkSession, path: str, parser_version: str, platform: str = "github") -> DataFrame:
    return spark.read.parquet(path).filter((F.col("parser_version") == parser_version) & (F.col("target_platform") == platform))


def synthetic(spark: SparkSession, n: int, styles: int = 600, style_bytes: int = 1024, formulas: int = 168, unique: int = 12, rebuilt: bool = False) -> DataFrame:
    """page_id, url, html: style-heavy saved pages with repeated formulas, with their LaTeX or (rebuilt) as KaTeX's HTML only."""
    css = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(styles)), lambda i: F.concat(F.lit("<style>.s"), i.cast("string"), F.lit("{"), F.rpad(F.lit(""), style_bytes, "a:b;"), F.lit("}</style>"))), "")
    before, after = ('<span class="katex"><span class="katex-html"><span class="mord">x', "</span></span></span>") if rebuilt else ('<span class="katex" data-tex="x_{', '}">x</span>')
    body = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(formulas - 1)), lambda i: F.concat(F.lit("<p>Paragraph "), i.cast("string"), F.lit(f" with {before}"), (i % unique).cast("string"), F.lit(f"{after} in its text.</p>"))), "")
    return spark.range(n).select(F.col("id").alias("page_id"), F.concat(F.lit("https://example.org/"), F.col("id").cast("string")).alias("url"), F.concat(F.lit("<html><head>"), css, F.lit("</head><body><article><h1>Page</h1>"), body, F.lit("</article></body></html>")).alias("html"))
