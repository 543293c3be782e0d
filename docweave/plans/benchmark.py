"""The conversion's benchmark: style-heavy pages with repeated formulas, in two scenarios and three kinds of passes.

``original``: every formula has its LaTeX.  ``rebuilt``: formulas are KaTeX's HTML only, so the cold pass leaves validation jobs.
Passes: ``cold`` with an empty cache; ``validation`` (rebuilt only) with the report that confirms the jobs; ``warm``
with the cache of the cold pass, as often as asked for.  Work counts are the contract; times are those of the stages.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pages
from ..sources.readers import synthetic

#: Each page must lose this share of its bytes.
REDUCTION = 0.8
STAGES = pages.TIMES
WORK = ("formula_total", "formula_unique", "cache_hits", "cache_written", "parsed_unique", "pending_validation", "validation_jobs", "validation_nodes_saved")


def confirmed(jobs: DataFrame) -> DataFrame:
    """The report of a browser that rendered every job."""
    items = jobs.agg(F.collect_list(F.struct("source_id", "dom_hash", "latex")).alias("items"))  # of the unique formulas of the input
    n = F.size("items")
    return items.select("items", n.alias("total"), n.alias("passed"), F.lit(True).alias("runtime_loaded"), F.lit(True).alias("completed"), F.lit("0.16").alias("katex_version"), F.array().cast("array<string>").alias("failures"))


def run(spark: SparkSession, n: int = 1, iterations: int = 3, styles: int = 600, style_bytes: int = 1024, formulas: int = 168, unique: int = 12) -> list[dict]:
    """A record for each scenario and pass: pages by status, work counts summed over pages, median stage times, wall time, least reduction."""
    if iterations < 2:
        raise ValueError("one cold and at least one warm pass")
    out: list[dict] = []
    for scenario in ("original", "rebuilt"):
        src = synthetic(spark, n, styles, style_bytes, formulas, unique, rebuilt=scenario == "rebuilt").persist()
        src.count()

        def measured(name: str, scenario: str = scenario, src: DataFrame = src, **given) -> None:
            began = time.perf_counter()
            df = pages.convert_pages(src, **given)
            row = df.agg(
                F.count(F.lit(1)).alias("pages"), F.count_if(F.col("status") == "converted").alias("converted"), F.min(1 - F.col("compact_bytes") / F.col("input_bytes")).alias("reduction"),
                *(F.sum(f"formula_batch.{k}").alias(k) for k in WORK), *(F.median(f"timings.{k}").alias(f"{k}_ms") for k in STAGES), *(F.sum(f"parses.{k}").alias(k) for k in ("full_document", "detached_body", "compact_snapshot")),
            ).first()
            out.append({"scenario": scenario, "pass": name, "wall_s": round(time.perf_counter() - began, 3), **row.asDict()})

        staged = pages.staged_pages(src)
        cache = pages.new_cache_entries(staged).select("dom_hash", "latex", "success", "parser_version").persist()
        measured("cold")
        if scenario == "rebuilt":
            measured("validation", cache=cache, report=confirmed(pages.pending_jobs(staged)))
        for k in range(1, iterations):
            measured(f"warm {k}", cache=cache)
        cache.unpersist()
        src.unpersist()
    return out


def conserved(records: list[dict]) -> list[str]:
    """What is wrong with the records' work counts; nothing where the contract holds."""
    wrong = []
    for r in records:
        at, cold = f"{r['scenario']}, {r['pass']}: ", r["pass"] == "cold"
        checks = {
            "snapshot reduction": r["reduction"] >= REDUCTION,
            "one parse for each page": r["full_document"] == r["pages"] and not r["detached_body"] and not r["compact_snapshot"],
            "cache writes": r["cache_written"] == (r["pages"] if cold else 0),
            "cache hits": r["cache_hits"] == (0 if cold else r["formula_unique"]),
            "status": r["converted"] == (r["pages"] if r["scenario"] == "original" or r["pass"] == "validation" else 0),
            "jobs": r["validation_jobs"] == (r["formula_unique"] if r["scenario"] == "rebuilt" else 0),
            "nodes saved": r["validation_nodes_saved"] == (r["formula_total"] - r["formula_unique"] if r["scenario"] == "rebuilt" else 0),
        }
        wrong += [at + k for k, ok in checks.items() if not ok]
    return wrong
