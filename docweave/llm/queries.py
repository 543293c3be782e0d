"""The registered queries of this subpackage and their SQL, by name."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ._util import read

#: query -> (module, function, table)
PLAIN = {
    "op3_quality_rules": ("rules", "quality_rules", "documents"),
    "op2_best_fit_packing": ("packing", "best_fit", "documents"),
    "op4_jaccard_join": ("jaccard", "jaccard_join", "documents"),
    "op5_near_vectors": ("vectors", "near_vectors", "embeddings"),
    "op6_katz_scores": ("katz", "katz_scores", "documents"),
    "op7_secret_scan": ("secrets", "secret_scan", "documents"),
    "op8_url_filter": ("links", "url_filter", "pages"),
    "op9_bpe": ("bpe", "encode", "documents"),
    "op10_line_dedup": ("lines", "line_dedup", "documents"),
}


def _plain(module: str, function: str, table: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return getattr(importlib.import_module(f".{module}", __package__), function)(read(spark, sf_dir, table))

    return query


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_classifier

    return quality_classifier(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_quality_classifier": _quality} | {name: _plain(*at) for name, at in PLAIN.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f".{at[0]}", __package__), "SQL", None) for name, at in PLAIN.items()}
    return {name: sql for name, sql in found.items() if sql}
