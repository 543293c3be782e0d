"""The corpus pipeline: quality rules, line de-duplication, near-duplicate removal, secret redaction, packing.

Every stage takes (spark, docs, sf_dir) and returns the documents that it keeps, as it leaves them;
the last returns the packed pieces.  Each stage's result is written as Parquet and read again as
the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docweave.llm import jaccard, lines, packing, rules, secrets
from docweave.llm._util import drop_scratch, read, scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.  Null and empty texts go; repeated rows get one verdict; a null language is judged by the nearest reference; an empty table stays empty."""
    return rules.keep_good(docs)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later occurrences of repeated windows of lines.  Null text stays null, a text of which all lines go becomes empty; the first in the order of doc_id (null first), text hash and position stays."""
    return lines.dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of lowest doc_id (null first, then by the hash of the text), once even where its row is repeated.  Texts without words all stay."""
    return jaccard.keep_one(docs)


def secret_values(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked.  Null text stays null; repeated rows are treated alike."""
    return secrets.redact_secrets(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """bin_id, doc_id, piece, start, n_words.  Texts without words have a null bin; ties of length go by doc_id (null first); an empty table gives no rows."""
    return packing.best_fit(docs)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", repeated_lines),
    ("jaccard_join", near_duplicates),
    ("secret_scan", secret_values),
    ("best_fit_packing", packed),
]

#: The secrets' guess costs and the packing have no SQL form; tests hold run() against the stages' brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, last = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        df = scratch(stage(spark, df, sf_dir), f"pipeline-{name}")
        if last is not None:
            drop_scratch(last)
        last = df
    return STAGES[-1][1](spark, df, sf_dir)
