"""The same conversion, incrementally: new pages of a landing folder, each once, the checkpoint in place of a resume ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.pages import convert_pages

PAGES = "page_id bigint, url string, html string"


def landing(spark: SparkSession, path: str, files: int = 64) -> DataFrame:
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files).parquet(path)


def convert_stream(pages: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Converts what has arrived and stops; a batch that is run again replaces its own output."""

    def write(batch: DataFrame, number: int) -> None:
        convert_pages(batch).select("page_id", "status", "reasons", "markdown").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
