"""Image processing over tables: binary in, binary and ledger out."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import images
from ..functions.names import extension

DONE = (
    "page_id bigint, source_id string, data binary, mime string, width int, height int, dewatermarked boolean, bbox array<int>, validation_passed boolean, validation_reason string, "
    "compressed boolean, orig_bytes bigint, final_bytes bigint, format_note string, fallback_to_original boolean"
)

BATCH_BYTES = 4 << 20


def processed_images(files: DataFrame, max_width: int = images.MAX_WIDTH) -> DataFrame:
    """files: page_id, source_id, mime, data.  One image at a time in memory, and results of up to BATCH_BYTES; null data gives an empty fallback."""
    kinds = to_arrow_schema(StructType.fromDDL(DONE))

    def run(batches):
        for b in batches:
            ready, held = [], 0
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                out = images.processed(r["data"] or b"", r["mime"] or "", max_width)
                ready.append({**{k: r[k] for k in ("page_id", "source_id")}, **out})
                held += len(out["data"] or b"")
                if held >= BATCH_BYTES or len(ready) == 1_000:
                    yield pa.RecordBatch.from_pylist(ready, schema=kinds)
                    ready, held = [], 0
            if ready:
                yield pa.RecordBatch.from_pylist(ready, schema=kinds)

    return files.select("page_id", "source_id", "mime", "data").mapInArrow(run, DONE)


def page_files(converted: DataFrame) -> DataFrame:
    """page_id, source_id, mime, data of the images that conversion took out of its pages."""
    f = converted.select("page_id", F.explode("files").alias("f"))
    kinds = {e: m for m, e in (("image/png", ".png"), ("image/jpeg", ".jpg"), ("image/gif", ".gif"), ("image/webp", ".webp"), ("image/svg+xml", ".svg"))}
    tail = F.regexp_extract("f.name", r"(\.[a-z]+)$", 1)
    mime = F.lit("application/octet-stream")
    for e, m in kinds.items():
        mime = F.when(tail == e, m).otherwise(mime)
    return f.select("page_id", F.regexp_extract("f.name", r"^(.*)\.[a-z]+$", 1).alias("source_id"), mime.alias("mime"), F.col("f.data").alias("data"))


def image_ledger(done: DataFrame) -> DataFrame:
    """One entry for each image, for image_ledger_errors: processed ones are kept, with what was done as the reason."""
    reason = F.when(F.col("fallback_to_original"), F.concat(F.lit("kept as it was: "), "format_note")).when(F.col("dewatermarked"), "corner logo removed").otherwise("")
    return done.select("page_id", "source_id", F.lit("keep").alias("decision"), F.lit(1).alias("emitted_count"), reason.alias("reason"), F.lit("").alias("decoded_url"), F.lit(False).alias("decoded_link_emitted"), "bbox", "dewatermarked", "validation_passed", "orig_bytes", "final_bytes", "format_note", "fallback_to_original")


__all__ = ["extension", "image_ledger", "page_files", "processed_images"]
