"""What the operators share: scratch tables in the cluster's folder, slicing of Arrow batches, word hashing."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``; a temporary one only where that is unset and all runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="docweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            jvm = spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session is gone already; the cluster's own cleaning of the folder remains
            return


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def scratch(df: DataFrame, name: str, rows: int | None = None, size: int | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and the loss of an executor costs nothing.  Its shuffle files go as soon as it is written.

    rows, size: how many rows and bytes go to a Python worker at once, where the session would have more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    own = {CLEANUP: "true"}
    for key, most in zip(BATCH, (rows, size), strict=True):
        given = int(re.match("-?[0-9]+", spark.conf.get(key))[0]) if most else 0
        if most and not 0 < given <= most:
            own[key] = str(most)
    before = {key: spark.conf.get(key) if key in BATCH else spark.conf.get(key, "false") for key in own}
    for key, value in own.items():
        spark.conf.set(key, value)
    try:
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(df: DataFrame) -> None:
    """Deletes a scratch table that no later plan reads."""
    spark = df.sparkSession
    for i, (_, path) in enumerate(_made):
        if any(f.startswith(path) or path.split(":", 1)[-1] in f for f in df.inputFiles()[:1]):
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
            del _made[i]
            return


#: A table of up to so many rows of a few numbers each goes to every executor; a larger one is joined by shuffling.
SIDE_ROWS = 500_000


def side(df: DataFrame) -> DataFrame:
    """The given table, which must be a written one of short rows, broadcast if it is small, else with a hint not to sort the other side."""
    return F.broadcast(df) if df.count() <= SIDE_ROWS else df.hint("shuffle_hash")


def slices(batches: Iterator, text: str = "text", chars: int = 2_000_000) -> Iterator:
    """Cuts Arrow batches into runs of rows of about so many characters, so that Python objects of one run fit beside the JVM; a text itself is never cut."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size.astype(np.int64))
        at = 0
        while at < n:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + chars, side="right")))
            yield batch.slice(at, to - at)
            at = to


class Words(dict):
    """64-bit hashes of words, remembered; forgets everything beyond a number of words, so memory has a bound and results don't change."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        self[word] = value = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value

    def of(self, words: list[str]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def release() -> None:
    """Gives memory that a kernel no longer uses back to the machine: a Python worker lives on, and the next stage's JVM needs the room."""
    pa.set_memory_pool(pa.system_memory_pool())  # the default one keeps what it has freed
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of n nodes with edges (a, b), the least that each is linked with, directly or through others."""
    label = np.arange(n)
    while True:
        la, lb = label[a], label[b]
        least = np.minimum(la, lb)
        new = label.copy()
        np.minimum.at(new, la, least)
        np.minimum.at(new, lb, least)
        while not np.array_equal(short := new[new], new):
            new = short
        if np.array_equal(new, label):
            return label
        label = new


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes (wraps around on purpose)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
