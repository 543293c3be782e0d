"""N-gram Jaccard join by T-occurrence search.

A document is the set of its three-word grams (lower case, words cut at white space); a shorter one
has one gram, the whole of its words.  Two documents are near when the Jaccard similarity of
their sets is at least ``THRESHOLD``; the result is exact.

1. Every gram's document frequency is counted over all documents.  Postings travel packed, by range of hash.
2. A document whose grams that others have too don't reach the threshold can have no partner and leaves.
3. The others, with grams in the order of frequency (rare first), are linked where their prefixes
   share a gram; documents of different connected components can't be near.
4. A component's documents, split by bands of size so that near ones lie in the same or in
   neighbouring bands, have inverted lists.  For each document T is the least overlap that a partner
   of its size or above must have.  DivideSkip sets the L longest of its lists aside, merges the short ones
   with a heap that skips to the next record with T - L occurrences, and probes the long ones by
   binary search; what reaches the overlap that its own size requires is a partner.
5. A block of more than ``BLOCK`` grams is cut into chunks of records of half as many, and every two chunks are
   searched as a task of their own, so no task holds more than two of them.  Smaller blocks share a task up to about
   as many grams.

Pairs never leave a task: it gives each record's number of near ones, and an edge to the least record that
it is linked with there.  So what is written grows with the documents, not with the pairs of a group.
Documents with the same set of grams are one record with a weight.  A class is what is linked by near pairs
and equal sets, directly or through others, and has the lowest doc_id of its documents as its name.

Defined results: null, empty and blank texts have no grams, no links, and themselves as their class; texts are
taken whole; rows that agree in doc_id and set of grams are one document and give a row each, with the same
answer; null doc_id sorts first and may name a class; an empty table gives no rows; other columns are not read.  The input must give the same rows in the same
order when a task is run again, as tables do.
"""

from __future__ import annotations

import heapq
import math
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ._packed import SPACE, bits_for, grams, hashed_words, lists, pack, parts, planes, runs, unpack, unplanes
from ._util import mix, release, roots, scratch, side
from .components import components

GRAM = 3
THRESHOLD = 0.5
#: Grams that a map task holds at once, and that a range of hashes should have (about).
CHUNK, RANGE = 1_000_000, 1_500_000
#: Grams of two chunks of a block; of blocks that would have more than MANY chunks, up to GROW times as many.
BLOCK, MANY, GROW = 1_000_000, 32, 4
#: Rows and bytes that go to a Python worker at once: what is on its way takes room in the JVM and in the worker.
ROWS, BYTES = 1_000, 8_000_000
#: DivideSkip's weight of a probe, which goes for all candidates at once, against a step of the merge.
MU = 0.005
SLACK = 1e-9


def least_overlap(a: float, b: float, t: float) -> int:
    """Common grams that sets of these sizes need."""
    return math.ceil(t / (1 + t) * (a + b) - SLACK)


# -- records and postings

_BLOB = [T.StructField(k, T.BinaryType()) for k in ("g", "rec", "df", "sigs", "sizes")]


def postings(docs: DataFrame, bits: int, n: int = GRAM) -> DataFrame:
    """Three kinds of rows, told apart by the bucket: -1 is a document (doc_id, th: hash of the text, sig: hash of its set of grams), -2 a chunk's records (sigs, sizes), any other has a chunk's postings in a range of hashes (g, rec)."""
    schema = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("chunk", T.LongType()), T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("th", T.LongType()), T.StructField("sig", T.BinaryType()), *_BLOB])
    names, kinds = schema.names, to_arrow_schema(schema)

    def flush(chunk: int, sets: list[np.ndarray], sigs: list[bytes]) -> pa.RecordBatch:
        sizes = np.array([len(s) for s in sets])
        g, rec = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.uint32), sizes)
        order = np.argsort(g)
        g, rec = g[order], rec[order]
        at = parts(g, bits)
        rows = [{"bucket": -2, "chunk": chunk, "sigs": b"".join(sigs), "sizes": planes(sizes.astype(np.uint32))}]
        rows += [{"bucket": k, "chunk": chunk, "g": pack(g[a:e]), "rec": planes(rec[a:e])} for k, (a, e) in enumerate(zip(at[:-1], at[1:], strict=True)) if e > a]
        return pa.RecordBatch.from_pylist([{c: r.get(c) for c in names} for r in rows], schema=kinds)

    def run(batches):
        known: set[bytes] = set()
        sets: list[np.ndarray] = []
        sigs: list[bytes] = []
        held = 0
        chunk = TaskContext.get().partitionId() << 32
        for b in batches:
            flat, bounds = lists(b.column(2))
            words = flat.view(np.uint64)
            for lo, hi in runs(bounds, CHUNK):
                base = bounds[lo]
                own = words[base : bounds[hi]]
                every = grams(own, n)
                at, doc_sigs = [], []
                for i in range(lo, hi):
                    s, e = bounds[i] - base, bounds[i + 1] - base
                    if e == s:
                        continue
                    g = np.unique(every[s : e - n + 1]) if e - s >= n else grams(own[s:e], int(e - s))
                    sig = xxhash.xxh3_128_digest(g.tobytes())
                    at.append(i), doc_sigs.append(sig)
                    if sig not in known:
                        known.add(sig)
                        sets.append(g), sigs.append(sig)
                        held += len(g)
                take, none = pa.array(at, pa.int64()), pa.nulls(len(at), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([-1] * len(at), pa.int64()), pa.array([chunk] * len(at), pa.int64()), b.column(0).take(take), b.column(1).take(take), pa.array(doc_sigs, pa.binary()), *[none] * 5], schema=kinds)
                if held >= CHUNK:
                    yield flush(chunk, sets, sigs)
                    known, sets, sigs, held = set(), [], [], 0
                    chunk += 1
                    release()
        if sets:
            yield flush(chunk, sets, sigs)
        release()

    return docs.select("doc_id", F.xxhash64("text").alias("th"), hashed_words(F.col("text")).alias("w")).mapInArrow(run, schema)


def shared(found: DataFrame) -> DataFrame:
    """Of each range of hashes the postings of grams that occur in several places (df of them), by chunk; rows of documents and of records pass through."""
    schema = found.schema
    names = schema.names

    def run(t: pa.Table) -> pa.Table:
        if t.column("bucket")[0].as_py() < 0:
            return t
        rows = t.select(["chunk", "g", "rec"]).to_pylist()
        g = [unpack(r["g"]) for r in rows]
        lengths = [len(x) for x in g]
        g, rec, of = np.concatenate(g), np.concatenate([unplanes(r["rec"], np.uint32) for r in rows]), np.repeat(np.arange(len(rows), dtype=np.uint32), lengths)
        order = np.argsort(g)
        s = g[order]
        again = np.zeros(len(g), bool)
        again[1:] = s[1:] == s[:-1]
        again[:-1] |= again[1:]
        order, s = order[again], s[again]
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        n = np.diff(np.append(np.nonzero(new)[0], len(s)))
        df = np.repeat(n, n)
        del s, new, again
        # Places ascend within a blob, and so do its grams.
        back = np.argsort(order)
        order, df = order[back], df[back]
        g, rec, of = g[order], rec[order], of[order]
        del order, back
        at = np.searchsorted(of, np.arange(len(rows) + 1))
        out = [{"bucket": 0, "chunk": r["chunk"], "g": pack(g[a:e]), "rec": planes(rec[a:e]), "df": planes(df[a:e].astype(np.uint32))} for r, a, e in zip(rows, at[:-1], at[1:], strict=True) if e > a]
        release()
        return pa.Table.from_pylist([{c: r.get(c) for c in names} for r in out], schema=t.schema)

    # Rows that pass through are spread as well.
    spread = F.when(F.col("bucket") < 0, -1 - F.pmod(F.xxhash64("chunk"), F.lit(1 << 20))).otherwise(F.col("bucket"))
    return found.groupBy(spread.alias("range")).applyInArrow(run, schema)


RECORD = "sig binary, size bigint, grams binary, prefix array<bigint>"


def survivors(blobs: DataFrame, threshold: float) -> DataFrame:
    """sig, size, grams (those that others have too, ascending), prefix, of every record that can have a partner; a set that several chunks have comes from each."""
    kinds = pa.schema([("sig", pa.binary()), ("size", pa.int64()), ("grams", pa.binary()), ("prefix", pa.list_(pa.int64()))])

    def run(t: pa.Table) -> pa.Table:
        rows = t.select(["sigs", "sizes", "g", "rec", "df"]).to_pylist()
        own = next(r for r in rows if r["sigs"] is not None)
        sigs, sizes = np.frombuffer(own["sigs"], "V16"), unplanes(own["sizes"], np.uint32)
        rows = [r for r in rows if r["g"] is not None]
        if not rows:
            return kinds.empty_table()
        g, rec, df = np.concatenate([unpack(r["g"]) for r in rows]), np.concatenate([unplanes(r["rec"], np.uint32) for r in rows]), np.concatenate([unplanes(r["df"], np.uint32) for r in rows])
        enough = np.bincount(rec, minlength=len(sigs)) >= np.ceil(threshold * sizes - SLACK)
        keep = enough[rec]
        g, rec, df = g[keep], rec[keep], df[keep]
        order = np.lexsort((g, df, rec))
        g, rec = g[order], rec[order]
        at = np.searchsorted(rec, np.arange(len(sigs) + 1))
        out = []
        for i in np.nonzero(enough)[0].tolist():
            mine, size = g[at[i] : at[i + 1]], int(sizes[i])
            need = math.ceil(threshold * size - SLACK)
            prefix = mine[: max(0, (size - need + 1) - (size - len(mine)))]
            out.append({"sig": sigs[i].tobytes(), "size": size, "grams": np.sort(mine).tobytes(), "prefix": prefix.view(np.int64)})
        release()
        return pa.Table.from_pylist(out, schema=kinds)

    return blobs.groupBy("chunk").applyInArrow(run, RECORD)


# -- DivideSkip


class Lists:
    """Inverted lists of records, one after the other: each also as its runs of consecutive records, which near copies in the order of their numbers make long."""

    def __init__(self, lists: list[np.ndarray], weights: list[int]):
        self._fill(np.concatenate(lists), np.array([len(x) for x in lists]), np.array(weights))

    @classmethod
    def of(cls, flat: np.ndarray, lengths: np.ndarray, weights: np.ndarray) -> Lists:
        """Of lists that stand one after the other already."""
        self = cls.__new__(cls)
        self._fill(flat, lengths, weights)
        return self

    def _fill(self, flat: np.ndarray, lengths: np.ndarray, weights: np.ndarray) -> None:
        self.weights = weights.astype(np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        self.flat = flat.astype(np.int64)
        new = np.ones(len(self.flat), bool)
        new[1:] = np.diff(self.flat) != 1
        new[self.bounds[:-1]] = True
        first = np.nonzero(new)[0]
        self.run = np.cumsum(new) - 1
        self.start = array("q", self.flat[first].tobytes())
        self.end = array("q", (self.flat[np.append(first[1:], len(self.flat)) - 1] + 1).tobytes())
        self.runs = np.append(self.run[self.bounds[:-1]], len(first))


def merge_skip(index: Lists, runs: list[int], last: list[int], low: int, weights: list[int], need: int) -> list[tuple[int, int, int]]:
    """Stretches (from, to, weight) of records from low on whose weighted occurrences in lists reach need (at least 1); runs and last: the first run of each list, and the one after its last.

    A heap holds where each list's run begins, or ends where it has begun.  While the lists at hand don't reach need, heads that begin
    before the first place at which it can be reached are passed over, and their lists skip to the run that ends behind it.
    """
    start, end = index.start, index.end
    n, at, active = len(runs), list(runs), [False] * len(runs)
    # An entry is a place with the list's number as the last digit of a number system of base n.
    heap = [max(start[r], low) * n + k for k, (r, e) in enumerate(zip(runs, last, strict=True)) if r < e]
    heapq.heapify(heap)
    pop, push, replace = heapq.heappop, heapq.heappush, heapq.heapreplace
    found: list[tuple[int, int, int]] = []
    x = weight = 0
    while heap:
        top = heap[0]
        place = top // n
        if weight >= need:
            found.append((x, place, weight))
        x, floor = place, place * n
        while top < floor + n:
            k = top - floor
            if active[k]:
                active[k] = False
                weight -= weights[k]
                at[k] = r = at[k] + 1
                if r < last[k]:
                    replace(heap, start[r] * n + k)
                else:
                    pop(heap)
                    if not heap:
                        break
            else:
                active[k] = True
                weight += weights[k]
                replace(heap, end[at[k]] * n + k)
            top = heap[0]
        if need == 1 or weight >= need:
            continue
        reach, popped = weight, []
        while heap and reach < need:
            top = pop(heap)
            k = top % n
            popped.append(k)
            if not active[k]:
                reach += weights[k]
        if reach < need:
            break
        x = top // n
        for k in popped:
            if active[k]:
                active[k] = False
                weight -= weights[k]
            at[k] = r = bisect_right(end, x, at[k], last[k])
            if r < last[k]:
                if max(start[r], low) <= x:
                    active[k] = True
                    weight += weights[k]
                    push(heap, end[r] * n + k)
                else:
                    push(heap, start[r] * n + k)
    return found


def divide_skip(index: Lists, which: np.ndarray, here: np.ndarray, low: int, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Records from low on that occur at least need times in the weighted lists ``which`` (from the places ``here`` of flat on), and how often."""
    none = np.zeros(0, np.int64)
    ends = index.bounds[which + 1]
    some = ends > here
    which, here, ends = which[some], here[some], ends[some]
    weights = index.weights[which]
    if not len(which) or int(weights.sum()) < need:
        return none, none
    order = np.argsort(ends - here, kind="stable")
    which, here, ends, weights = which[order], here[order], ends[order], weights[order]
    aside = min(need - 1, int(need / (MU * math.log2(max(int(ends[-1] - here[-1]), 2)) + 1)))
    n = len(which) - int(np.searchsorted(np.cumsum(weights[::-1]), aside, side="right"))
    weight = int(weights[n:].sum())
    merged = merge_skip(index, index.run[here[:n]].tolist(), index.runs[which[:n] + 1].tolist(), low, weights[:n].tolist(), need - weight)
    if not merged:
        return none, none
    a, e, w = np.array(merged, np.int64).T
    count = np.repeat(w, e - a)
    found = np.arange(len(count)) - np.repeat(np.cumsum(e - a) - (e - a), e - a) + np.repeat(a, e - a)
    for k in range(n, len(which)):
        if not len(found):
            break
        x = index.flat[here[k] : ends[k]]
        place = np.minimum(np.searchsorted(x, found), len(x) - 1)
        count = count + weights[k] * (x[place] == found)
        weight -= int(weights[k])
        alive = count + weight >= need
        if not alive.all():
            found, count = found[alive], count[alive]
    return found, count


def inverted(sets: list[np.ndarray]) -> Lists | None:
    """The lists of grams that several of the sets have; grams that exactly the same sets have are one list with a weight.  Arrays throughout: an object for each gram would take many times the room of the grams."""
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    rec = np.repeat(np.arange(len(sets), dtype=np.uint32), [len(s) for s in sets])[order]
    every = every[order]
    first = np.concatenate([[0], np.nonzero(every[1:] != every[:-1])[0] + 1])
    del every, order
    lengths = np.diff(np.append(first, len(rec)))
    some = lengths > 1
    if not some.any():
        return None
    rec, lengths = rec[np.repeat(some, lengths)], lengths[some]
    start = np.cumsum(lengths) - lengths
    # The first list with the same hash, if it is the same list.
    _, one, which = np.unique(np.add.reduceat(mix(rec + np.uint64(0x9E3779B97F4A7C15)), start), return_index=True, return_inverse=True)
    own = np.arange(len(lengths))
    twin = one[which]
    twin = np.where(lengths[twin] == lengths, twin, own)
    same = np.logical_and.reduceat(rec == rec[np.arange(len(rec)) + np.repeat(start[twin] - start, lengths)], start)
    weights = np.bincount(np.where(same, twin, own), minlength=len(own))
    keep = weights > 0
    return Lists.of(rec[np.repeat(keep, lengths)], lengths[keep], weights[keep])


def join_block(sizes: np.ndarray, sets: list[np.ndarray], threshold: float, chunk: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each record of a block (in the order of size) the near ones that come after it, with their overlap.  With chunk (0 or 1 for each record) only pairs across the two chunks."""
    lists_ = inverted(sets)
    if lists_ is None:
        return
    which = np.repeat(np.arange(len(lists_.weights)), np.diff(lists_.bounds))
    # Where each record stands in its lists: what comes after it is what it must look at.
    place = np.argsort(lists_.flat, kind="stable")
    of = np.concatenate([[0], np.cumsum(np.bincount(lists_.flat, minlength=len(sets)))])
    for i, size in enumerate(sizes.tolist()):
        here = place[of[i] : of[i + 1]]
        near, overlap = divide_skip(lists_, which[here], here + 1, i + 1, least_overlap(size, size, threshold))
        ok = overlap * (1 + threshold) >= threshold * (size + sizes[near]) - SLACK
        if chunk is not None:
            ok &= chunk[near] != chunk[i]
        if ok.any():
            yield i, near[ok], overlap[ok]


def _blocks(records: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    band = F.floor(F.ln(F.col("size")) / math.log(1 / threshold) + SLACK).cast("bigint")
    df = records.drop("prefix").join(labels, F.col("sig") == F.col("node")).withColumn("band", band)
    return df.withColumn("block", F.explode(F.array(F.col("band"), F.col("band") - 1))).select("label", "block", "band", "sig", "size", "grams")


def near_records(records: DataFrame, weights: DataFrame, threshold: float, group: int = 1000, most: int | None = None) -> DataFrame:
    """sig, links (weight of the records near it, 0 in rows that only have an edge), to (the least record that it is linked with in a task, or itself); several rows for a record.  weights: sig, m."""
    most = most or BLOCK
    p = records.select("sig", F.explode("prefix").alias("gram"))
    least = p.groupBy("gram").agg(F.min("sig").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram", "hub")
    edges = p.join(least, "gram").filter("sig <> hub").select(F.col("sig").alias("a"), F.col("hub").alias("b")).distinct()
    labels = components(edges)
    df = _blocks(records, labels, threshold).join(weights, "sig")
    blocks = scratch(df.groupBy("label", "block").agg(F.sum(F.length("grams") / 8).alias("n")), "blocks")
    # Blocks that have a task of their own, or several as they are too large for one, with their number of chunks; their number is at most 8 times that of all grams by ``most``.
    chunks = lambda size: F.ceil(F.col("n") / (size / 2))
    k = F.when(F.col("n") > most, F.least(chunks(most), F.greatest(F.lit(MANY), chunks(GROW * most)))).otherwise(1)
    large = scratch(blocks.filter(F.col("n") > most / 8).select("label", "block", k.cast("int").alias("k")), "large")
    rest = blocks.filter(F.col("n") <= most / 8).agg(F.sum("n")).first()[0] or 0
    groups = max(1, -(-labels.count() // group), math.ceil(rest / (most / 2)))
    df = df.join(side(large), ["label", "block"], "left").withColumn("alone", F.col("k").isNotNull()).withColumn("k", F.coalesce("k", F.lit(1)))
    own = F.pmod(F.xxhash64("sig"), F.col("k")).cast("int")
    # A record of chunk c takes part in the tasks (c, x) and (x, c) of its block.
    df = df.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})
    df = df.withColumn("g", F.pmod(F.xxhash64("label", "block", "lo", "hi"), F.when(F.col("alone"), F.lit(1 << 40)).otherwise(F.lit(groups))))
    kinds = pa.schema([("sig", pa.binary()), ("links", pa.int64()), ("to", pa.binary())])
    key = ["label", "block", "lo", "hi"]

    def run(t: pa.Table) -> pa.Table:
        blobs, t = t.column("grams"), t.drop_columns("grams")  # these stay where they are
        order = pc.sort_indices(t, [(c, "ascending") for c in (*key, "size", "sig")])
        t = t.take(order).combine_chunks()
        order = order.to_pylist()
        task = list(zip(*(t.column(c).to_pylist() for c in key), strict=True))
        band, sig = (t.column(c).to_pylist() for c in ("band", "sig"))
        size, m, chunk = (t.column(c).to_numpy() for c in ("size", "m", "own"))
        out, at = [], 0
        for k in range(1, t.num_rows + 1):
            if k < t.num_rows and task[k] == task[at]:
                continue
            here = [i for i in range(at, k) if i == at or sig[i] != sig[i - 1]]  # the same set from several chunks is one record
            if len(here) > 1:
                _, block, lo, hi = task[at]
                links, ends = np.zeros(len(here), np.int64), []
                weight, bands = m[here], np.array([band[i] for i in here])
                sets = [np.frombuffer(blobs[order[i]].as_buffer(), np.uint64) for i in here]
                for i, near, _ in join_block(size[here], sets, threshold, None if lo == hi else chunk[here]):
                    near = near[np.minimum(bands[near], bands[i]) == block]
                    links[i] += weight[near].sum()
                    links[near] += weight[i]
                    ends.append((np.full(len(near), i), near))
                    if sum(len(x) for x, _ in ends[-64:]) > 1_000_000:  # edges of a forest do for all that came so far
                        root = roots(len(here), *map(np.concatenate, zip(*ends, strict=True)))
                        ends = [(np.arange(len(here)), root)]
                if ends:
                    root = roots(len(here), *map(np.concatenate, zip(*ends, strict=True))).tolist()
                    out += [(sig[here[i]], n, sig[here[root[i]]]) for i, n in enumerate(links.tolist()) if n]
            at = k
        release()
        return pa.table([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds.types, strict=True)] if out else [pa.array([], x) for x in kinds.types], schema=kinds)

    return df.groupBy("g").applyInArrow(run, "sig binary, links bigint, to binary")


def _found(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, th, sig) of every row with grams; sig, m (documents), least (doc_id in a struct) of every set that several documents have or that is near another; near_records' rows."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = bits_for(chars / 6, RANGE)
    base = scratch(shared(postings(docs, bits)), "grams", ROWS, BYTES)
    records = scratch(survivors(base.filter("bucket <> -1").select("chunk", *(f.name for f in _BLOB)), threshold), "records", ROWS, BYTES)
    ids = base.filter("bucket = -1").select("doc_id", "th", "sig")
    # A document with a partner has a record among the survivors; so have copies, whose grams all are shared.
    weights = scratch(ids.select("doc_id", "sig").distinct().groupBy("sig").agg(F.count(F.lit(1)).alias("m")), "weights")
    near = scratch(near_records(records, weights, threshold), "near", ROWS, BYTES)
    return ids, weights, near


def _classes(near: DataFrame) -> DataFrame:
    """node, label of every record that another is near."""
    return components(near.select(F.col("sig").alias("a"), F.col("to").alias("b")))


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, n_links (other documents that are near it) for every row."""
    docs = docs.select("doc_id", "text")
    ids, weights, near = _found(docs, threshold)
    linked = _classes(near)
    links = near.groupBy("sig").agg(F.sum("links").alias("links"))
    every = weights.join(links, "sig", "left").join(linked, F.col("sig") == F.col("node"), "left").filter("m > 1 or links is not null")
    every = every.select("sig", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("label", "sig").alias("team"))
    # Only records with links; the documents of all others stand for themselves.
    mine = scratch(ids.join(every, "sig").select("doc_id", "th", "n", "team"), "linked")
    name = mine.groupBy("team").agg(F.min(F.struct("doc_id")).alias("name"))
    found = scratch(mine.join(name, "team").select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), F.col("name.doc_id").alias("_class"), "n").distinct(), "classes")
    own = docs.select("doc_id", F.xxhash64("text").alias("th"))
    df = own.join(side(found), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left")
    return df.select("doc_id", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("_class")).alias("class_id"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class.  The one of lowest doc_id (null first, then by the hash of the text) stays, once even where its row is repeated; documents without grams all stay."""
    ids, weights, near = _found(docs.select("doc_id", "text"), threshold)
    key = F.struct("doc_id", "th")
    names = ids.groupBy("sig").agg(F.min(key).alias("name"), F.count(F.lit(1)).alias("n")).join(_classes(near), F.col("sig") == F.col("node"), "left").filter("n > 1 or label is not null").select("sig", "name", F.coalesce("label", "sig").alias("team"))
    first = names.groupBy("team").agg(F.min("name").alias("first"))
    rows = ids.join(names.join(first, "team").select("sig", "first"), "sig").groupBy("doc_id", "th", "first").agg(F.count(F.lit(1)).alias("n"))
    # Only what isn't kept as it is: rows that go, and rows of which one of several stays.
    change = scratch(rows.filter((key != F.col("first")) | (F.col("n") > 1)).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), (key != F.col("first")).alias("_gone")), "changes")
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.xxhash64("text").alias("own"))
    df = row.join(side(change), F.col("row")["doc_id"].eqNullSafe(change["_id"]) & (F.col("own") == change["_th"]), "left")
    plain = df.filter("_gone is null").select("row")
    several = df.filter("not _gone").withColumn("nth", F.row_number().over(Window.partitionBy("_id", "_th").orderBy("_id"))).filter("nth = 1").select("row")
    return plain.union(several).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


SQL = f"""
with recursive w as (select doc_id, list_filter(string_split_regex(lower(text), '{SPACE}'), lambda x: x <> '') as w from documents where text is not null),
s as materialized (select doc_id, list_sort(list_distinct(case when len(w) < {GRAM} then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - {GRAM} + 2), lambda i: array_to_string(w[i:i + {GRAM - 1}], ' ')) end)) as s from w where len(w) > 0),
r as materialized (select s, min(doc_id) as doc_id, len(s) as n, count(distinct doc_id) as m from s group by s),
g as materialized (select doc_id, n, unnest(s) as g from r),
o as (select a.doc_id as a, b.doc_id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as o from g a join g b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
p as materialized (select a, b from o where o * {1 + THRESHOLD}::double + 1e-9 >= {THRESHOLD}::double * (na + nb)),
e as materialized (select a, b from p union all select b, a from p),
reach as (select doc_id as a, doc_id as b from r union select reach.a, e.b from reach join e on reach.b = e.a),
c as (select a, min(b) as class_id from reach group by a),
l as (select e.a, sum(r.m) as n from e join r on r.doc_id = e.b group by e.a),
f as (select s.doc_id, c.class_id, r.m - 1 + coalesce(l.n, 0) as n from s join r using (s) join c on c.a = r.doc_id left join l on l.a = r.doc_id)
select documents.doc_id, coalesce(f.class_id, documents.doc_id) as class_id, coalesce(f.n, 0)::bigint as n_links from documents left join f using (doc_id)"""
