"""Language-model scoring with a Katz backoff model of word n-grams, made from the scored corpus itself.

A document's words (lower case, cut at white space) are framed by start symbols and an end symbol.  The corpus
falls into two halves by a hash of the text, and a document is scored by the model of the other half, so that
neither it nor an exact copy vouches for itself.  All documents are counted.

* Good-Turing: a count r up to ``K`` is discounted to d(r) r, where d(r) comes from the numbers of
  n-grams by count (Katz 1987); where these give no value between 0 and 1, d(r) = (r - 1/2) / r.
  N-grams seen once have their d(1) like all others.
* P_k(w | h) = d(c) c / of(h) for an n-gram of order k that was seen c times, else alpha(h) P_{k-1}(w | h'), where h'
  is h without its first word; a history that was not seen backs off as it is.  P_0 has only the unknown word.
* of(h) is the number of words seen after h, and one more where nothing was discounted, so that something is left.
  alpha(h) = (1 - sum P_k(w | h)) / (1 - sum P_{k-1}(w | h')) over the words w seen after h, so that every history
  sums to one exactly.

The n-grams are stored in a table of buckets by the last word of the history.  So all orders from the second on of a
token lie in one bucket, and the recursion over orders is local; the first order comes from a table of words.  A
history word with more tokens than a bucket should hold is spread over several by the next word, and only its
totals are put together.  A text is read once: its n-grams travel packed, with the documents that they are for, and
sums return.

Defined results: null text has null counts and scores; text without words has 0 tokens and a null score, and so
has every text where the other half has no words; texts are scored whole; repeated rows count as often as they occur
and each get the same score; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import _packed
from ._packed import SPACE, bits_for, hashed_words, lists, mixed, parts, runs, squeezed, unsqueezed
from ._util import release, scratch

ORDER = 2
K = 5
START, END = -7046029254386353131, 1609587929392839161
#: Tokens that a map task holds at once, and that a bucket should have (about).
CHUNK, RANGE = 1_200_000, 1_000_000
#: Documents from which words are found that need several buckets; they route, and change no result.
SAMPLE = 20_000


def planes(a: np.ndarray) -> bytes:
    return squeezed(_packed.planes(a))


def unplanes(b: bytes, kind: type) -> np.ndarray:
    return _packed.unplanes(unsqueezed(b), kind)


def pack(*hashes: np.ndarray) -> bytes:
    """Ascending ones, one array after the other."""
    return squeezed(b"".join(map(_packed.pack, hashes)))


def unpack(b: bytes) -> np.ndarray:
    return _packed.unpack(unsqueezed(b))


def unpack_two(b: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n hashes, and the others."""
    both = unsqueezed(b)
    return _packed.unpack(both[: 8 * n]), _packed.unpack(both[8 * n :])


def key(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mixed(mixed(h) * np.uint64(0x9E3779B97F4A7C15) + w)


def framed(words: np.ndarray, bounds: np.ndarray, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For every token, the end symbol included, of documents that aren't empty: the token, the word before it, and so on; and its document."""
    full = np.nonzero(np.diff(bounds))[0]
    n = np.diff(bounds)[full]
    if not len(full):
        return [words[:0]] * order, full
    pad = order - 1
    ends = np.cumsum(n + pad + 1)
    seq = np.full(int(ends[-1]), START % (1 << 64), np.uint64)
    seq[ends - 1] = np.uint64(END)
    token = np.ones(len(seq), bool)
    for k in range(pad):
        token[ends - n - pad - 1 + k] = False
    at = np.nonzero(token)[0]
    body = token.copy()
    body[ends - 1] = False
    seq[body] = words[bounds[0] : bounds[-1]]
    return [seq[at - k] for k in range(order)], np.repeat(full, n + 1)


def _sorted(columns: list[np.ndarray]) -> np.ndarray:
    """The order of rows of small numbers, by the first column, then the next, ..."""
    bits = [int(c.max()).bit_length() if len(c) else 0 for c in columns]
    if sum(bits) > 63:
        return np.lexsort(columns[::-1])
    code = np.zeros(len(columns[0]), np.uint64)
    for c, b in zip(columns, bits, strict=True):
        code = (code << np.uint64(b)) | c.astype(np.uint64)
    return np.argsort(code, kind="stable")


def _changes(columns: list[np.ndarray]) -> np.ndarray:
    """Where rows differ from the one before."""
    edge = np.ones(len(columns[0]), bool)
    edge[1:] = False
    for c in columns:
        edge[1:] |= c[1:] != c[:-1]
    return edge


# -- blobs of chunks

#: kind 0: a document.  kind 1: words of a chunk.  kind 2: n-grams of a chunk.  The bucket is that of the word or history.
_BLOB = [("kind", T.IntegerType()), ("bucket", T.LongType()), ("chunk", T.LongType()), ("i", T.LongType()), ("n", T.LongType())]


def _schema(docs: DataFrame) -> T.StructType:
    named = [T.StructField(k, t) for k, t in _BLOB]
    return T.StructType([*named, docs.schema["doc_id"], *(T.StructField(k, T.BinaryType()) for k in ("words", "x", "y", "d", "c"))])


class Routes:
    """Buckets by ranges of the hash of a history's last word; heavy words have some of their own, by the next word."""

    def __init__(self, bits: int, heavy: dict[int, int]):
        self.bits = bits
        self.words = np.array(sorted(heavy), np.uint64)
        self.number = np.array([heavy[int(w)] for w in self.words], np.int64)
        self.first = (1 << bits) + np.cumsum(self.number) - self.number

    def of(self, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        out = (h >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(h), np.int64)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
            heavy = self.words[at] == h
            out[heavy] = self.first[at[heavy]] + (mixed(w[heavy]) % self.number[at[heavy]].astype(np.uint64)).astype(np.int64)
        return out


def _blobs(docs: DataFrame, order: int, routes: Routes) -> DataFrame:
    schema = _schema(docs)
    kinds, names = to_arrow_schema(schema), schema.names

    def flush(chunk: int, kept: list) -> pa.RecordBatch:
        flat = np.concatenate([f for f, _ in kept])
        bounds = np.concatenate([[0], np.cumsum(np.concatenate([n for _, n in kept]))])
        columns, doc = framed(flat, bounds, order)
        rows = []
        if len(doc):
            every = np.unique(np.concatenate([columns[0], np.unique(columns[1]), np.array([START % (1 << 64)], np.uint64)]))
            ids = [np.searchsorted(every, c) for c in columns]
            words, n = np.unique(ids[0], return_counts=True)
            own = every[words]
            at = parts(own, routes.bits)
            rows += [{"kind": 1, "bucket": b, "chunk": chunk, "words": pack(own[s:e]), "c": planes(n[s:e].astype(np.uint32))} for b, (s, e) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)) if e > s]
            bucket = routes.of(columns[1], columns[0])
            # By bucket, then history word, next word, older words, document.
            cols = [bucket, ids[1], ids[0], *ids[2:], doc]
            o = _sorted(cols)
            cols = [c[o] for c in cols]
            first = np.nonzero(_changes(cols))[0]
            n = np.diff(np.append(first, len(doc)))
            cols = [c[first] for c in cols]
            at = np.nonzero(_changes(cols[:1]))[0].tolist() + [len(first)]
            for s, e in zip(at[:-1], at[1:], strict=True):
                hs, x = np.unique(cols[1][s:e], return_inverse=True)
                rest = np.stack([c[s:e] for c in cols[2:-1]])
                ws, y = np.unique(rest, return_inverse=True)
                # Numbers of history words ascend; both lists of words go as one.
                rows.append({"kind": 2, "bucket": int(cols[0][s]), "chunk": chunk, "i": len(hs), "n": e - s, "words": pack(every[hs], every[ws]), "x": planes(np.diff(x, prepend=0).astype(np.uint32)), "y": planes(y.reshape(-1).astype(np.uint32)), "d": planes(cols[-1][s:e].astype(np.uint32)), "c": planes(n[s:e].astype(np.uint32))})
        return pa.RecordBatch.from_pylist([{c: r.get(c) for c in names} for r in rows], schema=kinds)

    def run(batches):
        part = TaskContext.get().partitionId()
        # A chunk has documents of one half only: the lowest bit of its number.
        kept: list[list] = [[], []]
        size, docs_in, seq = [0, 0], [0, 0], [0, 0]
        for b in batches:
            half, null = b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False)
            flat, bounds = lists(b.column(3))
            words = flat.view(np.uint64)
            for lo, hi in runs(bounds, CHUNK):
                own, width = half[lo:hi], np.diff(bounds[lo : hi + 1])
                inside = words[bounds[lo] : bounds[hi]]
                for f in (0, 1):
                    at = np.nonzero(own == f)[0]
                    if not len(at):
                        continue
                    chunk = part << 32 | seq[f] << 1 | f
                    n = width[at]
                    take = pa.array(lo + at)
                    none = pa.nulls(len(at), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(at), np.int32)), pa.array(np.full(len(at), chunk)), pa.array(np.full(len(at), chunk)), pa.array(docs_in[f] + np.arange(len(at))), pa.array(n, mask=null[lo + at]), b.column(0).take(take), *[none] * 5], schema=kinds)
                    kept[f].append((inside[np.repeat(own == f, width)], n))
                    size[f] += int(n.sum())
                    docs_in[f] += len(at)
                    if size[f] >= CHUNK // 2:
                        yield flush(chunk, kept[f])
                        kept[f], size[f], docs_in[f] = [], 0, 0
                        seq[f] += 1
                        release()
        for f in (0, 1):
            if kept[f]:
                yield flush(part << 32 | seq[f] << 1 | f, kept[f])
        release()

    half = F.when(F.substring(F.md5(F.coalesce("text", F.lit(""))), 1, 1) < "8", 0).otherwise(1)
    return docs.select("doc_id", half.alias("half"), F.col("text").isNull().alias("null"), hashed_words(F.col("text")).alias("w")).mapInArrow(run, schema)


# -- tables

#: kind 0: as before.  kind 1: words with their numbers in both halves (x, y).  kind 2: a bucket of n-grams.  kind 3: c n-grams of order i were seen n times (n up to K + 1) in the half ``chunk``, or (n = 0) c in all.
#: Of a kind 2 row: words holds i history words, then those that x (history word), y (next word), older numbers; c, e: numbers in both halves; posts: n-gram, document and number by chunk.
_TABLE = [T.StructField("c1", T.BinaryType()), T.StructField("older", T.ArrayType(T.BinaryType())), T.StructField("posts", T.ArrayType(T.StructType([T.StructField("chunk", T.LongType()), T.StructField("g", T.BinaryType()), T.StructField("d", T.BinaryType()), T.StructField("c", T.BinaryType())])))]


def _merged_words(blobs: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    w = [unpack(r["words"]) for r in blobs]
    half = np.repeat([r["chunk"] & 1 for r in blobs], [len(x) for x in w])
    every, at = np.unique(np.concatenate(w), return_inverse=True)
    c = np.concatenate([unplanes(r["c"], np.uint32) for r in blobs])
    return every, np.stack([np.bincount(at[half == f], c[half == f], len(every)).astype(np.int64) for f in (0, 1)])


def _stats(c: np.ndarray, order: int) -> list[dict]:
    out = []
    for f in (0, 1):
        out += [{"kind": 3, "i": order, "chunk": f, "n": r, "bucket": int((c[f] == r).sum())} for r in range(1, K + 2)]
        out.append({"kind": 3, "i": order, "chunk": f, "n": 0, "bucket": int(c[f].sum())})
    return out


def _runs_of(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Starts of runs of equal rows, and the run of each row."""
    edge = _changes(columns)
    return np.nonzero(edge)[0], np.cumsum(edge) - 1


def _merged_grams(blobs: list[dict], order: int) -> list[dict]:
    hs, ws, x, y = [], [], [], []
    for r in blobs:
        h, w = unpack_two(r["words"], r["i"])
        x.append(np.cumsum(unplanes(r["x"], np.uint32), dtype=np.int32))
        y.append(unplanes(r["y"], np.uint32).reshape(order - 1, -1))
        hs.append(h), ws.append(w)
    h, w = np.unique(np.concatenate(hs)), np.unique(np.concatenate(ws))
    size = [len(a) for a in x]
    x = np.concatenate([np.searchsorted(h, a)[i].astype(np.int32) for a, i in zip(hs, x, strict=True)])
    y = list(np.concatenate([np.searchsorted(w, a).astype(np.int32)[i] for a, i in zip(ws, y, strict=True)], axis=1))
    del hs, ws
    o = _sorted([x, *y])
    start, run = _runs_of([x[o], *(c[o] for c in y)])
    gram = np.empty(len(o), np.int64)
    gram[o] = run
    grams = [c[o][start] for c in (x, *y)]
    c = np.concatenate([unplanes(r["c"], np.uint32) for r in blobs]).astype(np.int64)
    half = np.repeat([r["chunk"] & 1 for r in blobs], size)
    counts = np.stack([np.bincount(gram[half == f], c[half == f], len(start)).astype(np.int64) for f in (0, 1)])
    posts, at = [], 0
    for r, n in zip(blobs, size, strict=True):
        posts.append({"chunk": r["chunk"], "g": planes(np.diff(gram[at : at + n], prepend=0).astype(np.uint32)), "d": r["d"], "c": r["c"]})
        at += n
    out = [{"kind": 2, "bucket": blobs[0]["bucket"], "i": len(h), "words": pack(h, w), "x": planes(np.diff(grams[0], prepend=0).astype(np.uint32)), "y": planes(grams[1].astype(np.uint32)), "older": [planes(g.astype(np.uint32)) for g in grams[2:]], "c": planes(counts[0].astype(np.uint32)), "c1": planes(counts[1].astype(np.uint32)), "posts": posts}]
    for k in range(2, order + 1):
        first, _ = _runs_of(grams[:k])
        out += _stats(np.add.reduceat(counts, first, axis=1), k)
    return out


def tables(docs: DataFrame, order: int, routes: Routes) -> DataFrame:
    blobs = _blobs(docs, order, routes)
    schema = T.StructType([*blobs.schema.fields, *_TABLE])
    kinds, names = to_arrow_schema(schema), schema.names

    def run(t: pa.Table) -> pa.Table:
        release()
        kind = t.column("kind")[0].as_py()
        if kind == 0:
            return pa.table([t.column(c) if c in t.column_names else pa.nulls(t.num_rows, kinds.field(c).type) for c in names], schema=kinds)
        blobs = sorted(t.drop_columns("doc_id").to_pylist(), key=lambda r: r["chunk"])
        if kind == 1:
            w, c = _merged_words(blobs)
            rows = [{"kind": 1, "bucket": blobs[0]["bucket"], "words": pack(w), "x": planes(c[0].astype(np.uint32)), "y": planes(c[1].astype(np.uint32))}, *_stats(c, 1)]
        else:
            rows = _merged_grams(blobs, order)
        out = pa.Table.from_pylist([{c: r.get(c) for c in names} for r in rows], schema=kinds)
        del blobs, rows
        release()
        return out

    # Documents are spread by chunk.
    spread = F.when(F.col("kind") == 0, F.pmod(F.xxhash64("chunk"), F.lit(1 << 20))).otherwise(F.col("bucket"))
    return blobs.groupBy("kind", spread.alias("at")).applyInArrow(run, schema)


# -- probabilities


def discounts(n: list[int]) -> list[float]:
    """d(1) to d(K), from the numbers of n-grams seen 1 to K + 1 times."""
    share = (K + 1) * n[K] / n[0] if n[0] else 1.0
    found = []
    for r in range(1, K + 1):
        d = ((r + 1) * n[r] / (r * n[r - 1]) - share) / (1 - share) if n[r - 1] and share < 1 else 0.0
        found.append(d if 0 < d < 1 else (r - 0.5) / r)
    return found


def discounted(c: np.ndarray, d: list[float]) -> np.ndarray:
    return c * np.array([0.0, *d, 1.0])[np.minimum(c, K + 1)]


class Base:
    """What is known of the whole corpus: discounts by order and half, and the first order's totals."""

    def __init__(self, stat: dict[tuple[int, int, int], int], order: int):
        self.order = order
        of = lambda k, f: [stat.get((k, f, r), 0) for r in range(1, K + 2)]
        self.d = {(k, f): discounts(of(k, f)) for k in range(1, order + 1) for f in (0, 1)}
        self.total = [stat.get((1, f, 0), 0) for f in (0, 1)]
        mass = [n - sum(r * x * (1 - d) for r, (x, d) in enumerate(zip(of(1, f)[:K], self.d[1, f], strict=True), 1)) for f, n in enumerate(self.total)]
        self.of = [n + 1 if m > n - 1e-9 else n for n, m in zip(self.total, mass, strict=True)]
        self.unknown = [1 - m / o for m, o in zip(mass, self.of, strict=True)]

    def words(self, c: np.ndarray, f: int) -> np.ndarray:
        """P_1 of words seen c times in half f."""
        return np.where(c > 0, discounted(c, self.d[1, f]) / self.of[f], self.unknown[f])


class Grams:
    """A bucket's n-grams: all orders from the second on, each as runs of the next one's."""

    def __init__(self, r: dict, order: int):
        self.h, self.w = unpack_two(r["words"], r["i"])
        last = [np.cumsum(unplanes(r["x"], np.uint32), dtype=np.int64), unplanes(r["y"], np.uint32).astype(np.int64), *(unplanes(b, np.uint32).astype(np.int64) for b in r["older"])]
        count = np.stack([unplanes(r[k], np.uint32).astype(np.int64) for k in ("c", "c1")])
        # By order: history word, next word, older words; numbers in both halves; the run of the n-gram that is one word shorter; the history.
        self.columns, self.count, self.lower, self.history, self.names = {}, {}, {}, {}, {}
        for k in range(order, 1, -1):
            self.columns[k], self.count[k] = last[:k], count
            past = [last[0], *last[2:k]]
            o = _sorted(past)
            start, run = _runs_of([c[o] for c in past])
            self.history[k] = np.empty(len(o), np.int64)
            self.history[k][o] = run
            name = self.h[past[0][o][start]]
            for c in past[1:]:
                name = key(name, self.w[c[o][start]])
            self.names[k] = name
            if k > 2:
                first, self.lower[k] = _runs_of(last[: k - 1])
                count = np.add.reduceat(count, first, axis=1)
                last = [c[first] for c in last]

    def sums(self, k: int, f: int, base: Base, below: np.ndarray) -> np.ndarray:
        """By history of order k: words after it, their discounted numbers, and their probabilities of the order below."""
        c = self.count[k][f]
        size = len(self.names[k])
        return np.stack([np.bincount(self.history[k], x, size) for x in (c, discounted(c, base.d[k, f]), np.where(c > 0, below, 0.0))])

    def below(self, k: int, f: int, p: np.ndarray) -> np.ndarray:
        """Values of the order below, for each n-gram of order k."""
        return p[self.columns[2][1]] if k == 2 else p[self.lower[k]]

    def probabilities(self, k: int, f: int, base: Base, first: np.ndarray, totals: dict | None = None) -> np.ndarray:
        """P_k of every n-gram of order k by the model of half f: seen ones have their own, others go back to the order below.  first: P_1 of the words.  totals: sums by order and history where the bucket has a part only."""
        if k == 1:
            return first
        below = self.below(k, f, self.probabilities(k - 1, f, base, first, totals))
        n, m, p = totals[k, f] if totals is not None else self.sums(k, f, base, below)
        of = np.where(m > n - 1e-9, n + 1, n)
        alpha = np.where(n > 0, (1 - m / of) / (1 - p), 1.0)
        c = self.count[k][f]
        return np.where(c > 0, discounted(c, base.d[k, f]) / of[self.history[k]], alpha[self.history[k]] * below)


_FIRST = "bucket bigint, words binary, x binary, y binary"


def _first_order(table: DataFrame, bits: int) -> DataFrame:
    """bucket, words and their numbers in both halves: what each bucket of n-grams needs of the table of words, from each of its ranges."""
    asked = pa.schema([("range", pa.int64()), ("bucket", pa.int64()), ("words", pa.binary())])
    given = pa.schema([("bucket", pa.int64()), *((c, pa.binary()) for c in ("words", "x", "y"))])

    def ask(batches):
        for b in batches:
            for r in b.to_pylist():
                _, w = unpack_two(r["words"], r["i"])
                at = parts(w, bits)
                yield pa.RecordBatch.from_pylist([{"range": k, "bucket": r["bucket"], "words": pack(w[s:e])} for k, (s, e) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)) if e > s], schema=asked)

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return given.empty_table()
        r = right.to_pylist()[0]
        words, c = unpack(r["words"]), [unplanes(r[k], np.uint32) for k in ("x", "y")]
        rows = []
        for q in left.to_pylist():
            w = unpack(q["words"])
            at = np.minimum(np.searchsorted(words, w), len(words) - 1)
            there = words[at] == w  # start symbols are no words
            rows.append({"bucket": q["bucket"], "words": q["words"], **{k: planes(np.where(there, n[at], 0).astype(np.uint32)) for k, n in zip(("x", "y"), c, strict=True)}})
        return pa.Table.from_pylist(rows, schema=given)

    requests = table.filter("kind = 2").select("bucket", "i", "words").mapInArrow(ask, "range bigint, bucket bigint, words binary")
    words = table.filter("kind = 1").select(F.col("bucket").alias("range"), "words", "x", "y")
    return requests.groupBy("range").cogroup(words.groupBy("range")).applyInArrow(answer, _FIRST)


def _first(grams: Grams, rows: list[dict], base: Base) -> list[np.ndarray]:
    """P_1 of a bucket's words by the model of either half."""
    c = np.zeros((2, len(grams.w)), np.int64)
    for r in rows:
        at = np.searchsorted(grams.w, unpack(r["words"]))
        for f, k in enumerate("xy"):
            c[f, at] = unplanes(r[k], np.uint32)
    return [base.words(c[f], f) for f in (0, 1)]


_PART = "k int, name bigint, bucket bigint, n0 double, m0 double, p0 double, n1 double, m1 double, p1 double"


def _totals(rows: pa.Table, grams: Grams, upto: int) -> dict | None:
    """Sums by order and half, in the order of the bucket's histories."""
    if not rows.num_rows:
        return None
    out = {}
    kinds, name = rows.column("k").to_numpy(), rows.column("name").to_numpy().view(np.uint64)
    for k in range(2, upto + 1):
        here = np.nonzero(kinds == k)[0]
        o = here[np.argsort(name[here])]
        at = o[np.searchsorted(name[o], grams.names[k])]
        for f in (0, 1):
            out[k, f] = np.stack([rows.column(f"{c}{f}").to_numpy()[at] for c in "nmp"])
    return out


def _shared_totals(table: DataFrame, first: DataFrame, base: Base, routes: Routes) -> DataFrame | None:
    """Of the histories whose word has several buckets, the sums over all of these, for each bucket that has a part; order by order."""
    if not len(routes.words):
        return None
    spark = table.sparkSession
    known = spark.createDataFrame([], _PART)
    some = table.filter((F.col("kind") == 2) & (F.col("bucket") >= 1 << routes.bits)).select(*_GRAM)
    first = first.filter(F.col("bucket") >= 1 << routes.bits)
    names = ["k", "name", "bucket", *(f"{c}{f}" for f in (0, 1) for c in "nmp")]

    def part_of(order: int):
        def part(t: pa.Table) -> pa.Table:
            g, grams, p, totals = _bucket(t, base, order - 1)
            cols = []
            for f in (0, 1):
                below = grams.below(order, f, grams.probabilities(order - 1, f, base, p[f], totals))
                cols += list(grams.sums(order, f, base, below))
            size = len(grams.names[order])
            return pa.table([pa.array(np.full(size, order, np.int32)), pa.array(grams.names[order].view(np.int64)), pa.array(np.full(size, g["bucket"])), *map(pa.array, cols)], names=names)

        return part

    for k in range(2, base.order + 1):
        rows = scratch(_together(some, first, known, part_of(k), _PART), "parts")
        whole = rows.groupBy("k", "name").agg(*(F.sum(c).alias(c) for c in names[3:]))
        known = scratch(known.union(rows.select("k", "name", "bucket").join(whole, ["k", "name"]).select(*names)), "totals")
    return known


#: Columns of a bucket's n-grams without and with the documents that they are for.
_GRAM = ["bucket", "i", "words", "x", "y", "older", "c", "c1"]


def _together(grams: DataFrame, first: DataFrame, totals: DataFrame | None, kernel, schema: str) -> DataFrame:
    """kernel over a bucket's rows of all three, told apart by ``what``."""
    df = grams.withColumn("what", F.lit(0)).unionByName(first.withColumn("what", F.lit(1)), allowMissingColumns=True)
    if totals is not None:
        df = df.unionByName(totals.withColumn("what", F.lit(2)), allowMissingColumns=True)
    return df.groupBy("bucket").applyInArrow(kernel, schema)


def _bucket(t: pa.Table, base: Base, upto: int) -> tuple[dict, Grams, list[np.ndarray], dict | None]:
    """A bucket's row, its n-grams, P_1 of its words and, where it has a part of a history only, the totals up to an order."""
    what = t.column("what").to_numpy()
    only = lambda k: t.filter(pa.array(what == k))
    g = only(0).to_pylist()[0]
    grams = Grams(g, base.order)
    p = _first(grams, only(1).select(["words", "x", "y"]).to_pylist(), base)
    return g, grams, p, _totals(only(2), grams, upto) if "k" in t.column_names else None


def routes_for(docs: DataFrame) -> Routes:
    size = docs.agg(F.sum(F.length("text")).alias("chars"), F.count("text").alias("n")).first()
    tokens = (size["chars"] or 0) / 6 + size["n"]
    bits = bits_for(tokens, RANGE)
    if tokens <= RANGE:
        return Routes(bits, {})
    share = min(1.0, SAMPLE / size["n"])
    some = docs.filter(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 20)) < share * (1 << 20)).select(hashed_words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    past = some.select(F.explode(F.concat(F.array(F.lit(START)), "w")).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    past = scratch(past, "sample")
    whole = past.agg(F.sum("n")).first()[0] or 1
    # No more of them than the sample's tokens by these shares.
    found = past.filter(F.col("n") * tokens > whole * RANGE / 2).collect()
    return Routes(bits, {r["h"] % (1 << 64): max(2, math.ceil(2 * r["n"] / whole * tokens / RANGE)) for r in found})


def katz_scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, n_tokens (words), logprob (natural logarithm, the end symbol included), perplexity for every row."""
    if order < 2:
        raise ValueError("the order is 2 at least")
    docs = docs.select("doc_id", "text")
    routes = routes_for(docs)
    table = scratch(tables(docs, order, routes), "ngrams")
    base = Base({(r["i"], r["chunk"], r["n"]): r["c"] for r in table.filter("kind = 3").groupBy("i", "chunk", "n").agg(F.sum("bucket").alias("c")).collect()}, order)
    first = scratch(_first_order(table, routes.bits), "first")
    totals = _shared_totals(table, first, base, routes)
    found = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("i", T.LongType()), docs.schema["doc_id"], T.StructField("n", T.LongType()), T.StructField("d", T.BinaryType()), T.StructField("s", T.BinaryType())])
    kinds = to_arrow_schema(found)

    def score(t: pa.Table) -> pa.Table:
        release()
        g, grams, p, sums = _bucket(t, base, order)
        # A document is for the model of the other half.
        value = [np.log(grams.probabilities(order, 1 - f, base, p[1 - f], sums)) if base.total[1 - f] else None for f in (0, 1)]
        rows = []
        for r in g["posts"]:
            v = value[r["chunk"] & 1]
            if v is None:
                continue
            at = np.cumsum(unplanes(r["g"], np.uint32), dtype=np.int64)
            d, c = unplanes(r["d"], np.uint32), unplanes(r["c"], np.uint32)
            there, idx = np.unique(d, return_inverse=True)
            rows.append({"chunk": r["chunk"], "d": planes(np.diff(there, prepend=np.uint32(0)).astype(np.uint32)), "s": planes(np.bincount(idx, c * v[at]))})
        out = pa.Table.from_pylist([{c: r.get(c) for c in kinds.names} for r in rows], schema=kinds)
        del rows, value, grams
        release()
        return out

    part = _together(table.filter("kind = 2").select(*_GRAM, "posts"), first, totals, score, found)
    rows = table.filter("kind = 0").select("chunk", "i", "doc_id", "n", F.lit(None).cast("binary").alias("d"), F.lit(None).cast("binary").alias("s")).union(part)
    out = T.StructType([docs.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("logprob", T.DoubleType())])

    def total(t: pa.Table) -> pa.Table:
        own = t.filter(pc.is_valid(t.column("i"))).sort_by("i")
        s = np.zeros(own.num_rows)
        for r in t.filter(pc.is_null(t.column("i"))).select(["d", "s"]).to_pylist():
            s[np.cumsum(unplanes(r["d"], np.uint32), dtype=np.int64)] += unplanes(r["s"], np.float64)
        none = not base.total[1 - (t.column("chunk")[0].as_py() & 1)]
        return pa.table({"doc_id": own.column("doc_id"), "n_tokens": own.column("n"), "logprob": pa.array(s, mask=np.full(len(s), none))})

    df = rows.groupBy("chunk").applyInArrow(total, out)
    logprob = F.when(F.col("n_tokens") > 0, F.col("logprob"))
    return df.select("doc_id", "n_tokens", F.round(logprob, 3).alias("logprob"), F.round(F.exp(-logprob / (F.col("n_tokens") + 1)), 3).alias("perplexity"))


def _sql() -> str:
    """Of order 2."""

    def d(n: str) -> str:
        share = f"({K + 1}.0e0 * {n}{K + 1} / {n}1)"
        out = []
        for r in range(1, K + 1):
            v = f"(({r + 1}.0e0 * {n}{r + 1} / ({r} * {n}{r}) - {share}) / (1 - {share}))"
            out.append(f"case when {n}{r} > 0 and {n}1 > 0 and {share} < 1 and {v} > 0 and {v} < 1 then {v} else {(r - 0.5) / r!r}::double end as d{r}")
        return ", ".join(out)

    of = lambda c: "case " + " ".join(f"when {c} = {r} then {r} * d{r}" for r in range(1, K + 1)) + f" else {c}::double end"
    ns = lambda c, n: ", ".join(f"count(*) filter (where {c} = {r}) as {n}{r}" for r in range(1, K + 2))
    return f"""
with w as (select doc_id, text is null as missing, case when substr(md5(text), 1, 1) < '8' then 0 else 1 end as f, list_filter(string_split_regex(lower(coalesce(text, '')), '{SPACE}'), lambda x: x <> '') as w from documents),
x as (select doc_id, f, list_concat(['<s>'], w) as hs, list_concat(w, ['</s>']) as ws from w where len(w) > 0),
t as materialized (select doc_id, f, unnest(hs) as h, unnest(ws) as w from x),
c1 as materialized (select f, w, count(*) as c from t group by all),
c2 as materialized (select f, h, w, count(*) as c from t group by all),
e1 as (select f, {d("n")}, total from (select f, {ns("c", "n")}, sum(c) as total from c1 group by f)),
e2 as (select f, {d("n")} from (select f, {ns("c", "n")} from c2 group by f)),
m1 as materialized (select c1.f, w, {of("c")} as m, total from c1 join e1 on c1.f = e1.f),
o1 as materialized (select f, case when sum(m) > any_value(total) - 1e-9 then any_value(total) + 1 else any_value(total) end as o, sum(m) as m from m1 group by f),
p1 as materialized (select m1.f, w, m1.m / o as p from m1 join o1 on m1.f = o1.f),
p2 as materialized (select c2.f, h, c2.w, c, {of("c2.c")} as m, p1.p from c2 join p1 on p1.f = c2.f and p1.w = c2.w join e2 on e2.f = c2.f),
b0 as (select f, h, case when sum(m) > sum(c) - 1e-9 then sum(c) + 1 else sum(c) end as o, sum(m) as m, sum(p) as p from p2 group by f, h),
b as materialized (select f, h, o, (1 - m / o) / (1 - p) as alpha from b0),
s as (select t.doc_id, sum(ln(case when p2.m is not null then p2.m / b.o else coalesce(b.alpha, 1) * coalesce(p1.p, 1 - o1.m / o1.o) end)) as logprob
 from t join o1 on o1.f = 1 - t.f left join p1 on p1.f = 1 - t.f and p1.w = t.w left join b on b.f = 1 - t.f and b.h = t.h left join p2 on p2.f = 1 - t.f and p2.h = t.h and p2.w = t.w group by t.doc_id)
select w.doc_id, case when missing then null else len(w.w) end::bigint as n_tokens, round(logprob, 3) as logprob, round(exp(-logprob / (len(w.w) + 1)), 3) as perplexity from w left join s using (doc_id)"""


SQL = _sql()
