"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

A text is cut into pieces by the vocabulary's pattern.  A piece starts as its bytes; the leaves of a
segment tree hold the rank of each symbol with its right neighbour, inner nodes the lower of
their children (the left one on ties).  The root is the leftmost pair of lowest rank; after
its merge three leaves change, and so do their ancestors, a logarithmic number.  It ends when
the root has no rank.  The words of a batch that aren't known yet run in lock-step: one tree for each
row of a matrix; pieces of over ``WIDE`` bytes run by themselves.

Decoding is the join of the ids' bytes, read as UTF-8.

Defined results: null text has null ids, and decodes to null; empty text has none; unpaired
surrogates, which Spark's strings can't hold, don't occur; texts and pieces are encoded whole;
ids that aren't in the vocabulary don't decode (null); repeated rows give a row each; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import importlib.util
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._util import slices

FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
NONE = np.int32(2**31 - 1)
WIDE = 64
#: Pieces remembered by a task; beyond, it forgets them all, which costs time only.
KNOWN = 400_000


def pattern(folder: str = FOLDER) -> str:
    """How the vocabularies of the folder cut texts."""
    spec = importlib.util.spec_from_file_location("_tokenizer_files", Path(folder, "__init__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module.PATTERN


def files(folder: str = FOLDER, name: str = VOCABULARY) -> tuple[bytes, str]:
    """A vocabulary's file (some MB at most) and its pattern, as they go to every task; only the driver reads the folder."""
    return Path(folder, name).read_bytes(), pattern(folder)


class Vocabulary:
    """Tokens by id, and the rank (the id of the whole) of every pair of tokens whose join is a token."""

    def __init__(self, data: bytes | None = None):
        ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, (data or files()[0]).splitlines())}
        self.bytes: list[bytes | None] = [None] * (max(ids.values()) + 1)
        for token, i in ids.items():
            self.bytes[i] = token
        self.start = np.array([ids[bytes([i])] for i in range(256)], np.int32)
        pairs = {(ids[a], ids[b]): i for t, i in ids.items() for k in range(1, len(t)) if (a := t[:k]) in ids and (b := t[k:]) in ids}
        self.rank = {a << 32 | b: i for (a, b), i in pairs.items()}
        self._table()

    def _table(self) -> None:
        """The same pairs in an open hash table of numbers, for many look-ups at once."""
        size = 1 << (4 * len(self.rank)).bit_length()
        self.mask = np.uint64(size - 1)
        self.keys = np.full(size, -1, np.int64)
        self.values = np.full(size, NONE, np.int32)
        keys = np.fromiter(self.rank, np.int64, len(self.rank))
        values = np.fromiter(self.rank.values(), np.int32, len(self.rank))
        at = self._slot(keys)
        self.reach = 0
        while len(keys):
            self.reach += 1
            free = self.keys[at] == -1
            first = np.zeros(len(at), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self.keys[at[put]], self.values[at[put]] = keys[put], values[put]
            keys, values, at = keys[~put], values[~put], at[~put] + 1 & int(self.mask)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        h = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((h >> np.uint64(33)) & self.mask).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """NONE where a pair has no rank."""
        keys = left.astype(np.int64) << 32 | right
        at = self._slot(keys)
        out = np.where(self.keys[at] == keys, self.values[at], NONE)
        open_ = np.nonzero((self.keys[at] != keys) & (self.keys[at] != -1))[0]
        step = 1
        while len(open_) and step < self.reach:
            near = at[open_] + step & int(self.mask)
            found = self.keys[near]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[near[hit]]
            open_ = open_[~hit & (found != -1)]
            step += 1
        return out


class Tree:
    """Lowest leaf, leftmost on ties, with point updates."""

    def __init__(self, leaves: list[int]):
        self.size = 1 << max(0, (len(leaves) - 1).bit_length())
        self.low = [int(NONE)] * self.size + leaves + [int(NONE)] * (self.size - len(leaves))
        for k in range(self.size - 1, 0, -1):
            self.low[k] = min(self.low[2 * k], self.low[2 * k + 1])

    def first(self) -> int:
        """Place of the leftmost lowest leaf, or -1."""
        if self.low[1] == NONE:
            return -1
        k = 1
        while k < self.size:
            k = 2 * k + (self.low[2 * k] > self.low[2 * k + 1])
        return k - self.size

    def put(self, place: int, rank: int) -> None:
        k = place + self.size
        self.low[k] = rank
        while k > 1:
            k //= 2
            new = min(self.low[2 * k], self.low[2 * k + 1])
            if new == self.low[k]:
                break
            self.low[k] = new


def encode_piece(piece: bytes, v: Vocabulary) -> list[int]:
    """One piece of any length."""
    ids = v.start[np.frombuffer(piece, np.uint8)].tolist()
    n, none, rank = len(ids), int(NONE), v.rank
    right, left = list(range(1, n + 1)), list(range(-1, n - 1))
    tree = Tree([rank.get(ids[i] << 32 | ids[i + 1], none) for i in range(n - 1)] + [none])
    while (i := tree.first()) >= 0:
        j = right[i]
        ids[i] = tree.low[i + tree.size]
        ids[j] = -1
        k = right[i] = right[j]
        tree.put(j, none)
        tree.put(i, rank.get(ids[i] << 32 | ids[k], none) if k < n else none)
        if k < n:
            left[k] = i
        if (p := left[i]) >= 0:
            tree.put(p, rank.get(ids[p] << 32 | ids[i], none))
    return [i for i in ids if i >= 0]


def _lockstep(rows: np.ndarray, lengths: np.ndarray, v: Vocabulary) -> np.ndarray:
    """Each row of byte values (padded with 0) merged to the end; -1 where a symbol has gone."""
    n, width = rows.shape
    ids = np.where(np.arange(width) < lengths[:, None], v.start[rows], -1).astype(np.int32)
    right = np.tile(np.arange(1, width + 1), (n, 1))
    left = np.tile(np.arange(-1, width - 1), (n, 1))
    tree = np.full((n, 2 * width), NONE, np.int32)
    pair = np.nonzero(np.arange(1, width) < lengths[:, None])
    tree[pair[0], pair[1] + width] = v.ranks(ids[pair], ids[pair[0], pair[1] + 1])
    k = width
    while k > 1:
        tree[:, k // 2 : k] = np.minimum(tree[:, k : 2 * k : 2], tree[:, k + 1 : 2 * k : 2])
        k //= 2
    done = np.empty_like(ids)
    row = np.arange(n)
    while len(row):
        over = tree[:, 1] == NONE
        if over.any():
            done[row[over]] = ids[over]
            stay = ~over
            row, ids, right, left, tree, lengths = row[stay], ids[stay], right[stay], left[stay], tree[stay], lengths[stay]
            if not len(row):
                break
        every = np.arange(len(row))
        node = np.ones(len(row), np.int64)
        while node[0] < width:  # down to the leaf: all rows are at the same depth
            node = 2 * node + (tree[every, 2 * node] > tree[every, 2 * node + 1])
        i = node - width
        j = right[every, i]
        ids[every, i] = tree[every, node]
        ids[every, j] = -1
        k = right[every, j]
        right[every, i] = k
        has = np.nonzero(k < lengths)[0]
        new = np.full(len(row), NONE, np.int32)
        new[has] = v.ranks(ids[has, i[has]], ids[has, k[has]])
        left[has, k[has]] = i[has]
        p = left[every, i]
        before = np.nonzero(p >= 0)[0]
        tree[every, j + width] = NONE
        tree[every, node] = new
        tree[before, p[before] + width] = v.ranks(ids[before, p[before]], ids[before, i[before]])
        for part, leaf in ((every, j + width), (every, node), (before, p[before] + width)):
            up = leaf // 2
            while len(up) and up[0] >= 1:
                tree[part, up] = np.minimum(tree[part, 2 * up], tree[part, 2 * up + 1])
                up = up // 2
    return done


def encode_pieces(pieces: list[bytes], v: Vocabulary) -> list[np.ndarray]:
    """The ids of each piece."""
    out: list[np.ndarray | None] = [None] * len(pieces)
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    width = 1
    while width <= WIDE:
        at = np.nonzero((lengths <= width) & (lengths > width // 2))[0]
        for lo in range(0, len(at), 20_000):
            part = at[lo : lo + 20_000]
            rows = np.frombuffer(b"".join(pieces[i].ljust(width, b"\0") for i in part), np.uint8).reshape(len(part), width)
            made = _lockstep(rows, lengths[part], v) if width > 1 else v.start[rows]
            there = made >= 0
            bounds = np.concatenate([[0], np.cumsum(there.sum(1))])
            flat = made[there]
            for k, i in enumerate(part.tolist()):
                out[i] = flat[bounds[k] : bounds[k + 1]]
        width *= 2
    for i in np.nonzero(lengths > WIDE)[0].tolist():
        out[i] = np.array(encode_piece(pieces[i], v), np.int32)
    return [np.zeros(0, np.int32) if x is None else x for x in out]


class Encoder:
    def __init__(self, given: tuple[bytes, str] | None = None):
        data, cut = given or files()
        self.v = Vocabulary(data)
        self.cut = regex.compile(cut)
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        if len(self.known) > KNOWN:
            self.known = {}
        cut = [self.cut.findall(t) if t is not None else None for t in texts]
        known = self.known
        new = list({w for words in cut if words for w in words if w not in known})
        for w, ids in zip(new, encode_pieces([w.encode() for w in new], self.v), strict=True):
            known[w] = ids.tobytes()
        return [None if words is None else np.frombuffer(b"".join(map(known.__getitem__, words)), np.int32) for words in cut]

    def decode(self, ids: np.ndarray | None) -> str | None:
        """Null for null, and for ids that the vocabulary doesn't have."""
        if ids is None:
            return None
        table = self.v.bytes
        if len(ids) and (min(ids) < 0 or max(ids) >= len(table)):
            return None
        parts = [table[i] for i in (ids.tolist() if isinstance(ids, np.ndarray) else ids)]
        return None if None in parts else b"".join(parts).decode("utf-8", "replace")


def encode(docs: DataFrame, folder: str = FOLDER, name: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, ids, round_trip (whether decoding gives the text) for every row."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())])

    sent = docs.sparkSession.sparkContext.broadcast(files(folder, name))

    def run(batches):
        encoder = Encoder(sent.value)
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            ids = encoder.encode(texts)
            counts = [None if x is None else len(x) for x in ids]
            bounds = np.concatenate([[0], np.cumsum([c or 0 for c in counts])]).astype(np.int32)
            flat = pa.array(np.concatenate([x for x in ids if x is not None] or [np.zeros(0, np.int32)]), pa.int32())
            mask = pa.array([x is None for x in ids], pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(bounds), flat, mask=mask), pa.array([None if t is None else encoder.decode(x) == t for x, t in zip(ids, texts, strict=True)], pa.bool_())],
                names=schema.names,
            )

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decode(encoded: DataFrame, folder: str = FOLDER, name: str = VOCABULARY) -> DataFrame:
    """doc_id, text for every row of (doc_id, ids)."""
    schema = T.StructType([T.StructField("doc_id", encoded.schema["doc_id"].dataType), T.StructField("text", T.StringType())])

    sent = encoded.sparkSession.sparkContext.broadcast(files(folder, name))

    def run(batches):
        encoder = Encoder(sent.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None or None in x else encoder.decode(x) for x in b.column(1).to_pylist()], pa.string())], names=schema.names)

    return encoded.select("doc_id", "ids").mapInArrow(run, schema)
