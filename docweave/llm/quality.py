"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Words (lower case), runs of other visible characters and a mark for each run of capitals fall into
``BUCKETS`` by hash.  A bucket's vector is a sparse ternary signature plus the scaled sum of the signatures
of the words near its own in all documents (random indexing).  A document is pooled three times: the mean of its vectors,
and their sums weighted by how strongly their words speak for quality and for toxicity.  A network with
one hidden layer gives two logits, quality and toxicity; each is divided by a temperature fitted on
held-out documents, so that its sigmoid is a calibrated probability.

Word weights, network and temperatures are fitted on at most ``SAMPLE`` labelled documents (those of lowest hash of doc_id), the bound
being a parameter; scoring covers every document and its whole text.

Defined results: null, empty and blank texts pool to zeros and get the network's answer to that; without
a labelled document there is no model, both probabilities are null and all is kept; labels that are
null, or without a document, don't count; of labels that clash the worse one does (low quality, toxic); repeated rows get the same answer each; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._packed import lists, planes, runs, unplanes

SAMPLE = 4000
BUCKETS = 1 << 16
DIM, NONZERO, NEAR = 64, 4, 2
HIDDEN = 32
EPOCHS, BATCH, RATE, DECAY = 60, 128, 3e-3, 1e-4
HELD_OUT = 0.2
SEED = 20240229
#: A word's weight counts from this z-score on.
SURE = 4.0
CHUNK = 300_000
#: Rows of vectors that are summed at once: so many stay in a core's cache.
ROWS = 1024
#: Tokens whose contexts are summed at once, and buckets that a partial sum's row holds.
SUMMED, SPAN = 1_000_000, 256


def buckets(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(F.lower(t), F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"), 0)
    capitals = F.array_repeat(F.lit("<capitals>"), F.regexp_count(t, F.lit(r"\p{Lu}{2,}")))
    return F.transform(F.concat(words, capitals), lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))


def signatures() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of every bucket's signature."""
    r = np.random.default_rng(SEED)
    places = np.argsort(r.random((BUCKETS, DIM), np.float32), axis=1)[:, :NONZERO]
    return places, r.choice(np.array([-1.0, 1.0], np.float32), (BUCKETS, NONZERO))


def context_sums(flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For every bucket, the sum of the signatures (their signs) near its words."""
    places, signs = signatures()
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    context = np.zeros(BUCKETS * DIM)
    for off in range(1, NEAR + 1):
        same = doc[off:] == doc[:-off]
        a, b = flat[:-off][same], flat[off:][same]
        for word, near in ((a, b), (b, a)):
            for k in range(NONZERO):
                context += np.bincount(word.astype(np.int64) * DIM + places[near, k], signs[near, k], BUCKETS * DIM)
    return context.astype(np.int64)


def word_vectors(sums: np.ndarray) -> np.ndarray:
    places, signs = signatures()
    own = np.zeros((BUCKETS, DIM), np.float32)
    own[np.arange(BUCKETS)[:, None], places] = signs / np.sqrt(NONZERO)
    context = sums.reshape(BUCKETS, DIM).astype(np.float64)
    seen = np.sqrt((context * context).sum(1, keepdims=True))
    return own + np.where(seen > 0, context / np.maximum(seen, 1e-9), 0).astype(np.float32)


def corpus_sums(docs: DataFrame) -> np.ndarray:
    """context_sums of all documents: each task's sums go by spans of buckets as byte planes, and one array of BUCKETS x DIM reaches the driver."""
    schema = pa.schema([("span", pa.int32()), ("sums", pa.binary())])

    def run(batches):
        total, kept, size = np.zeros(BUCKETS * DIM, np.int64), [], 0

        def add():
            flat = np.concatenate([f for f, _ in kept])
            ends = np.cumsum(np.concatenate([[0], *(np.diff(b) for _, b in kept)]))
            np.add(total, context_sums(flat, ends), out=total)
            kept.clear()

        for b in batches:
            flat, bounds = lists(b.column(0))
            for lo, hi in runs(bounds, SUMMED):
                kept.append((flat[bounds[lo] : bounds[hi]].copy(), bounds[lo : hi + 1] - bounds[lo]))
                size += len(kept[-1][0])
                if size >= SUMMED:
                    add()
                    size = 0
        if kept:
            add()
        part = total.reshape(-1, SPAN * DIM)
        for i in np.nonzero(part.any(1))[0]:
            # Signs go into the lowest bit, so that small numbers have zero planes.
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([planes((part[i] << 1) ^ (part[i] >> 63))], pa.binary())], schema=schema)

    def added(t: pa.Table) -> pa.Table:
        total = np.zeros(SPAN * DIM, np.int64)
        for x in t.column("sums"):
            z = unplanes(x.as_py(), np.int64)
            total += (z >> 1) ^ -(z & 1)
        return pa.table({"span": t.column("span").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    kind = "span int, sums binary"
    sums = np.zeros((BUCKETS // SPAN, SPAN * DIM), np.int64)
    for r in docs.select("w").mapInArrow(run, kind).groupBy("span").applyInArrow(added, kind).toArrow().to_pylist():
        sums[r["span"]] = np.frombuffer(r["sums"], np.int64)
    return sums.ravel()


def word_weights(flat: np.ndarray, bounds: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Log odds of the documents that have a word, 0 where they aren't sure."""
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    there = np.unique(doc.astype(np.int64) * BUCKETS + flat)
    word, of = there % BUCKETS, y[there // BUCKETS]
    n1, n0 = max(y.sum(), 1), max((1 - y).sum(), 1)
    d1, d0 = np.bincount(word, of, BUCKETS), np.bincount(word, 1 - of, BUCKETS)
    s = np.log((d1 + 0.5) / (n1 + 1)) - np.log((d0 + 0.5) / (n0 + 1))
    rate = (d1 + d0) / (n1 + n0)
    z = (d1 / n1 - d0 / n0) / np.sqrt(np.maximum(rate * (1 - rate), 1e-12) * (1 / n1 + 1 / n0))
    return np.where(np.abs(z) > SURE, s, 0).astype(np.float32)


def pooled(flat: np.ndarray, bounds: np.ndarray, vectors: np.ndarray, weights: list[np.ndarray]) -> np.ndarray:
    """Features of each document."""
    n = len(bounds) - 1
    out = np.zeros((n, DIM * (1 + len(weights))), np.float32)

    def total(ids: np.ndarray, at: np.ndarray, w: np.ndarray | None) -> np.ndarray:
        sums = np.zeros((n, DIM), np.float32)
        ends = at.tolist()
        for i in np.nonzero(np.diff(at))[0].tolist():
            for lo in range(ends[i], ends[i + 1], ROWS):
                own = ids[lo : min(lo + ROWS, ends[i + 1])]
                x = vectors.take(own, 0)
                if w is not None:
                    x *= w.take(own)[:, None]
                sums[i] += np.add.reduce(x)
        return sums

    for lo, hi in runs(bounds, CHUNK):
        if (lo, hi) != (0, n):
            out[lo:hi] = pooled(flat[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo], vectors, weights)
            if hi == n:
                return out
    out[:, :DIM] = total(flat, bounds, None) / np.maximum(np.diff(bounds), 1)[:, None]
    for k, w in enumerate(weights):
        some = w[flat] != 0
        at = np.concatenate([[0], np.cumsum(some)])[bounds]
        s = total(flat[some], at, w)
        out[:, DIM * (k + 1) : DIM * (k + 2)] = np.sign(s) * np.log1p(np.abs(s))
    return out


def _forward(x: np.ndarray, net: dict) -> tuple[np.ndarray, np.ndarray]:
    h = np.maximum(x @ net["w1"] + net["b1"], 0)
    return h, h @ net["w2"] + net["b2"]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(x: np.ndarray, y: np.ndarray) -> dict:
    """Adam on the mean cross-entropy of both outputs."""
    r = np.random.default_rng(SEED)
    net = {"w1": r.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), "b1": np.zeros(HIDDEN), "w2": r.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, y.shape[1])), "b2": np.zeros(y.shape[1])}
    m, v = ({k: np.zeros_like(p) for k, p in net.items()} for _ in range(2))
    step = 0
    for _ in range(EPOCHS):
        order = r.permutation(len(x))
        for lo in range(0, len(x), BATCH):
            at = order[lo : lo + BATCH]
            h, z = _forward(x[at], net)
            d = (_sigmoid(z) - y[at]) / len(at)
            back = (d @ net["w2"].T) * (h > 0)
            grads = {"w2": h.T @ d, "b2": d.sum(0), "w1": x[at].T @ back, "b1": back.sum(0)}
            step += 1
            for k, g in grads.items():
                g = g + DECAY * net[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                net[k] = net[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return net


def temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The one of least cross-entropy on held-out logits."""
    if not len(z):
        return 1.0
    tried = np.exp(np.linspace(np.log(0.25), np.log(10), 200))
    loss = [(np.logaddexp(0, z / t) - y * z / t).mean() for t in tried]
    return float(tried[int(np.argmin(loss))])


def fit(flat: np.ndarray, bounds: np.ndarray, y: np.ndarray, sums: np.ndarray) -> dict:
    """sums: of contexts; y: a row of quality and toxicity for each document."""
    held = np.random.default_rng(SEED + 1).random(len(y)) < HELD_OUT
    if held.all() or not held.any():
        held[:] = False
    keep = np.repeat(~held, np.diff(bounds))
    own = np.concatenate([[0], np.cumsum(np.diff(bounds)[~held])])
    model = {"vectors": word_vectors(sums)}
    model["weights"] = [word_weights(flat[keep], own, y[~held, k]) for k in range(y.shape[1])]
    x = pooled(flat, bounds, model["vectors"], model["weights"])
    model["mean"], model["scale"] = x[~held].mean(0), x[~held].std(0) + 1e-3
    x = (x - model["mean"]) / model["scale"]
    model["net"] = train(x[~held].astype(float), y[~held].astype(float))
    z = _forward(x[held], model["net"])[1]
    model["temperature"] = [temperature(z[:, k], y[held, k]) for k in range(y.shape[1])]
    return model


def predict(flat: np.ndarray, bounds: np.ndarray, model: dict) -> np.ndarray:
    """Probabilities of quality and toxicity."""
    x = (pooled(flat, bounds, model["vectors"], model["weights"]) - model["mean"]) / model["scale"]
    return _sigmoid(_forward(x, model["net"])[1] / np.array(model["temperature"]))


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict | None:
    """The model from at most so many labelled documents, and the contexts of all documents; only bucket numbers and sums reach the driver."""
    y = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_q"), F.coalesce(F.col("toxic").cast("int"), F.lit(0)).alias("_t")).filter("_id is not null and _q is not null")
    y = y.groupBy("_id").agg(F.min("_q").alias("_q"), F.max("_t").alias("_t")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    t = docs.join(F.broadcast(y), docs["doc_id"] == y["_id"]).select("_id", "_q", "_t", buckets(F.col("text")).alias("w")).toArrow()
    if not t.num_rows:
        return None
    t = t.combine_chunks().sort_by("_id")
    flat, bounds = lists(t.column("w").combine_chunks() if t.column("w").num_chunks != 1 else t.column("w").chunk(0))
    return fit(flat, bounds, np.stack([t.column("_q").to_numpy(), t.column("_t").to_numpy()], 1), corpus_sums(docs.select(buckets(F.col("text")).alias("w"))))


def quality_classifier(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, quality, toxic (probabilities), keep (good quality and not toxic) for every row."""
    model = fitted(docs.select("doc_id", "text"), labels, sample)
    if model is None:
        return docs.select("doc_id", F.lit(None).cast("double").alias("quality"), F.lit(None).cast("double").alias("toxic"), F.lit(True).alias("keep"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("quality", T.DoubleType()), T.StructField("toxic", T.DoubleType()), T.StructField("keep", T.BooleanType())])

    def run(batches):
        for b in batches:
            flat, bounds = lists(b.column(1))
            for lo, hi in runs(bounds, CHUNK):
                p = predict(flat[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo], sent.value)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(np.round(p[:, 0], 6)), pa.array(np.round(p[:, 1], 6)), pa.array((p[:, 0] >= 0.5) & (p[:, 1] < 0.5))], names=schema.names)

    return docs.select("doc_id", buckets(F.col("text")).alias("w")).mapInArrow(run, schema)
