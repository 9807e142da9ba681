"""Quality classifier: random-indexing word vectors, pooled per document, and a
two-layer network with calibrated probabilities.

Random indexing: every token (hashed to one of ``BUCKETS``) has a sparse random
index vector; a token's word vector is the sum of its neighbours' index vectors
over the whole corpus, log-scaled and normalised.  A document is the mean and the spread
of its tokens' vectors, the share of tokens that repeat the one before, and the
log of their number.
The network (numpy) is fitted on a bounded sample of labelled rows; a
temperature, fitted on rows kept aside, calibrates its probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import common, wordhash

BUCKETS, DIM = 1 << 14, 32
#: Entries of an index vector: places and signs.
SEEDS = 2
#: Labelled rows that the network is fitted on, at most.
MOST_ROWS = 20_000
#: Values per document.
WIDTH = 2 * DIM + 2


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    hashes, at = wordhash.words(column, wordhash.TOKENS, wordhash.KEEP_CASE)
    return (hashes >> np.uint64(64 - 14)).astype(np.int64), at


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """(places, signs), each SEEDS x BUCKETS, from a rule."""
    h = np.stack([wordhash.mix(np.arange(BUCKETS, dtype=np.uint64) * np.uint64(SEEDS) + np.uint64(k + 1)) for k in range(SEEDS)])
    return (h % np.uint64(DIM)).astype(np.int64), 1.0 - 2.0 * ((h >> np.uint64(40)) & np.uint64(1)).astype(float)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """BUCKETS x DIM unit vectors from the neighbours (one to each side) of
    every token of every document.  Buckets that no token falls in are zero."""
    place, sign = _index_vectors()

    def fold(batches):
        total = np.zeros(BUCKETS * DIM)
        for batch in batches:
            for part in wordhash.slices(batch, "text", 1 << 22):
                token, at = _tokens(part.column("text"))
                inner = np.ones(len(token), bool)
                inner[at[:-1][at[:-1] < len(token)]] = False  # first tokens have no left neighbour
                right = np.flatnonzero(inner)
                for a, b in ((token[right - 1], token[right]), (token[right], token[right - 1])):
                    for k in range(SEEDS):
                        total += np.bincount(a * DIM + place[k][b], sign[k][b], BUCKETS * DIM)
        return np.rint(total).astype(np.int64)

    summed = common.sum_arrays(docs.select("text"), fold, BUCKETS * DIM).reshape(BUCKETS, DIM).astype(float)
    vectors = np.sign(summed) * np.log1p(np.abs(summed))
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0).astype(np.float32)


def _features(column: pa.Array, by_dim: np.ndarray) -> np.ndarray:
    """Mean and standard deviation of the token vectors, share of tokens that
    repeat the one before, log count: WIDTH floats a row, zeros without tokens."""
    token, at = _tokens(column)
    size = np.diff(at)
    full = np.flatnonzero(size)
    out = np.zeros((len(size), WIDTH), np.float32)
    out[:, -1] = np.log1p(size)
    if len(full):
        start, n = at[:-1][full], size[full]
        again = np.append(False, token[1:] == token[:-1])
        again[start] = False
        out[full, -2] = np.add.reduceat(again, start, dtype=np.float64) / n
        for d in range(DIM):
            x = by_dim[d][token]
            mean = np.add.reduceat(x, start, dtype=np.float64) / n
            square = np.add.reduceat(x * x, start, dtype=np.float64) / n
            out[full, d] = mean
            out[full, DIM + d] = np.sqrt(np.maximum(square - mean * mean, 0))
    return out


def pooled(docs: DataFrame, table) -> DataFrame:
    """``docs`` (doc_id, text, ...) as (doc_id, features); ``table`` is the
    broadcast of the word vectors, one row per dimension."""
    def run(batches):
        for batch in batches:
            for part in wordhash.slices(batch, "text", 1 << 20):
                out = _features(part.column("text"), table.value)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([x.tobytes() for x in out], pa.binary())], names=["doc_id", "features"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, "doc_id long, features binary")


@dataclass
class Network:
    """score = sigmoid(logit / temperature) of a tanh layer over standardised features."""
    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.centre) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 64, epochs: int = 60, batch: int = 256, rate: float = 3e-3,
        decay: float = 1e-3, seed: int = 7) -> Network:
    """Adam on the logistic loss over four fifths of the rows, temperature on
    the rest.  Without rows, or with one class only, the network is constant:
    the smoothed share of label 1."""
    rng = np.random.default_rng(seed)
    n, dim = x.shape
    share = (y.sum() + 1) / (n + 2)
    if n < 10 or y.min() == y.max():
        return Network(np.zeros(dim), np.ones(dim), np.zeros((dim, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))))
    order = rng.permutation(n)
    aside, rows = order[:n // 5], order[n // 5:]
    centre, scale = x[rows].mean(axis=0), x[rows].std(axis=0) + 1e-3
    net = Network(centre, scale, rng.normal(0, dim ** -0.5, (dim, hidden)), np.zeros(hidden),
                  rng.normal(0, hidden ** -0.5, hidden), float(np.log(share / (1 - share))))
    params = [net.w1, net.b1, net.w2, np.array([net.b2])]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    z = (x - centre) / scale
    for _ in range(epochs):
        rng.shuffle(rows)
        for at in range(0, len(rows), batch):
            zi, yi = z[rows[at:at + batch]], y[rows[at:at + batch]]
            h = np.tanh(zi @ params[0] + params[1])
            g = (1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -500, 500))) - yi) / len(yi)
            gh = np.outer(g, params[2]) * (1 - h * h)
            grads = [zi.T @ gh + decay * params[0], gh.sum(axis=0), h.T @ g + decay * params[2], np.array([g.sum()])]
            step += 1
            for i, d in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * d
                v[i] = 0.999 * v[i] + 0.001 * d * d
                params[i] -= rate * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.999 ** step)) + 1e-8)
    net.b2 = float(params[3][0])
    logit, yy = net.logits(x[aside]), y[aside]
    trials = np.exp(np.linspace(np.log(0.25), np.log(8), 81))
    loss = [np.logaddexp(0, np.where(yy == 1, -logit, logit) / t).mean() for t in trials]
    net.temperature = float(trials[int(np.argmin(loss))])
    return net


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _sample(features: DataFrame, labels: DataFrame, most_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``most_rows`` labelled rows, the first by a hash of the id."""
    known = (labels.select(F.col("doc_id").cast("long").alias("__id"), F.col("quality").alias("__quality"))
             .filter(F.col("__quality").isin(0, 1) & F.col("__id").isNotNull() & ~held_out(F.col("__id")))
             .groupBy("__id").agg(F.min("__quality").alias("__quality")))
    place = F.pmod(F.xxhash64("__id"), F.lit(1 << 32))
    n = features.select("doc_id").join(known, F.col("doc_id") == F.col("__id"), "left_semi").count()
    # rows beyond this place are not among the first (but for a chance of 1e-9), so tasks don't send them
    last = int(min(1.0, 1.2 * most_rows / max(n, 1) + 1e-4) * (1 << 32))
    rows = (features.join(known.withColumn("__place", place).filter(F.col("__place") <= last), F.col("doc_id") == F.col("__id"))
            .select("doc_id", "features", "__quality", "__place")
            .orderBy("__place", "doc_id", "features").limit(most_rows).collect())
    x = np.array([np.frombuffer(r["features"], np.float32) for r in rows], float).reshape(len(rows), WIDTH)
    return x, np.array([r["__quality"] for r in rows], float)


def _fitted(docs: DataFrame, labels: DataFrame, most_rows: int):
    """Written features of all rows, the broadcast word vectors and the network."""
    table = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(word_vectors(docs).T))
    features = common.stash(pooled(docs, table), "quality-features")
    return features, table, fit(*_sample(features, labels, most_rows))


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, most_rows: int = MOST_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Null and empty texts have zero features and the score of those.  Rows that
    repeat a doc_id are scored each by its own text.  Repeated labels of an id
    count as its smallest; null or other labels are not learned from.  A null
    doc_id is not held out (it has no label either).  Without usable labels
    every score is the same."""
    features, _, net = _fitted(docs, labels, most_rows)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.stack([np.frombuffer(v.as_buffer(), np.float32) for v in batch.column("features")]).astype(float)
                s = net.scores(x)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                                                 names=["doc_id", "score", "predicted"])
    scored = features.mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, most_rows: int = MOST_ROWS) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``threshold``, all columns."""
    _, table, net = _fitted(docs, labels, most_rows)

    def run(batches):
        for batch in batches:
            for part in wordhash.slices(batch, "text", 1 << 20):
                good = net.scores(_features(part.column("text"), table.value).astype(float)) >= threshold
                yield part.filter(pa.array(good))
    return docs.mapInArrow(run, docs.schema)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
