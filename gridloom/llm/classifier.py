"""Quality scores from random-indexing word vectors and a small network.

Every word (hashed to a fixed number of rows) has a sparse random index vector; its context
vector is the sum of the index vectors of its neighbours over the whole corpus, in integers, so
that the sum does not depend on the order.  A document is the mean of its words' context vectors
beside a few surface ratios.  A two-layer network learns the label on a bounded sample of labelled
rows; a temperature, fitted on rows kept from training, calibrates its probabilities.

Texts that are null or empty have all-zero features and get a score like others.  Null labels
teach nothing; without labels of both kinds every score is the share of label 1 (0.5 without any).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import textkit as tk
from .store import Scratch, Shared

ROWS, DIM, WINDOW, HIDDEN = 1 << 14, 32, 2, 24
#: Labelled rows that the network is fitted on, at most (those whose id hashes lowest).
SAMPLE = 50_000
FOLDS = 5


def index_vectors() -> np.ndarray:
    """Six entries of +-1 in each row."""
    rng = np.random.Generator(np.random.PCG64(20))
    out = np.zeros((ROWS, DIM), np.int8)
    cols = np.argsort(rng.random((ROWS, DIM)), axis=1)[:, :6]
    np.put_along_axis(out, cols, rng.integers(0, 2, (ROWS, 6), dtype=np.int8) * 2 - 1, axis=1)
    return out


def _rows(h: np.ndarray) -> np.ndarray:
    return (h >> tk.U64(50)).astype(np.int64)


def context_vectors(docs: DataFrame, scratch: Scratch) -> np.ndarray:
    """ROWS x DIM unit vectors from all of ``docs``; each task sends a sum per row, so its size is fixed."""
    names = [f"c{d}" for d in range(DIM)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_vectors().astype(np.int32)
        total = np.zeros((ROWS, DIM), np.int64)
        for batch in batches:
            for _, _, data, offsets in tk.pieces(batch):
                _, _, h, bounds = tk.words(data, offsets)
                if not len(h):
                    continue
                b = _rows(h)
                doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                near = np.zeros((len(b), DIM), np.int32)
                for o in range(1, WINDOW + 1):
                    same = (doc[o:] == doc[:-o])[:, None]
                    near[:-o] += index[b[o:]] * same
                    near[o:] += index[b[:-o]] * same
                order = np.argsort(b, kind="stable")
                kinds, at = np.unique(b[order], return_index=True)
                total[kinds] += np.add.reduceat(near[order], at, axis=0)
        used = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used), *[pa.array(total[used, d]) for d in range(DIM)]], ["row", *names])

    sums = docs.select("text").mapInArrow(run, ", ".join(["row long", *[f"{c} long" for c in names]]))
    sums = sums.groupBy("row").agg(*[F.sum(c).alias(c) for c in names])
    out = np.zeros((ROWS, DIM))
    for r in sums.collect():  # ROWS at most, whatever the input
        out[r[0]] = r[1:]
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm == 0, 1, norm)).astype(np.float32)


SURFACE = 9


def features(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """(doc_id, x array<float>) from whole texts alone."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vec = shared.value
        kind = np.zeros((256, 5), np.float32)
        kind[[ord(c) for c in "#*$%&|<>"], 0] = 1
        kind[65:91, 1] = 1
        kind[48:58, 2] = 1
        kind[[ord(c) for c in "!?"], 3] = 1
        kind[128:, 4] = 1
        for batch in batches:
            for first, last, data, offsets in tk.pieces(batch):
                starts, ends, h, bounds = tk.words(data, offsets)
                n = np.diff(bounds)
                x = np.zeros((len(n), DIM + SURFACE), np.float32)
                full = n > 0
                if full.any():
                    at = bounds[:-1][full]
                    b = _rows(h)
                    x[full, :DIM] = np.add.reduceat(vec[b], at, axis=0) / n[full, None]
                    chars = np.add.reduceat(ends - starts, at)
                    for k in range(5):
                        solid = np.concatenate([[0], np.cumsum(kind[:, k][data], dtype=np.float64)])
                        x[full, DIM + k] = (solid[offsets[1:]] - solid[offsets[:-1]])[full] / chars
                    doc = np.repeat(np.arange(len(n)), n)
                    order = np.lexsort((h, doc))
                    new = np.ones(len(h), bool)
                    new[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
                    x[full, DIM + 5] = np.add.reduceat(new.astype(np.float32), at) / n[full]
                    x[full, DIM + 6] = np.log1p(n[full])
                    x[full, DIM + 7] = chars / n[full] / 10
                    breaks = np.concatenate([[0], np.cumsum(data == 10)])
                    x[full, DIM + 8] = np.log1p(n[full] / (1 + (breaks[offsets[1:]] - breaks[offsets[:-1]])[full]))
                yield pa.RecordBatch.from_arrays([batch["doc_id"][first:last], pa.array(list(x), pa.list_(pa.float32()))], ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, x array<float>")


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Network:
    """Two layers in numpy; ``score`` is the calibrated probability of label 1."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 5, epochs: int = 60):
        self.flat = None
        if not len(y) or y.min() == y.max():
            self.flat = float(y.mean()) if len(y) else 0.5
            return
        rng = np.random.Generator(np.random.PCG64(seed))
        held = rng.random(len(y)) < 0.2
        if len(np.unique(y[held])) < 2 or len(np.unique(y[~held])) < 2:
            held = np.zeros(len(y), bool)
        a, t = x[~held], y[~held]
        self.mean, self.std = a.mean(0), a.std(0) + 1e-6
        a = (a - self.mean) / self.std
        p = [rng.normal(0, 1 / np.sqrt(a.shape[1]), (a.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, v, k = [np.zeros_like(w) for w in p], [np.zeros_like(w) for w in p], 0
        for _ in range(max(epochs, 20_000 // len(t))):
            order = rng.permutation(len(t))
            for at in range(0, len(t), 256):
                i = order[at : at + 256]
                z = np.tanh(a[i] @ p[0] + p[1])
                d = (_sigmoid(z @ p[2] + p[3]) - t[i]) / len(i)
                dz = np.outer(d, p[2]) * (1 - z * z)
                grads = [a[i].T @ dz + 1e-4 * p[0], dz.sum(0), z.T @ d + 1e-4 * p[2], d.sum(keepdims=True)]
                k += 1
                for j, g in enumerate(grads):
                    m[j] = 0.9 * m[j] + 0.1 * g
                    v[j] = 0.999 * v[j] + 0.001 * g * g
                    p[j] = p[j] - 0.01 * (m[j] / (1 - 0.9**k)) / (np.sqrt(v[j] / (1 - 0.999**k)) + 1e-8)
        self.p, self.temperature = p, 1.0
        if held.any():
            z = self.logit(x[held])
            grid = np.exp(np.linspace(-1, 2.5, 71))
            loss = [np.mean(np.logaddexp(0, np.where(y[held] == 1, -z, z) / g)) for g in grid]
            self.temperature = float(grid[int(np.argmin(loss))])

    def logit(self, x: np.ndarray) -> np.ndarray:
        p = self.p
        return np.tanh((x - self.mean) / self.std @ p[0] + p[1]) @ p[2] + p[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.flat is not None:
            return np.full(len(x), self.flat)
        return _sigmoid(self.logit(x) / self.temperature)


def fit(feats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network:
    """A network from labels (doc_id, quality) of the folds but 0."""
    known = labels.where(F.col("quality").isNotNull() & (fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).join(feats, "doc_id").select("doc_id", "quality", "x").toPandas()
    rows = rows.sort_values("doc_id")
    x = np.array(rows["x"].tolist(), np.float64).reshape(len(rows), DIM + SURFACE)
    return Network(x, (rows["quality"].to_numpy() == 1).astype(np.float64))


def classify(docs: DataFrame, labels: DataFrame, scratch: Scratch, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each document."""
    feats = scratch.table(features(docs, context_vectors(docs, scratch)), "features", wide=True)
    net = Shared(docs.sparkSession, fit(feats, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch["x"].flatten().to_numpy().reshape(-1, DIM + SURFACE).astype(np.float64)
            s = net.get().score(x)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    held = feats.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "x")
    return held.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
