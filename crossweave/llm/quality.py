"""Quality classifier: attention-based multiple-instance learning over the passages of a document.

A document is a bag of passages of ``PASSAGE`` words. Every passage is encoded by shape features and a dense layer; a gated
attention (tanh times sigmoid) learns from the documents' labels how much each passage counts, and the weighted mean of the
encodings is classified. Labels belong to documents only, passages have none.

The model is fitted on about ``SAMPLE`` labelled documents, and of these on those with ``LONGEST`` passages at most; its statistics
and weights are a few kilobytes. All documents are scored, over all their passages.

Null and empty texts are scored as one passage of zeros. Without labels of both kinds every score is the share of label 1, or
0.5 if there is none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import texts as T
from .sampling import labelled_sample, learning_rows

PASSAGE = 48
SAMPLE = 4_000
LONGEST = 512
FEATURES = 18
HIDDEN = 16
GATE = 8
ROUNDS = 300
ACCEPT = 0.7

_CLASS = np.zeros((256, 8), np.int8)  # upper, lower, other letters, digits, sentence marks, symbols, bars, line ends
_CLASS[65:91, 0] = 1
_CLASS[97:123, 1] = 1
_CLASS[128:, 2] = 1
_CLASS[48:58, 3] = 1
_CLASS[[ord(c) for c in ".,;:'\"()-"], 4] = 1
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"()-|"], 5] = 1
_CLASS[ord("|"), 6] = 1
_CLASS[10, 7] = 1


def _sums(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[b] - total[a]


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of the texts, and the first passage of each text. A text without words has one of zeros."""
    starts, ends, first = T.spans(data, offsets, T.NOT_SPACE)
    n = np.diff(first)
    pieces = np.maximum(1, -(-n // PASSAGE))
    at = np.concatenate([[0], np.cumsum(pieces)])
    doc = np.repeat(np.arange(len(n)), pieces)
    a = first[:-1][doc] + PASSAGE * (np.arange(at[-1]) - at[doc])
    b = np.minimum(a + PASSAGE, first[1:][doc])
    count = (b - a).astype(float)
    out = np.zeros((at[-1], FEATURES), np.float32)
    full = np.flatnonzero(count > 0)
    if len(full) == 0:
        return out, at
    a, b, count = a[full], b[full], count[full]
    lo, hi = starts[a], ends[b - 1]
    length = (hi - lo).astype(float)
    for j in range(8):
        out[full, j] = _sums(_CLASS[data, j], lo, hi) / length
    h = T.word_hashes(T.LOWER[data], starts, ends)
    sizes = ends - starts
    again = np.zeros(len(h), bool)  # words that the document has had before
    repeated = np.zeros(len(h), bool)
    for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if y > x:
            _, where = np.unique(h[x:y], return_index=True)
            again[x:y] = True
            again[x + where] = False
    repeated[1:] = h[1:] == h[:-1]
    last = data[ends - 1]
    out[full, 8] = _sums(again, a, b) / count
    out[full, 9] = _sums(repeated, a, b) / count
    out[full, 10] = _sums(sizes, a, b) / count / 10
    out[full, 11] = np.sqrt(np.maximum(0, _sums(sizes * sizes, a, b) / count - (_sums(sizes, a, b) / count) ** 2)) / 10
    out[full, 12] = _sums(sizes <= 3, a, b) / count
    out[full, 13] = _sums(sizes >= 10, a, b) / count
    out[full, 14] = _sums(_CLASS[last, 4] > 0, a, b) / count
    out[full, 15] = _sums(_CLASS[last, 5] + _CLASS[last, 6] > 0, a, b) / count
    out[full, 16] = np.log1p(count) / 4
    out[full, 17] = np.log1p(n[doc[full]]) / 10
    return out, at


class Model:
    """The encoder, the attention and the classifier."""

    def __init__(self, mean, scale, weights, constant=None):
        self.mean, self.scale, self.weights, self.constant = mean, scale, weights, constant

    def score(self, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The score of each bag, and the attention of each passage within its bag."""
        if self.constant is not None:
            return np.full(len(at) - 1, self.constant), np.zeros(len(x))
        return _forward((x - self.mean) / self.scale, at, self.weights)[:2]


def _forward(x, at, w):
    h = np.tanh(x @ w["W"] + w["b"])
    v, u = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-np.clip(h @ w["U"], -30, 30)))
    e = (v * u) @ w["a"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, at[:-1]), np.diff(at)))
    attention = e / np.repeat(np.add.reduceat(e, at[:-1]), np.diff(at))
    z = np.add.reduceat(attention[:, None] * h, at[:-1], axis=0)
    p = 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["d"], -30, 30)))
    return p, attention, h, v, u, z


def fit(x: np.ndarray, at: np.ndarray, y: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Minimizes the log loss with Adam from a fixed start."""
    if len(y) == 0 or y.min() == y.max():
        return Model(None, None, None, float(y[0]) if len(y) else 0.5)
    x = x.astype(np.float64)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    x = (x - mean) / scale
    rng = np.random.default_rng(3)
    shape = {"W": (FEATURES, HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "a": (GATE,), "c": (HIDDEN,), "d": ()}
    w = {k: rng.normal(0, 0.3, s) if s else np.float64(0) for k, s in shape.items()}
    m, s = {k: 0 * v for k, v in w.items()}, {k: 0 * v for k, v in w.items()}
    bag = np.repeat(np.arange(len(y)), np.diff(at))
    for t in range(1, rounds + 1):
        p, attention, h, v, u, z = _forward(x, at, w)
        g = (p - y) / len(y)
        gz = g[:, None] * w["c"]
        own = gz[bag]
        ge = attention * ((h - z[bag]) * own).sum(1)
        gv, gu = ge[:, None] * w["a"] * u * (1 - v * v), ge[:, None] * w["a"] * v * u * (1 - u)
        gh = (attention[:, None] * own + gv @ w["V"].T + gu @ w["U"].T) * (1 - h * h)
        grad = {"W": x.T @ gh, "b": gh.sum(0), "V": h.T @ gv, "U": h.T @ gu, "a": (v * u).T @ ge, "c": z.T @ g, "d": g.sum()}
        for k in w:
            grad[k] = grad[k] + 1e-4 * w[k]
            m[k], s[k] = 0.9 * m[k] + 0.1 * grad[k], 0.999 * s[k] + 0.001 * grad[k] ** 2
            w[k] = w[k] - 0.02 * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
    return Model(mean, scale, w)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    rows = labelled_sample(learning_rows(docs, labels, "quality"), sample)

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in T.slices(batch.column(2)):
                x, at = passages(data, offsets)
                keep = [i for i in range(hi - lo) if at[i + 1] - at[i] <= LONGEST]
                yield pa.record_batch([
                    batch.column(0).slice(lo, hi - lo).take(pa.array(keep, pa.int64())), batch.column(1).slice(lo, hi - lo).take(pa.array(keep, pa.int64())),
                    pa.array([x[at[i] : at[i + 1]].tobytes() for i in keep], pa.binary()),
                ], names=["doc_id", "y", "x"])

    with T.small_batches(docs.sparkSession):
        found = T.over_batches(rows.select("doc_id", "y", "text"), run, "doc_id long, y int, x binary").toPandas().sort_values(["doc_id", "x"])
    bags = [np.frombuffer(b, np.float32).reshape(-1, FEATURES) for b in found["x"]]
    at = np.concatenate([[0], np.cumsum([len(b) for b in bags])]).astype(np.int64)
    return fit(np.concatenate(bags) if bags else np.zeros((0, FEATURES), np.float32), at, found["y"].to_numpy(np.float64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and n_passages of every document."""

    def work():
        def step(data, offsets):
            x, at = passages(data, offsets)
            return [model.score(x, at)[0], np.diff(at)]

        return step

    return T.per_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id", "text"], "doc_id long, score double, n_passages long", work)
