"""Toxicity: a support vector machine on a subsequence string kernel, with Nyström landmarks.

Strings are windows of ``WINDOW`` letters over every word; a mark stands before a word's first letter and after its last. The kernel compares two
windows by all their subsequences of three letters, each weighted by ``DECAY`` to the power of the stretch it covers, so an insult
with letters left out or put in stays near. Characters that are no letters are dropped inside words and runs of single letters
are read as one word ("i-d-i-o-t", "i d i o t"). Its normalized value is raised to ``POWER``; values below ``FLOOR`` count as none.

Landmarks are words and word beginnings that are ``RATIO`` times as frequent in toxic documents as in others, no two of them alike.
Beginnings of usual words that come near a landmark are kept beside them: a window nearer to one of these than to any landmark
counts as none. A sentence is
described by the largest kernel value with each landmark over its windows, mapped by the inverse root of the landmarks' kernel matrix
(Nyström). The machine is trained on labelled sentences: all sentences of documents labelled 0, and of documents labelled 1 the
one that scores highest, chosen anew in a few rounds. A logistic curve over the margin of a document's worst sentence and the
number and rate of its bad ones, fitted to the learning documents, is the score.

Which windows can be near a landmark at all follows from the letters they hold: the kernel is bounded by the part of
the landmark made of those letters. Windows below the bound are passed over, which changes no result.

Labelled insults are mostly spelled in full. So that the machine and the curve also weigh weak values, they learn from every toxic
document a second time, with a letter left out of or put into each of its words that begins with a landmark.

The model is fitted on about ``SAMPLE`` labelled documents of each kind; of a learning document, the ``SENTENCES`` nearest the
landmarks are used. Every document is scored over its whole text. Null, empty and other texts without a near window have the
score of no insult. Without labels of both kinds every score is the share of label 1, or 0 if there is none.
"""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from . import texts as T
from .sampling import labelled_sample, learning_rows

WINDOW = 9
STRIDE = 4
DECAY = 0.6
POWER = 1
FLOOR = 0.5
LANDMARKS = 32
USUAL = 64
ALIKE = 0.75
RATIO = 6
SAMPLE = 2_500
SENTENCES = 6
ROUNDS = 4
STEPS = 400
ACCEPT = 0.3
KEPT = 200_000

MARK = 27
_CODE = np.zeros(256, np.uint8)  # letters 1 to 26, the mark 27, bytes of other letters 28 to 31
_CODE[65:91] = _CODE[97:123] = np.arange(1, 27)
_CODE[128:] = 28 + (np.arange(128) & 3)
_STOP = np.zeros(256, bool)
_STOP[list(b".!?\n")] = True
_TRIPLES = np.array(list(itertools.combinations(range(WINDOW), 3)))
_WEIGHTS = DECAY ** (_TRIPLES[:, 2] - _TRIPLES[:, 0] + 1.0)


def letters(data: np.ndarray) -> np.ndarray:
    """Letter codes of bytes; capitals of two bytes as their small letters."""
    data = data.copy()
    capital = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1 if len(data) > 1 else []
    data[capital] += 32
    return _CODE[data]


def windows(data: np.ndarray, offsets: np.ndarray):
    """Letter codes with a mark before and after each word, the ends of every window in them, its text and its sentence.

    The mark before a word is also that after the word before it.
    """
    starts, ends, first = T.spans(data, offsets, T.NOT_SPACE)
    codes = letters(data)
    held = np.flatnonzero(codes)
    lo, hi = np.searchsorted(held, starts), np.searchsorted(held, ends)
    some = hi > lo
    starts, lo, hi = starts[some], lo[some], hi[some]
    doc = np.searchsorted(offsets, starts, "right") - 1
    single = hi - lo == 1
    joined = np.zeros(len(lo), bool)
    joined[1:] = single[1:] & single[:-1] & (doc[1:] == doc[:-1])
    begins = ~joined
    lo, doc, at = lo[begins], doc[begins], starts[begins]
    size = np.diff(np.append(lo, len(held)))
    stops = np.cumsum(_STOP[data]) if len(data) else np.zeros(0, np.int64)
    sentence = stops[at] if len(at) else at
    text = np.full(len(held) + len(lo) + 1, MARK, np.uint8)
    text[np.arange(len(held)) + np.repeat(np.arange(len(lo)), size) + 1] = codes[held]
    word = lo + np.arange(len(lo))
    n = np.maximum(1, -(-(size + 2 - WINDOW) // STRIDE) + 1)
    which = np.repeat(np.arange(len(lo)), n)
    a = word[which] + STRIDE * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    b = np.minimum(a + WINDOW, (word + size + 2)[which])
    return text, a, b, doc[which], sentence[which]


def padded(strings: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(x.ljust(WINDOW, b"\0") for x in strings), np.uint8).reshape(len(strings), WINDOW)


def parts(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The subsequences of padded windows, as numbers, and their weights."""
    t = rows[:, _TRIPLES].astype(np.int64)
    return t[:, :, 0] << 10 | t[:, :, 1] << 5 | t[:, :, 2], _WEIGHTS * (t != 0).all(2)


def norms(code: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The root of each window's kernel with itself."""
    out = np.zeros(len(code))
    for i in range(0, len(code), 512):
        c, w = code[i : i + 512], weight[i : i + 512]
        out[i : i + 512] = np.sqrt(((c[:, :, None] == c[:, None, :]) * w[:, :, None] * w[:, None, :]).sum((1, 2)))
    return out


class Kernel:
    """Kernel values with fixed landmarks; none for windows nearer to one of the ``usual`` strings."""

    def __init__(self, landmarks: list[bytes], usual: list[bytes] | tuple = ()):
        self.landmarks = landmarks
        code, weight = parts(padded([*landmarks, *usual]))
        norm = norms(code, weight)
        self.table = np.zeros((1 << 15, len(code)), np.float32)
        for j in range(len(code)):
            np.add.at(self.table[:, j], code[j], weight[j] / norm[j])
        self.known, self.near = np.zeros(1 << 24, np.uint8), np.zeros(1 << 24, np.uint8)  # bits by set of letters
        self.kept: dict[bytes, np.ndarray | None] = {}
        # For each landmark: its letters, and the bound for every subset of them.
        self.bounds = []
        for j, z in enumerate(landmarks):
            own = sorted({c for c in z if c <= MARK})
            features: dict[int, float] = {}
            for c, w in zip(code[j].tolist(), weight[j].tolist(), strict=True):
                features[c] = features.get(c, 0.0) + w / norm[j]
            best = np.zeros(1 << len(own))
            for c, w in features.items():
                need = sum(1 << i for i, x in enumerate(own) if x in (c >> 10, c >> 5 & 31, c & 31))
                has = np.arange(1 << len(own))
                best[(has & need) == need] += w * w
            self.bounds.append((own, np.sqrt(best) >= FLOOR - 1e-6))

    def screen(self, mask: np.ndarray) -> np.ndarray:
        """Whether windows with these sets of letters can be near a landmark."""
        known = self.known[mask >> 3] >> (mask & 7).astype(np.uint8) & 1
        new = np.unique(mask[known == 0])
        if len(new):
            near = np.zeros(len(new), bool)
            for own, good in self.bounds:
                has = np.zeros(len(new), np.int64)
                for i, c in enumerate(own):
                    has |= ((new >> (c - 1)) & 1) << i
                near |= good[has]
            np.bitwise_or.at(self.known, new >> 3, np.left_shift(1, new & 7).astype(np.uint8))
            np.bitwise_or.at(self.near, new[near] >> 3, np.left_shift(1, new[near] & 7).astype(np.uint8))
        return (self.near[mask >> 3] >> (mask & 7).astype(np.uint8) & 1).astype(bool)

    def values(self, strings: list[bytes]) -> np.ndarray:
        """Kernel values of windows with all landmarks."""
        out = np.zeros((len(strings), len(self.landmarks)))
        for i in range(0, len(strings), 512):
            code, weight = parts(padded(strings[i : i + 512]))
            raw = (weight[:, None, :].astype(np.float32) @ self.table[code])[:, 0].astype(float)
            raw, usual = raw[:, : len(self.landmarks)], raw[:, len(self.landmarks) :].max(1, initial=0)
            raw[raw.max(1, initial=0) < usual] = 0
            # A window's norm is at least that of its subsequences taken as different ones.
            maybe = np.flatnonzero(raw.max(1, initial=0) >= (FLOOR - 1e-5) * np.sqrt((weight * weight).sum(1)))
            raw = raw[maybe] / np.maximum(norms(code[maybe], weight[maybe]), 1e-12)[:, None]
            out[i + maybe] = np.where(raw >= FLOOR, np.minimum(raw, 1.0) ** POWER, 0.0)
        return out

    def sentences(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text and largest kernel values of every sentence with a window near a landmark."""
        text, a, b, doc, sentence = windows(data, offsets)
        if len(a) == 0 or not self.landmarks:
            return np.zeros(0, np.int64), np.zeros((0, len(self.landmarks)))
        bit = np.where((text >= 1) & (text <= MARK), np.left_shift(np.int64(1), np.maximum(text.astype(np.int64) - 1, 0)), 0)
        mask = np.bitwise_or.reduceat(np.append(bit, 0), np.stack([a, b], 1).ravel())[::2]
        rows = np.flatnonzero(self.screen(mask))
        raw = text.tobytes()
        strings = [raw[x:y] for x, y in zip(a[rows].tolist(), b[rows].tolist(), strict=True)]
        new = list({s for s in strings if s not in self.kept})
        found = {s: (v if v.any() else None) for s, v in zip(new, self.values(new), strict=True)}
        if len(self.kept) + len(found) <= KEPT:
            self.kept.update(found)
        values = [self.kept[s] if s in self.kept else found[s] for s in strings]
        some = [i for i, v in enumerate(values) if v is not None]
        if not some:
            return np.zeros(0, np.int64), np.zeros((0, len(self.landmarks)))
        rows, v = rows[some], np.stack([values[i] for i in some])
        key = doc[rows] * (len(data) + 1) + sentence[rows]
        keys, where = np.unique(key, return_index=True)
        return keys // (len(data) + 1), np.maximum.reduceat(v, where, axis=0)


def kernel_of(landmarks: list[bytes], usual: list[bytes]) -> Kernel:
    """A worker's kernel with these strings, kept from task to task."""
    store = T.worker_store()
    if store.get("kernel", (None,))[0] != (landmarks, usual):
        store["kernel"] = ((landmarks, usual), Kernel(landmarks, usual))
    return store["kernel"][1]


class Model:
    """Landmarks, usual strings near them, the weight of each landmark's kernel value, and the curve from a document's evidence to its score."""

    def __init__(self, landmarks, usual=(), weights=None, bias=0.0, curve=None, constant=None):
        self.landmarks, self.usual, self.weights, self.bias, self.curve, self.constant = landmarks, usual, weights, bias, curve, constant

    def evidence(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Of each text: the margin of its worst sentence, how many sentences lie beyond the lower margin, and their rate."""
        n = len(offsets) - 1
        worst, many = np.full(n, self.bias), np.zeros(n)
        doc, x = kernel_of(self.landmarks, self.usual).sentences(data, offsets)
        if len(doc):
            margin = x @ self.weights + self.bias
            np.maximum.at(worst, doc, margin)
            many += np.bincount(doc, np.clip(margin + 1, 0, 2), n)
        words = np.diff(T.spans(data, offsets, T.NOT_SPACE)[2])
        return np.stack([np.clip(worst, -3, 3), np.log1p(many), np.log((many + 0.1) / (words / 50 + 1))], 1)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(offsets) - 1, self.constant)
        mean, scale, w = self.curve
        z = (self.evidence(data, offsets) - mean) / scale
        return 1 / (1 + np.exp(-np.clip(z @ w[:-1] + w[-1], -30, 30)))


def beginnings(rows: DataFrame) -> DataFrame:
    """string (letter codes of a word's beginning), and how many different words of each document of either label begin so.

    The empty string counts all words.
    """

    def run(batches):
        for batch in batches:
            y = batch.column(0).to_numpy()
            counts = (Counter(), Counter())
            for lo, _, data, offsets in T.slices(batch.column(1)):
                text, a, b, doc, _ = windows(data, offsets)
                raw = text.tobytes()
                own: dict[int, set] = {}
                for x, z, d in zip(a.tolist(), b.tolist(), doc.tolist(), strict=True):
                    if raw[x] == MARK:
                        own.setdefault(d, set()).add(raw[x:z])
                for d, strings in own.items():
                    counts[y[lo + d]].update(s[:k] for s in strings for k in (0, *range(5, len(s) + 1)))
            names = list(counts[0].keys() | counts[1].keys())
            yield pa.record_batch([pa.array(names, pa.binary()), pa.array([counts[1][s] for s in names], pa.int64()), pa.array([counts[0][s] for s in names], pa.int64())], names=["string", "bad", "good"])

    return rows.select("y", "text").mapInArrow(run, "string binary, bad long, good long").groupBy("string").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


def choose(found: list[tuple[bytes, int, int]], bad: float, good: float) -> list[bytes]:
    """Strings that tell the ``bad`` words of toxic documents from the ``good`` of others, the most telling first, none like one before it."""
    weight = {s: p * math.log(((p + 0.5) / bad) / ((n + 0.5) / good)) + 0.01 * len(s) for s, p, n in found}
    return unlike(sorted(weight, key=lambda s: (-weight[s], s)), LANDMARKS)


def unlike(strings: list[bytes], most: int, alike: float = ALIKE) -> list[bytes]:
    """The first strings of which none is like one before it."""
    chosen: list[bytes] = []
    for s in strings:
        if len(chosen) == most:
            break
        code, w = parts(padded([s, *chosen]))
        norm = norms(code, w)
        near = [(w[0][:, None] * w[i] * (code[0][:, None] == code[i])).sum() / norm[0] / norm[i] for i in range(1, len(code))]
        if max(near, default=0) < alike:
            chosen.append(s)
    return chosen


def near_usual(told: DataFrame, landmarks: list[bytes], bad: float, good: float) -> list[bytes]:
    """Beginnings at most twice as frequent in toxic documents as in others that come near a landmark, the most frequent first."""

    def run(batches):
        kernel = kernel_of(landmarks, [])
        for batch in batches:
            yield batch.filter(pa.array(kernel.values(batch.column(0).to_pylist()).any(1)))

    plain = told.filter((F.length("string") > 0) & (F.col("good") >= 2) & (F.col("bad") / bad <= 2 * F.col("good") / good)).select("string", "good")
    rows = plain.mapInArrow(run, "string binary, good long").orderBy(F.desc("good"), F.desc(F.length("string")), "string").limit(1024).collect()
    return unlike([bytes(r["string"]) for r in rows], USUAL, 0.9)


def altered(rows: DataFrame, landmarks: list[bytes]) -> DataFrame:
    """doc_id, y, text with a letter left out of or put into every word that begins with a landmark."""
    letter = lambda c: b"[\x80-\xff]" if c > MARK else b"[%c%c]" % (c + 64, c + 96)
    forms = [b"".join(map(letter, z.strip(bytes([MARK])))) + (rb"(?![A-Za-z\x80-\xff])" if z[-1] == MARK else b"") for z in landmarks]
    word = re.compile(rb"(?<![^\s])(?:" + b"|".join(forms) + rb")[A-Za-z]*")

    def run(batches):
        for batch in batches:
            made = []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):

                def change(m, d=d):
                    w = m[0]
                    at = [i for i, c in enumerate(w) if c < 128]
                    h = zlib.crc32(b"%d %d" % (d, m.start()))
                    if not at:
                        return w
                    i = at[h // 64 % len(at)]
                    return w[:i] + w[i + 1 :] if h & 1 else w[: i + 1] + b"%c" % (97 + h // 2**16 % 26) + w[i + 1 :]

                made.append(word.sub(change, (t or "").encode()).decode("utf-8", "replace"))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(made, pa.string())], names=["doc_id", "y", "text"])

    return rows.select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, text string")


def machine(x: np.ndarray, owner: np.ndarray, y: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear machine on mapped sentences; hinge loss, both classes weighing the same."""
    z = x @ root
    chosen = np.ones(len(z), bool)
    w, b = np.zeros(z.shape[1]), -1.0
    strength = x.sum(1)
    for _ in range(ROUNDS):
        margin = z @ w if w.any() else strength
        best = np.full(len(y), -np.inf)
        np.maximum.at(best, owner, margin)
        first = np.zeros(len(z), bool)
        order = np.lexsort((np.arange(len(z)), -margin, owner))
        first[order[np.concatenate([[True], owner[order][1:] != owner[order][:-1]])]] = True
        chosen = (y[owner] == 0) | first
        u, v = z[chosen], np.where(y[owner[chosen]] == 1, 1.0, -1.0)
        u = np.concatenate([u, np.zeros((1, z.shape[1]))])  # sentences without any near window
        v = np.append(v, -1.0)
        c = np.where(v > 0, 0.5 / max(1, (v > 0).sum()), 0.25 / max(1, (v < 0).sum()))
        c[-1] = 0.25
        w, b = np.zeros(z.shape[1]), 0.0
        for t in range(1, STEPS + 1):
            active = (v * (u @ w + b) < 1) * c * v
            step = 1.0 / (0.002 * (t + 200))
            w, b = w - step * (0.002 * w - active @ u), b + 0.2 * step * active.sum()
    return root @ w, float(b)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, scale and weights of a logistic curve through evidence and labels, by Newton's steps."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], 1)
    w = np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (weight * (p - y)) + 0.5 * w
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + 0.5 * np.eye(len(w))
        w = w - np.clip(np.linalg.solve(h, g), -3, 3)
    return mean, scale, w


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    rows = learning_rows(docs, labels, "toxic")
    share = rows.groupBy("y").count().collect()
    counts = {r["y"]: r["count"] for r in share}
    if len(counts) < 2:
        return Model([], constant=float(next(iter(counts), 0)))
    used = stage(labelled_sample(rows.filter("y = 1"), sample).union(labelled_sample(rows.filter("y = 0"), sample)), "toxic-sample")
    told = stage(beginnings(used), "beginnings")
    bad, good = (max(1, x or 0) for x in (told.filter(F.length("string") == 0).select("bad", "good").first() or (1, 1)))
    least = max(3, min(sample, counts[1]) // 200)
    telling = told.filter((F.length("string") > 0) & (F.col("bad") >= least) & (F.col("bad") / bad >= RATIO * (F.col("good") + 0.5) / good))
    found = telling.orderBy(F.desc("bad"), "good", "string").limit(4 * 1024).collect()
    landmarks = choose([(bytes(r["string"]), r["bad"], r["good"]) for r in found], bad, good)
    if not landmarks:
        return Model([], constant=counts[1] / (counts[0] + counts[1]))
    usual = near_usual(told, landmarks, bad, good)
    used = used.select("doc_id", "y", "text").union(altered(used.filter("y = 1"), landmarks))

    def run(batches):
        kernel = kernel_of(landmarks, usual)
        for batch in batches:
            for lo, hi, data, offsets in T.slices(batch.column(2)):
                doc, x = kernel.sentences(data, offsets)
                strings = []
                for d in range(hi - lo):
                    own = x[doc == d]
                    strings.append(own[np.argsort(-own.sum(1), kind="stable")[:SENTENCES]].astype(np.float32).tobytes())
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(strings, pa.binary())], names=["doc_id", "y", "x"])

    got = used.select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, x binary").toPandas().sort_values(["doc_id", "x"])
    bags = [np.frombuffer(b, np.float32).reshape(-1, len(landmarks)).astype(float) for b in got["x"]]
    y, owner = got["y"].to_numpy(), np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    x = np.concatenate(bags)
    k = Kernel(landmarks).values(landmarks)
    value, vector = np.linalg.eigh((k + k.T) / 2)
    root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-3))) @ vector.T
    weights, bias = machine(x, owner, y, root)
    model = Model(landmarks, usual, weights, bias)

    def proven(batches):
        for batch in batches:
            for lo, hi, data, offsets in T.slices(batch.column(1)):
                e = model.evidence(data, offsets)
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), *(pa.array(c) for c in e.T)], names=["y", "a", "b", "c"])

    got = used.select("y", "text").mapInArrow(proven, "y int, a double, b double, c double").toPandas().sort_values(["y", "a", "b", "c"])
    y = got["y"].to_numpy()
    # The sample holds as many of both kinds as it can; the curve weighs them as they are among all labels.
    weight = np.where(y == 1, counts[1] / max(1, (y == 1).sum()), counts[0] / max(1, (y == 0).sum()))
    model.curve = logistic(got[["a", "b", "c"]].to_numpy(), y, weight / weight.mean())
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every document."""

    def work():
        return lambda data, offsets: [model.score(data, offsets)]

    return T.per_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id", "text"], "doc_id long, score double", work)
