"""Benchmark decontamination: which documents hold test items.

The test items are cut into segments of ``SEGMENT`` words, which form a BM25 inverted index. Every passage of every document
(``2 * SEGMENT`` words, a new one each ``SEGMENT`` words, so that each segment's copy lies whole in one) is a query of all its
distinct words. Impacts are shares of the segment's score against itself, so one threshold holds for all segments.

Retrieval is block-max WAND over all passages of a slice at once. Segments are ordered by their items and dealt into blocks; the
lists hold each block's largest impact. The lightest words of a segment, which together stay below ``LIGHT``, are not
looked up at first. A block is a pivot for a passage if the block maxima of the words looked up reach the threshold less
``LIGHT``; only its segments are scored in full, and all at or above ``THRESHOLD`` are retrieved. The bound is never below the
score, so nothing above the threshold is missed.

A retrieved item is verified in the document around the passage: its question (the first part of its words) and its answer (the
rest) must both recur there, by the share of their word triples.

Items are taken in blocks of ``ITEMS`` at most, so that what is sent to the tasks is bounded; document frequencies and the mean
length are those of all items. Null or empty texts, items without words and empty tables give no rows. Repeated documents and
items each give their rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from . import texts as T

SEGMENT = 64
THRESHOLD = 0.5
LIGHT = 0.2
BLOCK = 8
ITEMS = 4096
QUESTION = 0.6
OVERLAP = 0.6
K1, B = 1.2, 0.75
_SLOTS = 1 << 18

_SPLIT = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = np.array([c != 32 for c in _SPLIT])


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(_SPLIT).split()


def lowered(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts of a slice in small letters."""
    raw = bytes(data)
    made = [raw[a:b].decode("utf-8", "replace").lower().encode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    return np.frombuffer(b"".join(made), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in made])]).astype(np.int64)


def segments(words: list[bytes]) -> list[list[bytes]]:
    """Equal parts of SEGMENT words at most."""
    parts = max(1, -(-len(words) // SEGMENT))
    return [words[len(words) * i // parts : len(words) * (i + 1) // parts] for i in range(parts)]


def statistics(items: DataFrame) -> tuple[int, float, DataFrame]:
    """The number of segments, their mean length, and the number of segments with each term."""

    def run(batches):
        for batch in batches:
            terms, sizes = [], []
            for text in batch.column(0).to_pylist():
                for part in segments(words_of(text)) if words_of(text) else []:
                    terms += [w.decode("utf-8", "replace") for w in set(part)]
                    sizes += [len(part)] + [0] * (len(set(part)) - 1)
            yield pa.record_batch([pa.array(terms, pa.string()), pa.array(sizes, pa.int64())], names=["term", "size"])

    rows = stage(items.select("text").mapInArrow(run, "term string, size long"), "item-terms")
    n, words = rows.agg(F.count(F.when(F.col("size") > 0, 1)), F.sum("size")).first()
    return n, (words or 0) / max(1, n), rows.groupBy("term").agg(F.count("*").alias("df"))


def triples(words: list[bytes]) -> set[tuple]:
    n = min(3, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


class Index:
    """Segments of some items with BM25 impacts, block maxima and the words looked up first."""

    def __init__(self, items: list[tuple[int, str]], n: int, mean: float, df: dict[bytes, int]):
        self.items = []
        self.segments: list[tuple[int, dict[bytes, float]]] = []
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            cut = max(1, min(len(words) - 1, round(QUESTION * len(words)))) if len(words) > 1 else 1
            self.items.append((item_id, len(words), triples(words[:cut]), triples(words[cut:])))
            for part in segments(words):
                impact = {}
                for w in part:
                    impact[w] = impact.get(w, 0) + 1
                norm = K1 * (1 - B + B * len(part) / mean)
                impact = {w: math.log(1 + (n - df.get(w, 1) + 0.5) / (df.get(w, 1) + 0.5)) * f * (K1 + 1) / (f + norm) for w, f in impact.items()}
                whole = sum(impact.values())
                self.segments.append((len(self.items) - 1, {w: x / whole for w, x in impact.items()}))
        self.blocks = -(-len(self.segments) // BLOCK)
        heavy: dict[bytes, dict[int, float]] = {}
        for s, (_, impact) in enumerate(self.segments):
            left = LIGHT
            for w, x in sorted(impact.items(), key=lambda e: (e[1], e[0])):
                left -= x
                if left <= 0:
                    lists = heavy.setdefault(w, {})
                    lists[s // BLOCK] = max(lists.get(s // BLOCK, 0.0), x)
        # A word that is looked up for one segment of a block counts with its largest impact on any of them.
        terms = sorted(heavy)
        for w in terms:
            for b in heavy[w]:
                heavy[w][b] = max(self.segments[s][1].get(w, 0.0) for s in range(b * BLOCK, min(len(self.segments), b * BLOCK + BLOCK)))
        data, ends = np.frombuffer(b"".join(terms), np.uint8), np.cumsum([len(w) for w in terms])
        hashes = T.word_hashes(data, ends - np.array([len(w) for w in terms]), ends) if terms else np.zeros(0, np.uint64)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.taken = np.zeros(_SLOTS, bool)
        self.taken[(hashes & np.uint64(_SLOTS - 1)).astype(np.int64)] = True
        lists = [sorted(heavy[terms[i]].items()) for i in order.tolist()]
        self.at = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        self.block = np.array([b for x in lists for b, _ in x], np.int64)
        self.most = np.array([v for x in lists for _, v in x], float)

    def pivots(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Text, first and last+1 word of the passage, and block, of every pivot in texts of small letters."""
        starts, ends, first = T.spans(data, offsets, _WORD)
        if len(starts) == 0 or len(self.hashes) == 0:
            return []
        h = T.word_hashes(data, starts, ends)
        seen = np.flatnonzero(self.taken[(h & np.uint64(_SLOTS - 1)).astype(np.int64)])
        term = np.minimum(np.searchsorted(self.hashes, h[seen]), len(self.hashes) - 1)
        hit = self.hashes[term] == h[seen]
        seen, term = seen[hit], term[hit]
        doc = np.searchsorted(first, seen, "right") - 1
        counts = np.maximum(1, -(-np.diff(first) // SEGMENT))
        base = np.concatenate([[0], np.cumsum(counts)])
        passage = base[doc] + (seen - first[doc]) // SEGMENT
        before = passage > base[doc]
        both = np.concatenate([passage, passage[before] - 1]) * len(self.hashes) + np.concatenate([term, term[before]])
        both = np.unique(both)
        passage, term = both // len(self.hashes), both % len(self.hashes)
        n = self.at[term + 1] - self.at[term]
        entry = np.repeat(self.at[term], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        key = np.repeat(passage, n) * self.blocks + self.block[entry]
        keys, where = np.unique(key, return_inverse=True)
        bound = np.bincount(where, self.most[entry], len(keys))
        keys = keys[bound >= THRESHOLD - LIGHT - 1e-9]
        passage, block = keys // self.blocks, keys % self.blocks
        doc = np.searchsorted(base, passage, "right") - 1
        a = first[doc] + (passage - base[doc]) * SEGMENT
        b = np.minimum(a + 2 * SEGMENT, first[doc + 1])
        return list(zip(doc.tolist(), (a - first[doc]).tolist(), (b - first[doc]).tolist(), block.tolist(), strict=True))

    def found(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, float, float, float]]:
        """Text, item, score, overlap of question and of answer for all verified items of the texts of a slice."""
        data, offsets = lowered(data, offsets)
        raw, words, out = bytes(data), {}, {}
        for doc, a, b, block in self.pivots(data, offsets):
            if doc not in words:
                words = {doc: raw[offsets[doc] : offsets[doc + 1]].translate(_SPLIT).split()}
            terms = set(words[doc][a:b])
            for item, impact in self.segments[block * BLOCK : block * BLOCK + BLOCK]:
                score = sum(x for w, x in impact.items() if w in terms)
                if score < THRESHOLD - 1e-9:
                    continue
                item_id, n, question, answer = self.items[item]
                near = triples(words[doc][max(0, a - n) : b + n])
                if len(question) and min(map(len, question)) < 3 or answer and min(map(len, answer)) < 3:
                    near |= {t[:k] for t in near for k in (1, 2)} | {t[-k:] for t in near for k in (1, 2)}
                q = len(question & near) / len(question)
                r = len(answer & near) / len(answer) if answer else 1.0
                if q >= OVERLAP and r >= OVERLAP:
                    out[doc, item] = max(out.get((doc, item), (0.0, 0.0, 0.0)), (score, q, r))
        return [(doc, self.items[item][0], *x) for (doc, item), x in sorted(out.items())]


SCHEMA = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and test item that it holds."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null")
    n, mean, df = statistics(items)
    parts = max(1, -(-items.count() // ITEMS))
    made = None
    for part in range(parts):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        rows = [(r["item_id"], r["text"]) for r in own.orderBy("item_id", "text").collect()]  # about ITEMS
        terms = sorted({w.decode("utf-8", "replace") for _, t in rows for w in words_of(t)})
        used = docs.sparkSession.createDataFrame(pa.table({"term": pa.array(terms, pa.string())}))  # as Arrow: rows would start other workers
        counts = {r["term"].encode(): r["df"] for r in df.join(used, "term").collect()}
        index = Index(rows, n, mean, counts)

        def run(batches, index=index):
            for batch in batches:
                for lo, hi, data, offsets in T.slices(batch.column(1)):
                    found = index.found(data, offsets)
                    ids = batch.column(0).slice(lo, hi - lo).take(pa.array([d for d, *_ in found], pa.int64()))
                    rest = [pa.array([r[i] for r in found], kind) for i, kind in ((1, pa.int64()), (2, pa.float64()), (3, pa.float64()), (4, pa.float64()))]
                    yield pa.record_batch([ids, *rest], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        one = T.over_batches(docs, run, SCHEMA)
        made = one if made is None else made.union(one)
    return made


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without those that hold a test item."""
    with T.small_batches(docs.sparkSession):
        held = stage(contaminated(docs, benchmark).select(F.col("doc_id").alias("_held")).distinct(), "held")
    return docs.join(held, F.col("doc_id") == F.col("_held"), "left_anti")
