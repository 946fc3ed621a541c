"""Predicts the language of texts with bit-sliced Bloom filters of character trigrams.

Every slot of one table holds a bit for each language: the slots of all languages' filters lie side by side, so the AND of an
n-gram's slots gives at once every language whose filter contains it. The hits of a text are counted for each language and
corrected by the chance of a false hit, which follows from how full the language's bits are.

A language's filter contains the trigrams that are at least ``SHARE`` as frequent in it as in the language where they are most
frequent. They are learned from about ``SAMPLE`` documents at most; every document is predicted, over its whole text.

Null texts and texts without letters are `und` with score 0, and so is everything if there is nothing to learn from. Ties
between languages go to the first in code point order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import texts as T
from .sampling import labelled_sample

SAMPLE = 12_000
SLOTS = 1 << 18
HASHES = 3
SHARE = 0.6
LEAST = 3

def letter_table() -> np.ndarray:
    """Which code points are letters."""
    store = T.worker_store()
    if "letters" not in store:
        store["letters"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return store["letters"]


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams around every letter of the lower-cased texts, as numbers, and the first of each text. What is no letter is 0."""
    lowered, cuts = [], [0]
    raw = bytes(data)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        lowered.append(" " + raw[a:b].decode("utf-8", "replace").lower() + " ")
        cuts.append(cuts[-1] + len(lowered[-1]))
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "replace"), np.uint32)
    letters = letter_table()[codes]
    codes = np.where(letters, codes, 0).astype(np.uint64)
    at = np.flatnonzero(letters)
    made = codes[at - 1] << np.uint64(42) | codes[at] << np.uint64(21) | codes[at + 1]
    return made, np.searchsorted(at, np.array(cuts))


def slots(made: np.ndarray) -> list[np.ndarray]:
    h = T.mix(made)
    return [((h >> np.uint64(20 * i)) & np.uint64(SLOTS - 1)).astype(np.int64) for i in range(HASHES)]


def counts(docs: DataFrame) -> DataFrame:
    """lang, gram and how often it occurs, of documents with lang and text."""

    def run(batches):
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for lo, hi, data, offsets in T.slices(batch.column(1)):
                made, first = grams(data, offsets)
                owner = np.repeat(langs[lo:hi], np.diff(first))
                for lang in sorted(set(langs[lo:hi])):
                    found, n = np.unique(made[owner == lang], return_counts=True)
                    yield pa.record_batch([pa.array([lang] * len(found), pa.string()), pa.array(found.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Filters:
    """Languages, their bits by slot, and the chance of a false hit for each."""

    def __init__(self, languages: list[str], members: list[np.ndarray]):
        self.languages = languages
        self.planes = [np.zeros(SLOTS, np.uint64) for _ in range(-(-len(languages) // 64))]
        self.false = []
        for i, found in enumerate(members):
            for at in slots(found):
                self.planes[i // 64][np.unique(at)] |= np.uint64(1) << np.uint64(i % 64)
            self.false.append(float(((self.planes[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean()) ** HASHES)

    def hits(self, made: np.ndarray, first: np.ndarray) -> np.ndarray:
        """For each text and language, the hits beyond the expected false ones."""
        out = np.zeros((len(first) - 1, len(self.languages)))
        n = np.diff(first)
        at = slots(made)
        for p, plane in enumerate(self.planes):
            mask = plane[at[0]]
            for a in at[1:]:
                mask &= plane[a]
            for i in range(64 * p, min(64 * p + 64, len(self.languages))):
                sums = np.zeros(len(made) + 1, np.int64)
                np.cumsum((mask >> np.uint64(i % 64)) & np.uint64(1), out=sums[1:])
                out[:, i] = np.maximum(0, (sums[first[1:]] - sums[first[:-1]] - n * self.false[i]) / (1 - min(self.false[i], 0.999)))
        return out


def learn(docs: DataFrame, sample: int = SAMPLE) -> Filters:
    known = docs.filter(T.learnable(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    found = counts(labelled_sample(known, sample)).filter(F.col("n") >= LEAST)
    rows = found.toPandas()  # trigrams of a bounded sample
    if rows.empty:
        return Filters([], [])
    rows["p"] = rows["n"] / rows.groupby("lang")["n"].transform("sum")
    rows = rows[rows["p"] >= SHARE * rows.groupby("gram")["p"].transform("max")]
    languages = sorted(rows["lang"].unique(), key=lambda x: x.encode())
    return Filters(languages, [rows.loc[rows["lang"] == x, "gram"].to_numpy(np.int64).astype(np.uint64) for x in languages])


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, lang_pred, score: the share of the predicted language in all languages' hits."""

    def work():
        def step(data, offsets):
            made, first = grams(data, offsets)
            langs, scores = ["und"] * (len(offsets) - 1), np.zeros(len(offsets) - 1)
            if filters.languages:
                hits = filters.hits(made, first)
                best = hits.argmax(1)
                known = np.diff(first) > 0
                total = hits.sum(1)
                scores = np.where(known & (total > 0), hits.max(1) / np.maximum(total, 1e-9), 0.0)
                langs = [filters.languages[b] if k else "und" for b, k in zip(best.tolist(), known.tolist(), strict=True)]
            return [langs, scores]

        return step

    return T.per_text(docs, ["doc_id", "text"], "doc_id long, lang_pred string, score double", work)
