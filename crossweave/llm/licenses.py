"""Finds licence texts and phrases with a positional index of rare words.

Templates are word sequences with a label and key phrases. How many documents hold each word of the templates is counted over
the whole corpus; the rarest words of a template are its entries in the index, each with its position. In a file, the places of
these rare words are looked up, every place and posting gives one position the template would begin at, and templates whose
weight is met at their relative positions there are candidates. A candidate counts if all its key phrases stand at their
places. A phrase that must stand whole is a template that is its own key phrase; each of its places holds its rarest word, so
all places are found.

Null and empty texts have no words, no labels and score 0. Repeated rows give repeated results. An empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import texts as T

#: Index entries of a template; how far a word may stand from its place; the share of a template's weight that must be met.
ENTRIES = 3
SLACK = 2
SHARE = 0.7

_SPLIT = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    keys: tuple[str, ...]
    whole: bool = False

    @property
    def words(self) -> list[bytes]:
        return self.text.encode().split()


def phrase(label: str, text: str) -> Template:
    return Template(label, text, (text,), True)


# The phrases whose places are reported, then texts of common licences with the phrases they must hold.
PHRASES = (
    phrase("mit", "under the mit license"),
    phrase("apache-2", "apache license version 2"),
    phrase("cc-by-nc", "cc by nc"),
)
TEMPLATES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("hereby granted free of charge", "copy of this software")),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("apache-2", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license", ("apache license version 2",)),
    Template("apache-2", "licensed under the apache license version 2 0", ("apache license version 2",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution", "international license")),
    Template("gpl-3", "gnu general public license version 3", ("gnu general public license", "version 3")),
    Template("gpl-2", "gnu general public license version 2", ("gnu general public license", "version 2")),
    Template("lgpl", "gnu lesser general public license", ("gnu lesser general public license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use", "source and binary forms", "following conditions are met")),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("modify and or distribute", "with or without fee")),
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_SPLIT).split()


def document_counts(docs: DataFrame, templates: tuple[Template, ...]) -> tuple[int, dict[bytes, int]]:
    """How many documents there are, and in how many each word of the templates occurs; a row a word reaches the driver."""
    vocabulary = frozenset(w for t in templates for w in t.words)

    def run(batches):
        found: dict[bytes, int] = {b"": 0}
        for batch in batches:
            for lo, hi, data, offsets in T.slices(batch.column(0)):
                raw = bytes(data)
                found[b""] += hi - lo
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    for w in vocabulary.intersection(words_of(raw[a:b])):
                        found[w] = found.get(w, 0) + 1
        yield pa.record_batch([pa.array([w.decode() for w in found]), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    rows = docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {r["word"].encode(): r["n"] for r in rows}
    return counts.pop(b"", 0), counts


class Index:
    """Postings of the templates' rarest words, and the weight of every word of theirs."""

    def __init__(self, templates: tuple[Template, ...], n: int, counts: dict[bytes, int]):
        self.templates, self.words = templates, [t.words for t in templates]
        self.idf = {w: math.log((n + 1) / (counts.get(w, 0) + 1)) + 1e-6 for ws in self.words for w in ws}
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        for k, ws in enumerate(self.words):
            rare = sorted(range(len(ws)), key=lambda i: (-self.idf[ws[i]], i))[: 1 if templates[k].whole else ENTRIES]
            for i in rare:
                self.postings.setdefault(ws[i], []).append((k, i))
        self.rare = frozenset(self.postings)

    def met(self, k: int, words: list[bytes], start: int) -> float:
        """The share of the template's weight that stands at its places, or near them."""
        own, total, have = self.words[k], 0.0, 0.0
        slack = 0 if self.templates[k].whole else SLACK
        for i, w in enumerate(own):
            total += self.idf[w]
            at = start + i
            if w in words[max(0, at - slack) : max(0, at + slack + 1)]:
                have += self.idf[w]
        return have / total

    def verified(self, k: int, words: list[bytes], start: int) -> bool:
        """Whether every key phrase stands in the stretch the template covers."""
        slack = 0 if self.templates[k].whole else SLACK
        stretch = b" " + b" ".join(words[max(0, start - slack) : max(0, start + len(self.words[k]) + slack)]) + b" "
        return all(b" " + x.encode() + b" " in stretch for x in self.templates[k].keys)

    def find(self, words: list[bytes]) -> list[tuple[int, int, float, bool]]:
        """Template, start, share and whether it counts, for every candidate place."""
        if self.rare.isdisjoint(words):
            return []
        starts = {(k, at - i) for at, w in enumerate(words) if w in self.rare for k, i in self.postings[w]}
        found = []
        for k, start in sorted(starts):
            share = self.met(k, words, start)
            found.append((k, start, share, share >= (1.0 - 1e-9 if self.templates[k].whole else SHARE) and self.verified(k, words, start)))
        return found


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame, templates: tuple[Template, ...] = PHRASES + TEMPLATES) -> DataFrame:
    """For every document: n_words, the places of whole phrases (n_base, first_word, last_word), base_labels, labels, score.

    The score is 1 where a phrase or template counts with all its weight, else the largest share met of one that counts, or
    half the largest share met of one that does not.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n, counts = document_counts(docs, templates)

    def work():
        index = Index(templates, n, counts)

        def step(data, offsets):
            raw, rows = bytes(data), []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                words = words_of(raw[a:b])
                found = index.find(words)
                base = [(s, templates[k].label) for k, s, _, ok in found if ok and templates[k].whole]
                labels = sorted({templates[k].label for k, _, _, ok in found if ok})
                score = max([0.0, *(share if ok else share / 2 for _, _, share, ok in found)])
                at = [s for s, _ in base]
                rows.append((len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in base})), ",".join(labels), min(1.0, score)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
            return [pa.array(list(x), kind) for x, kind in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)]

        return step

    return T.per_text(docs, ["doc_id", "text"], SCHEMA, work)
