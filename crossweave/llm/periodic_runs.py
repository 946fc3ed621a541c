"""Periodic runs of words: stretches that repeat with a period, found by their Lyndon roots.

A run's root, read from the right place, is the longest Lyndon word that begins there, under one of two orders of the words: any
order and its reverse. The first phase of a suffix sorter that groups suffixes by their longest Lyndon prefix gives these
words for all places at once, in linear time and without the suffix array itself (``lyndon``); it runs under both orders.
Each root is then extended to both sides as far as words one period apart agree (longest common extensions, from prefix hashes),
and extents that are long enough and hold the period often enough are runs. A comparison word by word follows: equal stretches have
equal hashes, so no extent is missed, and one that a collision made too long is measured again. Words themselves stand for each
other if their 64-bit hashes are equal.

A run of 3 periods and ``least`` words holds the same ``least * 2 // 3`` words twice, one period apart. Only stretches covered
by such recurring pieces are sorted (with a word on either side); all other words cannot belong to a run. Everything is done text by
text, so no rows are exchanged, and memory follows the longest text.

Defined results: null and empty texts have no runs and stay empty. Repeated rows are repeated. No documents, no rows.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import texts as T

#: A run has this many words at least, and this many periods.
LEAST = 24
PERIODS = 3

_rng = np.random.default_rng(20250311)
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 2**64)


def lyndon(word: list[int]) -> list[int]:
    """The length of the longest Lyndon word that begins at each place.

    Groups of suffixes are taken in descending order, from those of the greatest word down. A group's context (the Lyndon
    word that its suffixes begin with) is final when it is taken. Each member points to the last place before it whose
    group is lower; places that k members of the group point to have k contexts behind their own, so they leave their group for a
    new one right above it, whose context is that much longer.
    """
    n = len(word)
    letters = sorted(set(word))
    number = {c: g for g, c in enumerate(letters)}
    group = [number[c] for c in word]
    members: list[list[int]] = [[] for _ in letters]
    for i, g in enumerate(group):
        members[g].append(i)
    length = [1] * len(letters)
    down = list(range(-1, len(letters) - 1))
    up = list(range(1, len(letters) + 1))
    up[-1:] = [-1] if letters else []
    done, before = bytearray(n), [-1] * n
    g = len(letters) - 1
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        members[g] = []
        if len(own) > 1:
            own.sort()
        for i in own:
            done[i] = 1
        behind: dict[int, int] = {}
        for i in own:
            j = i - 1
            while j >= 0 and done[j]:
                j = before[j]
            before[i] = j
            if j >= 0:
                behind[j] = behind.get(j, 0) + 1
        if behind:
            context = length[g]
            made: dict[tuple[int, int], int] = {}
            for j, k in sorted(behind.items(), key=lambda x: -x[1]) if len(behind) > 1 else behind.items():
                old = group[j]
                new = made.get((old, k))
                if new is None:
                    made[old, k] = new = len(length)
                    length.append(length[old] + k * context)
                    members.append([])
                    above = up[old]
                    down.append(old)
                    up.append(above)
                    up[old] = new
                    down[above] = new
                members[new].append(j)
                group[j] = new
        g = down[g]
    return [length[g] for g in group]


def _prefix(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the hashed words times powers of a base, and the powers of its inverse, to compare any two stretches."""
    steps, back = np.full(len(values) + 1, _BASE, np.uint64), np.full(len(values) + 1, _INVERSE, np.uint64)
    steps[0] = back[0] = 1
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * np.multiply.accumulate(steps)[:-1], out=sums[1:])
    return sums, np.multiply.accumulate(back)


def _extensions(sums: np.ndarray, back: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many words agree from places i < j on to the right, and before them to the left."""
    n = len(sums) - 1
    found = []
    for most, right in ((n - j, True), (i, False)):
        low, high = np.zeros(len(i), np.int64), most.copy()
        while (open_ := np.flatnonzero(low < high)).size:
            half = (low[open_] + high[open_] + 1) // 2
            a, b = (i[open_], j[open_]) if right else (i[open_] - half, j[open_] - half)
            same = (sums[a + half] - sums[a]) * back[a] == (sums[b + half] - sums[b]) * back[b]
            low[open_[same]] = half[same]
            high[open_[~same]] = half[~same] - 1
        found.append(low)
    return found[0], found[1]


def _exact(ids: np.ndarray, start: int, end: int, period: int, roots: np.ndarray) -> set[tuple[int, int]]:
    """Extents compared word by word: the one that hashes gave, or those measured from each root if hashes made it too long."""
    if (ids[start : end - period] == ids[start + period : end]).all():
        return {(start, end)}
    apart = np.concatenate([[-1], np.flatnonzero(ids[:-period] != ids[period:]), [len(ids) - period]])
    at = np.searchsorted(apart, roots)
    return set(zip((apart[at - 1] + 1).tolist(), (apart[at] + period).tolist(), strict=True))


def recurring(values: np.ndarray, size: int) -> list[tuple[int, int]]:
    """The stretches covered by pieces of ``size`` words that occur more than once, a word wider on both sides."""
    n = len(values) - size + 1
    if n < 2:
        return []
    sums, back = _prefix(values)
    pieces = (sums[size:] - sums[:-size]) * back[:n]
    order = np.argsort(pieces, kind="stable")
    same = pieces[order[1:]] == pieces[order[:-1]]
    if not same.any():
        return []
    cover = np.zeros(len(values) + 1, np.int64)
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    at = np.flatnonzero(again)
    cover[at] += 1
    cover[at + size] -= 1
    covered = np.concatenate([[False], np.cumsum(cover[:-1]) > 0, [False]])
    edges = np.flatnonzero(covered[1:] != covered[:-1])
    return [(max(0, a - 1), min(len(values), b + 1)) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]


def runs(values: np.ndarray, least: int = LEAST, periods: int = PERIODS) -> list[tuple[int, int, int]]:
    """start, length and period of every run of a sequence of 64-bit values, by start and period.

    A run has ``least`` elements and ``periods`` (2 at least) periods at least and can't be made longer.
    """
    found: set[tuple[int, int, int]] = set()
    # periods * q elements or more, and ``least``, leave at least this many that equal those one period on.
    size = max(1, least * (periods - 1) // periods)
    for lo, hi in recurring(values, size):
        if hi - lo < least:
            continue
        _, ids = np.unique(values[lo:hi], return_inverse=True)
        sums, back = _prefix(values[lo:hi])
        for order in (ids, ids.max() - ids):
            root = np.array(lyndon(order.tolist()), np.int64)
            i = np.flatnonzero(np.arange(len(root)) + root < len(root))
            right, left = _extensions(sums, back, i, i + root[i])
            period, length = root[i], left + right + root[i]
            good = (length >= least) & (length >= periods * period)
            if not good.any():
                continue
            extents, number = np.unique(np.stack([(i - left)[good], length[good], period[good]], 1), axis=0, return_inverse=True)
            roots, cuts = i[good][np.argsort(number.ravel(), kind="stable")], np.cumsum(np.bincount(number.ravel(), minlength=len(extents)))
            for (first, long, q), own in zip(extents.tolist(), np.split(roots, cuts[:-1]), strict=True):
                for start, end in _exact(ids, first, first + long, q, own):
                    if end - start >= max(least, periods * q):
                        found.add((lo + start, end - start, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest share of length and period, exactly; ties by start, then period."""
    return min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else None


SCHEMA = "runs array<struct<start:bigint,length:bigint,period:bigint>>, strongest struct<start:bigint,length:bigint,period:bigint>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def find(docs: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """The columns, with runs (by start, then period), strongest (null without runs) and collapsed.

    ``collapsed`` is the words that no run contains after its first period, joined by one space.
    """
    rows = docs.select(*columns, text)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in T.slices(batch.column(len(columns))):
                starts, ends, first = T.spans(data, offsets, T.NOT_SPACE)
                values = T.word_hashes(data, starts, ends)
                made, best, short = [], [], []
                for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                    found = runs(values[a:b])
                    keep = np.ones(b - a, bool)
                    for start, length, q in found:
                        keep[start + q : start + length] = False
                    at = np.flatnonzero(keep) + a
                    short.append(b" ".join([data[x:y].tobytes() for x, y in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]))
                    made.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in found])
                    top = strongest(found)
                    best.append(dict(zip(("start", "length", "period"), top, strict=True)) if top else None)
                own = [batch.column(i).slice(lo, hi - lo) for i in range(len(columns))]
                new = [pa.array(made, pa.list_(_RUN)), pa.array(best, _RUN), pa.array(short, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(own + new, names=[*columns, "runs", "strongest", "collapsed"])

    return rows.mapInArrow(run, f"{kinds}, {SCHEMA}")


def planted(doc_id: Column, text: Column) -> Column:
    """The text, in one of ten documents with its end replaced by repetitions; the id's checksum fixes where and how many words."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    g, n = F.floor(h / 10), F.greatest(F.size(words), F.lit(1))
    a = F.pmod(g, n)
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8))))
    rest = (n - a).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, (a + 1).cast("int"), p.cast("int")), F.ceil(rest / p).cast("int"))), F.lit(1), rest)
    repeated = F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), tail), " ")
    return F.when((F.pmod(h, F.lit(10)) == 0) & text.rlike(r"[^\x20\x09-\x0D]"), repeated).otherwise(text)
