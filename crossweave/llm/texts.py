"""Texts of Arrow batches as flat byte arrays, and the rows of `labels` a model may learn from.

Python parts of the operators work on slices of a batch: the bytes of some hundred texts in one array, the words of all of
them as start and end positions. A slice holds about ``SLICE`` bytes, or one text if that is longer.
"""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE = 1 << 20
CHUNK = 1 << 18
#: Bytes of the Arrow batches that steps over whole texts are run with.
HANDED = 8 * SLICE
SPACES = b" \t\n\x0b\x0c\r"

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[list(SPACES)] = False

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)


def learnable(doc_id: Column) -> Column:
    """Rows a model may learn from: three of four, by the checksum of the id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2


def held_out(doc_id: Column) -> Column:
    return F.coalesce(~learnable(doc_id), F.lit(False))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins; null texts are empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, last row + 1, bytes and offsets of successive slices."""
    data, offsets = flat(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes with ``inside``, and the first run of each text."""
    word = np.zeros(len(data) + 2, bool)
    word[1:-1] = inside[data]
    begins = word[1:-1] & ~word[:-2]
    ends = word[1:-1] & ~word[2:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    begins[cuts] = word[1:-1][cuts]
    ends[cuts - 1] = word[1:-1][cuts - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def worker_store() -> dict:
    """What a worker process keeps from task to task. The package itself travels with each job, so its own globals do not last."""
    name = "_corpus_worker_store"
    return sys.modules.setdefault(name, types.ModuleType(name)).__dict__


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """For what is run inside, Spark hands texts to Python in batches of ``HANDED`` bytes at most, or of one row that is longer.

    A batch is held by the JVM, outside its heap, and by the worker at once; by Spark's own limit of rows it is as long as its texts.
    A smaller setting of the session stays, and its setting is restored.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(name)
    now = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    spark.conf.set(name, str(min(now, HANDED) if now > 0 else HANDED))
    try:
        yield
    finally:
        spark.conf.set(name, was)


def release() -> None:
    """Gives memory that a worker has freed back to the system; idle workers would else hold it beside what runs next."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)


def over_batches(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` whose workers give back what they have freed when a task ends."""

    def returned(batches):
        yield from run(batches)
        release()

    return df.mapInArrow(returned, schema)


def _power(base: int, n: int) -> np.ndarray:
    """The first n powers of a base, ``CHUNK`` + 1 at most."""
    store = worker_store()
    have = store.get(f"power {base}")
    if have is None:
        steps = np.full(CHUNK + 1, base, np.uint64)
        steps[0] = 1
        store[f"power {base}"] = have = np.multiply.accumulate(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values so that every bit depends on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span; equal spans have equal hashes wherever they stand.

    Spans stand in order and apart. They are hashed in chunks of the data, so memory beside the result is small for texts of any length.
    """
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        a = int(starts[lo])
        hi = max(lo + 1, int(np.searchsorted(ends, a + CHUNK, "right")))
        b = int(ends[hi - 1])
        if b - a > CHUNK:  # one word longer than a chunk
            whole = 0
            for c in range(a, b, CHUNK):
                part = data[c : min(c + CHUNK, b)]
                whole += int((_BYTE[part] * _power(_BASE, len(part))).sum(dtype=np.uint64)) * pow(_BASE, c - a, 2**64)
            out[lo] = whole % 2**64
        else:
            sums = np.zeros(b - a + 1, np.uint64)
            np.cumsum(_BYTE[data[a:b]] * _power(_BASE, b - a), out=sums[1:])
            out[lo:hi] = (sums[ends[lo:hi] - a] - sums[starts[lo:hi] - a]) * _power(_INVERSE, b - a + 1)[starts[lo:hi] - a]
        lo = hi
    return mix(out + (ends - starts).astype(np.uint64))


def per_text(docs: DataFrame, columns: list[str], schema: str, work: Callable) -> DataFrame:
    """Runs ``work(lo, hi, data, offsets) -> arrays`` over slices of the last column; other columns are handed on.

    ``work`` is made by ``work()`` in each task, so that what it prepares is prepared once a task. Its arrays follow the
    handed-on columns in ``schema``.
    """
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        step = work()
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(len(columns) - 1)):
                own = [batch.column(i).slice(lo, hi - lo) for i in range(len(columns) - 1)]
                made = [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x) for x in step(data, offsets)]
                yield pa.RecordBatch.from_arrays(own + made, names=names)

    return over_batches(docs.select(*columns), run, schema)
