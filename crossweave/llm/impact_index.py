"""Exact top-k by inner product of integer vectors, over an impact-ordered index processed score at a time.

Entries (distinct vectors) are dealt to blocks of ``ENTRIES`` by a hash. A block's index has for each dimension posting segments in
order of their quantised impact: a segment holds the entries whose component lies between two bounds, ``LEVELS`` of them a
dimension. With a query's weights every segment has a greatest contribution. Segments are processed by descending contribution,
whatever their dimension, and add it to their entries' sums. Between steps an entry's score can't exceed its sum and the greatest
contributions left for the dimensions in which it was not met; ``tail`` holds the sums of the greatest of these. Entries above the
threshold of proven scores are possible members. Processing stops only when few enough of them are left or nothing is, and
all of them are scored exactly, so results don't depend on where it stops.

The threshold starts from the query's own block of the index (one block a query, by a hash): the scores found there are proven, and
all other blocks are searched with them. Blocks of queries meet blocks of the index one pair at a time in a task; both are of
fixed size.

Defined results: components are floor(``SCALE`` * x), up to ``LARGEST`` in size; larger ones are an error. Vectors that are null, or
hold null or non-finite components, and rows with a null id take no part. Vectors of different lengths don't meet. Zero vectors score 0.
Equal vectors are one entry with as many of its smallest ids as a result can hold. A candidate id that repeats counts once, with
its best score; a query id that repeats with different vectors is asked with the smallest in array order. No vectors, no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

SCALE = 1024
LARGEST = 1 << 27
NEAREST = 10
ENTRIES = 4096
QUERIES = 1024
LEVELS = 32
#: So many possible members of a block are scored exactly without narrowing them down further.
RESCORE = 512

_NEVER = -(1 << 62)
_BLOCK = "size int, x long, ids array<array<long>>, vecs binary, dims array<int>, lows array<int>, highs array<int>, ends array<int>, members array<int>"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, vec (integers) and size of the vectors that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("raw"))
    finite = ~F.exists("raw", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("raw").isNotNull() & finite)
    whole = lambda x: F.when(F.abs(x) * SCALE < LARGEST, F.floor(x * SCALE).cast("int")).otherwise(F.raise_error(F.lit("a component is too large")).cast("int"))
    return rows.select("vec_id", F.transform("raw", whole).alias("vec"), F.size("raw").alias("size"))


def entries_of(rows: DataFrame, most: int) -> DataFrame:
    """size, vec and its ``most`` smallest ids: of parts of a vector's rows first, so that no task holds all rows of a common one."""
    ordered = Window.partitionBy("vec", "part").orderBy("vec_id")
    few = rows.distinct().withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(64))).withColumn("place", F.row_number().over(ordered)).filter(F.col("place") <= most)
    return few.groupBy("size", "vec").agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, most).alias("ids"))


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(rows, -1) if rows else np.zeros((0, 0), np.int64)


def index_block(block: pa.Table) -> pa.Table:
    """The posting segments of one block's entries."""
    block = block.combine_chunks()
    n = len(block)
    v = _matrix(block.column("vec").combine_chunks(), n)
    dims, lows, highs, ends, members = [], [], [], [0], []
    for d in range(v.shape[1]):
        own = v[:, d]
        step = max(1, -(-int(own.max() - own.min() + 1) // LEVELS))
        level = (own - own.min()) // step
        order = np.argsort(-level, kind="stable")
        cuts = np.flatnonzero(np.diff(level[order], prepend=-1))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), n], strict=True):
            inside = own[order[a:b]]
            dims.append(d)
            lows.append(int(inside.min()))
            highs.append(int(inside.max()))
            ends.append(ends[-1] + b - a)
        members.append(order)
    flat = np.concatenate([np.zeros(0, np.int64), *members])
    row = {
        "size": [v.shape[1]], "x": [block.column("x")[0].as_py()], "ids": [block.column("ids").to_pylist()], "vecs": [v.astype(np.int32).tobytes()],
        "dims": [dims], "lows": [lows], "highs": [highs], "ends": [ends], "members": [flat],
    }
    kinds = {"size": pa.int32(), "x": pa.int64(), "ids": pa.list_(pa.list_(pa.int64())), "vecs": pa.binary()}
    return pa.table([pa.array(c, kinds.get(name, pa.list_(pa.int32()))) for name, c in row.items()], names=list(row))


class Block:
    """One block of the index, ready to be searched."""

    def __init__(self, row: dict):
        self.ids = [np.array(x, np.int64) for x in row["ids"]]
        self.vecs = np.frombuffer(row["vecs"], np.int32).reshape(len(self.ids), row["size"])
        self.dims, self.lows, self.highs, self.ends, self.members = (np.array(row[c], np.int64) for c in ("dims", "lows", "highs", "ends", "members"))
        self.sizes = np.diff(self.ends)
        self.only = {int(x[0]): i for i, x in enumerate(self.ids) if len(x) == 1}

    def _exact(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        return self.vecs[rows].astype(np.int64) @ query

    def search(self, own: int, query: np.ndarray, least: int | None, nearest: int) -> tuple[np.ndarray, np.ndarray]:
        """Entries (of the block) that may be among the nearest, with their exact scores.

        Left out are only entries proven to score below ``least`` or below ``nearest`` others here. An entry that is nothing but
        the query's own row does not count.
        """
        n, size = self.vecs.shape
        highest = np.maximum(self.lows * query[self.dims], self.highs * query[self.dims])
        order = np.argsort(-highest, kind="stable")
        sums, met = np.zeros(n, np.int64), np.zeros(n, np.int64)
        mine = self.only.get(own, -1)
        at, step = 0, max(1, len(order) // 16)
        while True:
            # The greatest contributions still to come: in each dimension that of its next segment.
            rest = order[at:]
            _, nexts = np.unique(self.dims[rest], return_index=True)
            left = -np.sort(-highest[rest[nexts]])
            tail = np.concatenate([[0], np.cumsum(left)])
            bound = sums + tail[size - met]
            if mine >= 0:
                bound[mine] = _NEVER
            if n - (mine >= 0) >= nearest and at:
                # Scores of the likeliest entries are proven, so the threshold may rise to them.
                ahead = np.argpartition(-bound, nearest - 1)[:nearest]
                sure = int(self._exact(ahead, query).min())
                least = sure if least is None else max(least, sure)
            possible = np.flatnonzero(bound >= (least if least is not None else _NEVER + 1))
            if len(possible) <= RESCORE or at >= len(order):
                break
            now = order[at : at + step]
            at += step
            places = np.concatenate([self.members[a:b] for a, b in zip(self.ends[now].tolist(), self.ends[now + 1].tolist(), strict=True)])
            np.add.at(sums, places, np.repeat(highest[now], self.sizes[now]))
            np.add.at(met, places, 1)
        if mine >= 0:
            possible = possible[possible != mine]
        score = self._exact(possible, query)
        if len(score) > nearest:
            keep = score >= np.partition(score, len(score) - nearest)[len(score) - nearest]
            possible, score = possible[keep], score[keep]
        return (possible, score) if least is None else (possible[score >= least], score[score >= least])


def _searched(index: DataFrame, asked: DataFrame, nearest: int, parts: int) -> DataFrame:
    """query_id, vec_id, score of the possible members of each (size, x, q): a block of the index and the queries put to it."""

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        who, ids, scores = [], [], []
        if len(a) and len(b):
            b = b.combine_chunks()
            block, queries = Block(a.to_pylist()[0]), _matrix(b.column("vec").combine_chunks(), len(b))
            for own, query, least in zip(b.column("query_id").to_pylist(), queries, b.column("least").to_pylist(), strict=True):
                at, score = block.search(own, query, least, nearest)
                for i, s in zip(at.tolist(), score.tolist(), strict=True):
                    named = block.ids[i][block.ids[i] != own]
                    who.append(np.full(len(named), own))
                    ids.append(named)
                    scores.append(np.full(len(named), s))
        return pa.table([np.concatenate([np.zeros(0, np.int64), *c]) for c in (who, ids, scores)], names=["query_id", "vec_id", "score"])

    keys = ("size", "x", "q")
    left, right = (t.repartition(parts, *keys).groupBy(*keys) for t in (index, asked))
    return left.cogroup(right).applyInArrow(meet, "query_id long, vec_id long, score long")


def search(vectors: DataFrame, queries: DataFrame, nearest: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id, score of the ``nearest`` highest inner products of each query, ties to smaller ids.

    ``vectors`` and ``queries`` have vec_id and embedding; a query's own id is never among its results.
    """
    scratch = Scratch()
    entries = scratch.stage(entries_of(usable(vectors), nearest + 1), "impact-entries")
    asked = usable(queries).groupBy(F.col("vec_id").alias("query_id"), "size").agg(F.min("vec").alias("vec"))
    asked = scratch.stage(asked.groupBy("query_id").agg(F.min_by(F.struct("vec", "size"), "vec").alias("v")).select("query_id", "v.*"), "impact-queries")

    share = lambda rows, most, name: rows.groupBy("size").agg(F.ceil(F.count("*") / most).alias(name))
    blocks = scratch.stage(share(entries, ENTRIES, "nx").join(share(asked, QUERIES, "nq"), "size"), "impact-blocks")
    total = blocks.agg(F.sum(F.col("nx") * F.col("nq")).alias("pairs"), F.max("nx").alias("nx")).first()
    parts = max(1, min(total["pairs"] or 1, 8192))

    dealt = entries.join(blocks.select("size", "nx"), "size").select("size", F.pmod(F.xxhash64("vec"), F.col("nx")).alias("x"), "vec", "ids")
    index = scratch.stage(dealt.groupBy("size", "x").applyInArrow(index_block, _BLOCK), "impact-index")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    spread_index = index.join(blocks.select("size", "nq"), "size").withColumn("q", every("nq")).drop("nq")
    own = asked.join(blocks, "size").select(
        "query_id", "vec", "size", "nx", F.pmod(F.xxhash64("query_id"), F.col("nq")).alias("q"), F.pmod(F.xxhash64("query_id", F.lit(1)), F.col("nx")).alias("home")
    )
    at_home = own.select("query_id", "vec", "size", F.col("home").alias("x"), "q", F.lit(None).cast("long").alias("least"))
    found = scratch.stage(_searched(spread_index, at_home, nearest, parts), "impact-home")
    if total["nx"] and total["nx"] > 1:
        first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        proven = found.distinct().withColumn("rank", F.row_number().over(first)).filter(F.col("rank") == nearest).select("query_id", F.col("score").alias("least"))
        away = own.join(proven, "query_id", "left").withColumn("x", every("nx")).filter("x <> home").select("query_id", "vec", "size", "x", "q", "least")
        found = found.union(scratch.stage(_searched(spread_index, away, nearest, parts), "impact-away"))
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= nearest)
    return scratch.keep(ranked.select("query_id", "rank", "vec_id", "score"), "impact-top")


def sql(scale: int = SCALE, nearest: int = NEAREST) -> str:
    """DuckDB SQL for the rows of ``search`` over the table embeddings, its rows with ids divisible by 100 as queries."""
    return f"""
    WITH whole AS (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM whole q JOIN whole c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v))
    SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM scored
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= {nearest}"""
