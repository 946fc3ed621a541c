"""Nearest neighbours with cross-polytope hashing.

A vector of unit length is turned by pseudo-random rotations (three rounds of random signs and a fast Hadamard transform) and
assigned to the nearest of the signed axes. ``HASHES`` such assignments make the address of a vector in one of ``TABLES``
tables. A query probes in each table the ``PROBES`` addresses that its rotations make likeliest; all vectors at these addresses
are its candidates and are ranked by their exact distance in double precision.

Equal vectors are one entry of the index, with the smallest ids of all that share it: as many as can stand in a result. So a
vector that millions share takes one place. The addresses' first parts are the groups in which probes and entries meet; groups are
cut into blocks of ``ENTRIES`` entries and ``QUERIES`` queries, by counts, so none grows with the data. Each block yields the
nearest of its candidates for each query, which is enough for the nearest of all.

Every vector is indexed and every query is answered; queries whose addresses held fewer than are asked for are compared with all
vectors, in blocks. Vectors that are null, zero, of another length than most, or that hold null or
non-finite components take no part. Ties go to the smaller id. Repeated ids with equal vectors count once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

TABLES = 16
HASHES = 2
PROBES = 320
NEAREST = 10
ENTRIES = 4096
QUERIES = 1024
#: Of each rotation, so many of the likeliest axes are considered when addresses are combined.
AXES = 64
SEED = 41


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    """Signs and Hadamard transform, three times, over the dimension rounded up to a power of two."""
    size = 1 << max(1, (x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), size))
    y[:, : x.shape[1]] = x
    signs = np.random.default_rng(seed).integers(0, 2, (3, size)) * 2.0 - 1
    for s in signs:
        y *= s
        step = 1
        while step < size:
            z = y.reshape(len(y), -1, 2, step)
            y = np.stack([z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]], 2).reshape(len(y), size)
            step *= 2
        y /= np.sqrt(size)
    return y


def axes(x: np.ndarray, table: int, j: int) -> np.ndarray:
    """How near each vector is to every signed axis: first the positive, then the negative ones."""
    y = rotate(x, SEED + 1000 * table + j)
    return np.concatenate([y, -y], axis=1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def addresses(x: np.ndarray, table: int) -> np.ndarray:
    """The nearest signed axis in each rotation of a table: one row a vector."""
    return np.stack([axes(x, table, j).argmax(1) for j in range(HASHES)], 1)


def probes(x: np.ndarray, table: int) -> list[np.ndarray]:
    """The likeliest addresses of each query: the largest sums of nearness, one combination of axes each."""
    near = [axes(x, table, j) for j in range(HASHES)]
    wide = min(AXES, near[0].shape[1])
    top = [np.argsort(-s, 1, kind="stable")[:, :wide] for s in near]
    out = []
    for i in range(len(x)):
        score, address = near[0][i, top[0][i]], top[0][i][:, None]
        for j in range(1, HASHES):
            own = near[j][i, top[j][i]]
            total = (score[:, None] + own[None, :]).ravel()
            keep = np.argsort(-total, kind="stable")[:PROBES]
            address = np.concatenate([address[keep // wide], top[j][i][keep % wide][:, None]], 1)
            score = total[keep]
        out.append(address[:PROBES])
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    values = np.asarray(column.flatten(), np.float64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 1)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vec (doubles) of the vectors that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"))
    finite = ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & finite & F.exists("vec", lambda x: x != 0))
    size = rows.groupBy(F.size("vec").alias("size")).count().orderBy(F.desc("count"), "size").first()
    return rows.filter(F.size("vec") == (size["size"] if size else 0))


def _smallest(rows: DataFrame, n: int) -> DataFrame:
    """vec and its n smallest ids: of parts of each vector's rows first, so that no group holds all rows of a common one."""
    ordered = Window.partitionBy("vec", "part").orderBy("vec_id")
    few = rows.distinct().withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(64))).withColumn("place", F.row_number().over(ordered)).filter(F.col("place") <= n)
    return few.groupBy("vec").agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, n).alias("ids"))


def _ranked(near: DataFrame, entries: DataFrame, nearest: int) -> DataFrame:
    """The first of each query by distance and id; an entry stands for its smallest ids."""
    named = near.join(entries.select("entry", "ids"), "entry").select("query_id", "score", F.explode("ids").alias("vec_id")).filter("vec_id <> query_id")
    best = named.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, nearest).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("i", "b")).select("query_id", (F.col("i") + 1).alias("rank"), "b.vec_id", "b.score")


def _nearest(x: np.ndarray, y: np.ndarray, nearest: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of x nearest to y, with all that tie with the last, and their distances."""
    d = np.sqrt(((x - y) ** 2).sum(1))
    if len(d) <= nearest + 1:
        return np.arange(len(d)), d
    keep = np.flatnonzero(d <= np.partition(d, nearest)[nearest])
    return keep, d[keep]


def _all_pairs_of_blocks(entries: DataFrame, queries: DataFrame, nearest: int) -> DataFrame:
    """The exact way for queries whose addresses held too few vectors: blocks of all entries meet blocks of these queries."""
    nx, nq = -(-entries.count() // ENTRIES) or 1, -(-queries.count() // QUERIES) or 1
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = entries.select(F.pmod(F.xxhash64("entry"), F.lit(nx)).cast("int").alias("x"), spread(nq).alias("q"), F.col("entry").alias("id"), "vec")
    right = queries.select(spread(nx).alias("x"), F.pmod(F.xxhash64("query_id"), F.lit(nq)).cast("int").alias("q"), F.col("query_id").alias("id"), "vec")

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        ids, x = a.column("id").to_numpy(), _matrix(a.column("vec").combine_chunks())
        who, y = b.column("id").to_numpy(), _matrix(b.column("vec").combine_chunks())
        found = [_nearest(x, y[i], nearest) for i in range(len(who))] if len(ids) else []
        cols = [np.concatenate([np.zeros(0, t), *c]) for t, c in (
            (np.int64, [np.full(len(at), w) for (at, _), w in zip(found, who.tolist(), strict=False)]), (np.int64, [ids[at] for at, _ in found]), (float, [d for _, d in found]))]
        return pa.table(cols, names=["query_id", "entry", "score"])

    return left.groupBy("x", "q").cogroup(right.groupBy("x", "q")).applyInArrow(meet, "query_id long, entry long, score double")


def search(vectors: DataFrame, queries: DataFrame, nearest: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id, score of the nearest vectors found for each query.

    ``vectors`` and ``queries`` have vec_id and embedding; a query's own id is never among its results.
    """
    rows = usable(vectors)
    entries = stage(_smallest(rows, nearest + 1).withColumn("entry", F.element_at("ids", 1)), "ann-entries")
    asked = stage(usable(queries).select(F.col("vec_id").alias("query_id"), "vec").dropDuplicates(["query_id"]), "ann-queries")

    def addressed(batches):
        for batch in batches:
            x = unit(_matrix(batch.column(1)))
            for t in range(TABLES):
                a = addresses(x, t) if len(x) else np.zeros((0, HASHES), np.int64)
                rest = a[:, 1] if HASHES > 1 else a[:, 0] * 0
                for j in range(2, HASHES):
                    rest = rest * 4096 + a[:, j]
                yield pa.record_batch([pa.array(np.full(len(x), t * 4096) + a[:, 0], pa.int64()), pa.array(rest, pa.int64()), batch.column(0), batch.column(1)], names=["bucket", "rest", "id", "vec"])

    def probed(batches):
        for batch in batches:
            x = unit(_matrix(batch.column(1)))
            for t in range(TABLES):
                buckets, rests, who = [], [], []
                for i, address in enumerate(probes(x, t)):
                    rest = address[:, 1] if HASHES > 1 else address[:, 0] * 0
                    for j in range(2, HASHES):
                        rest = rest * 4096 + address[:, j]
                    for b in np.unique(address[:, 0]).tolist():
                        buckets.append(t * 4096 + b)
                        rests.append(np.sort(rest[address[:, 0] == b]))
                        who.append(i)
                at = np.concatenate([[0], np.cumsum([len(r) for r in rests])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.zeros(0, np.int64), *rests])))
                take = pa.array(who, pa.int64())
                yield pa.record_batch([pa.array(buckets, pa.int64()), lists, batch.column(0).take(take), batch.column(1).take(take)], names=["bucket", "rests", "id", "vec"])

    index = stage(entries.select("entry", "vec").mapInArrow(addressed, "bucket long, rest long, id long, vec array<double>"), "ann-index")
    probe = stage(asked.mapInArrow(probed, "bucket long, rests array<long>, id long, vec array<double>"), "ann-probes")
    blocks = (
        index.groupBy("bucket").agg(F.ceil(F.count("*") / ENTRIES).alias("nx"))
        .join(probe.groupBy("bucket").agg(F.ceil(F.count("*") / QUERIES).alias("nq")), "bucket")
    )

    def dealt(rows, own, other):
        mine = F.pmod(F.xxhash64("id"), F.col(own))
        all_others = F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))
        rows = rows.join(blocks, "bucket").withColumn("mine", mine).withColumn("theirs", all_others)
        return rows.withColumn("x", F.col("mine" if own == "nx" else "theirs")).withColumn("q", F.col("theirs" if own == "nx" else "mine"))

    left = dealt(index, "nx", "nq").select("bucket", "x", "q", "rest", "id", "vec")
    right = dealt(probe, "nq", "nx").select("bucket", "x", "q", "rests", "id", "vec")

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        """The nearest entries of one block for each of its queries."""
        a, b = a.combine_chunks(), b.combine_chunks()
        out = []
        if len(a) and len(b):
            rest, ids, x = (a.column(n).combine_chunks() for n in ("rest", "id", "vec"))
            rest, ids, x = rest.to_numpy(), ids.to_numpy(), _matrix(x)
            order = np.argsort(rest, kind="stable")
            rest, ids, x = rest[order], ids[order], x[order]
            lists, who, y = b.column("rests").combine_chunks(), b.column("id").to_numpy(), _matrix(b.column("vec").combine_chunks())
            for i in range(len(who)):
                wanted = lists[i].values.to_numpy()
                lo, hi = np.searchsorted(rest, wanted, "left"), np.searchsorted(rest, wanted, "right")
                n = hi - lo
                at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                if len(at) == 0:
                    continue
                keep, d = _nearest(x[at], y[i], nearest)
                out.append((np.full(len(keep), who[i]), ids[at[keep]], d))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "entry", "score"])

    keys = ("bucket", "x", "q")
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "query_id long, entry long, score double")
    near = stage(met.groupBy("query_id", "entry").agg(F.min("score").alias("score")), "ann-near")
    enough = _ranked(near, entries, nearest).groupBy("query_id").agg(F.count("*").alias("found")).filter(F.col("found") >= nearest).select("query_id")
    lacking = stage(asked.join(enough, "query_id", "left_anti"), "ann-lacking")
    if not lacking.isEmpty():
        near = near.join(lacking, "query_id", "left_anti").union(_all_pairs_of_blocks(entries, lacking, nearest))
    return _ranked(near, entries, nearest)
