"""Ordered-sequence operators: runs, frames, running state.

A sequence is the rows of one key in an order: a function's units, a file's
lines, a user's events. Where a sequence is known to be short, windows over its
key do. Where one key may hold a large share of all rows, ``Ordered.split``
numbers the rows across range partitions, cuts each sequence into chunks of a
fixed number of rows and works chunk by chunk; what a chunk needs from earlier
ones is one small row per chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

CHUNK_ROWS = 100_000


class Ordered:
    """Rows with a sequence key and an order, plain or split into chunks."""

    def __init__(self, df: DataFrame, part: list[str], order: list[str], chunk_rows: int | None = None):
        self.df, self.part, self.order, self.chunk_rows = df, part, order, chunk_rows

    @staticmethod
    def split(df: DataFrame, part: list[str], order: list[str], chunk_rows: int = CHUNK_ROWS) -> "Ordered":
        """Numbers each sequence's rows as ``_rn`` and cuts it into ``_chunk``s.

        Range partitions on key and order spread even a single hot key; each is
        counted, and a partition's rows are numbered from where the ones before
        it end.
        """
        spread = stage(
            df.repartitionByRange(*part, *order).withColumn("_b", F.spark_partition_id()), "ranges"
        )
        before = Window.partitionBy(*part).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        offsets = (
            spread.groupBy(*part, "_b").agg(F.count(F.lit(1)).alias("_n"))
            .withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
        )
        local = F.row_number().over(Window.partitionBy(*part, "_b").orderBy(*order))
        numbered = (
            spread.withColumn("_local", local).join(offsets, [*part, "_b"])
            .withColumn("_rn", F.col("_local") + F.col("_off"))
            .withColumn("_chunk", F.floor((F.col("_rn") - 1) / chunk_rows))
            .drop("_b", "_local", "_off")
        )
        return Ordered(numbered, part, ["_rn"], chunk_rows)

    @property
    def _keys(self) -> list[str]:
        return [*self.part, "_chunk"] if self.chunk_rows else self.part

    def _window(self):
        return Window.partitionBy(*self._keys).orderBy(*self.order)

    def _upto(self):
        return self._window().rowsBetween(Window.unboundedPreceding, 0)

    def _with(self, out: str, local: Column, per_chunk: Column, carry, merge) -> "Ordered":
        if not self.chunk_rows:
            return self._next(self.df.withColumn(out, merge(local, F.lit(None))))
        chunks = self.df.groupBy(*self._keys).agg(per_chunk.alias("_agg"))
        w = Window.partitionBy(*self.part).orderBy("_chunk")
        carried = chunks.select(*self._keys, carry(w).alias("_carry"))
        rows = self.df.withColumn("_loc", local).join(carried, self._keys)
        return self._next(rows.withColumn(out, merge(F.col("_loc"), F.col("_carry"))).drop("_loc", "_carry"))

    def _next(self, df: DataFrame) -> "Ordered":
        return Ordered(df, self.part, self.order, self.chunk_rows)

    def previous(self, value: str, out: str) -> "Ordered":
        """The value of the row before; NULL on the first."""
        if not self.chunk_rows:
            return self._next(self.df.withColumn(out, F.lag(value).over(self._window())))
        first = F.row_number().over(self._window()) == 1
        local = F.struct(F.lag(value).over(self._window()).alias("v"), first.alias("first"))
        return self._with(
            out, local, F.max_by(value, "_rn"),
            lambda w: F.lag("_agg").over(w),
            lambda loc, carry: F.when(loc["first"], carry).otherwise(loc["v"]),
        )

    def running_sum(self, value: Column, out: str) -> "Ordered":
        return self._with(
            out, F.sum(value).over(self._upto()), F.sum(value),
            lambda w: F.sum("_agg").over(w.rowsBetween(Window.unboundedPreceding, -1)),
            lambda loc, carry: F.coalesce(loc, F.lit(0)) + F.coalesce(carry, F.lit(0)),
        )

    def running_last(self, value: Column, out: str) -> "Ordered":
        """The last non-NULL value so far."""
        at = F.when(value.isNotNull(), F.col("_rn")) if self.chunk_rows else F.lit(1)
        return self._with(
            out, F.last(value, ignorenulls=True).over(self._upto()), F.max_by(value, at),
            lambda w: F.last("_agg", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
            lambda loc, carry: F.coalesce(loc, carry),
        )

    def max_before(self, value: str, out: str) -> "Ordered":
        """The largest value on earlier rows."""
        earlier = self._window().rowsBetween(Window.unboundedPreceding, -1)
        return self._with(
            out, F.max(value).over(earlier), F.max(value),
            lambda w: F.max("_agg").over(w.rowsBetween(Window.unboundedPreceding, -1)),
            lambda loc, carry: F.greatest(loc, carry) if self.chunk_rows else loc,
        )

    def frame(self, before: int, after: int, agg, out: str) -> "Ordered":
        """An aggregate over the rows from ``before`` above to ``after`` below.

        When split, rows near a chunk's edge are also sent to the chunk beside
        it, so every frame is complete within one chunk.
        """
        if not self.chunk_rows:
            return self._next(self.df.withColumn(out, agg.over(self._window().rowsBetween(-before, after))))
        assert max(before, after) < self.chunk_rows
        at = (F.col("_rn") - 1) % self.chunk_rows
        homes = F.filter(
            F.array(
                F.col("_chunk"),
                F.when(at < after, F.col("_chunk") - 1),
                F.when(at >= self.chunk_rows - before, F.col("_chunk") + 1),
            ),
            lambda c: c.isNotNull(),
        )
        spread = self.df.withColumn("_home", F.explode(homes))
        w = Window.partitionBy(*self.part, "_home").orderBy("_rn").rowsBetween(-before, after)
        return self._next(spread.withColumn(out, agg.over(w)).filter("_home = _chunk").drop("_home"))

    def islands(self, starts: Column, out: str = "island") -> "Ordered":
        """Numbers runs; ``starts`` is true on the first row of each."""
        return self.running_sum(F.when(starts, 1).otherwise(0), out)

    def runs_of_equal(self, value: str, out: str = "island") -> "Ordered":
        """Numbers maximal runs of rows with an equal value."""
        seen = self.previous(value, "_prev")
        numbered = seen.islands(F.col("_prev").isNull() | (F.col("_prev") != F.col(value)), out)
        return self._next(numbered.df.drop("_prev"))

    def rows(self) -> DataFrame:
        return self.df.drop("_rn", "_chunk")


def coalesce_near(df: DataFrame, part: list[str], at: str, gap: int, agg: list[Column] = ()) -> DataFrame:
    """Joins positions at most ``gap`` apart into ``start``..``end`` intervals."""
    seen = Ordered(df, part, [at]).previous(at, "_prev")
    runs = seen.islands(F.col("_prev").isNull() | (F.col(at) - F.col("_prev") > gap))
    return (
        runs.df.groupBy(*part, "island")
        .agg(F.min(at).alias("start"), F.max(at).alias("end"), *agg)
        .drop("island")
    )


def collapse_runs(seq: Ordered, value: str, least: int, at: str, agg: list[Column] = ()) -> DataFrame:
    """Runs of an equal value that are at least ``least`` rows long, one row each."""
    return (
        seq.runs_of_equal(value).df.groupBy(*seq.part, "island", value)
        .agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("length"), *agg)
        .filter(F.col("length") >= least)
        .drop("island")
    )


def near_marked(seq: Ordered, marked: Column, n: int) -> DataFrame:
    """Rows within ``n`` rows of a marked one, the marked ones included."""
    near = seq.frame(n, n, F.max(F.when(marked, 1).otherwise(0)), "_near")
    return near.rows().filter("_near = 1").drop("_near")


def print_once(seq: Ordered, start: str, end: str) -> DataFrame:
    """From which line each span shows lines that no earlier span has shown."""
    seen = seq.max_before(end, "_seen").rows()
    frm = F.greatest(F.col(start), F.coalesce(F.col("_seen"), F.lit(0)) + 1)
    return seen.withColumn("show_from", frm).withColumn(
        "lines_shown", F.greatest(F.col(end) - F.col("show_from") + 1, F.lit(0))
    ).drop("_seen")
