"""Sequence and set comparisons as built-in column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` evaluated once, however often ``fn`` uses it.

    A column expression used inside a lambda would else be evaluated again for
    every element of the array the lambda runs over.
    """
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def bind2(a: Column, b: Column, fn) -> Column:
    return bind(F.struct(a.alias("a"), b.alias("b")), lambda p: fn(p["a"], p["b"]))


def literal_map(table: dict) -> Column:
    """A constant map, built as one expression."""
    def lit(v) -> str:
        if isinstance(v, str):
            return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return str(v).lower() if isinstance(v, bool) else str(v)
    return F.expr("map(" + ", ".join(f"{lit(k)}, {lit(v)}" for k, v in table.items()) + ")")


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two arrays read as sets; two empty arrays agree fully."""
    return bind2(a, b, _jaccard)


def _jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(
        F.size(F.array_intersect(a, b)) / union
    )


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays.

    One ``aggregate`` over ``a`` carries the row of best lengths over ``b``;
    the inner ``aggregate`` extends that row from left to right.
    """
    return bind2(a, b, _lcs_length)


def _lcs_length(a: Column, b: Column) -> Column:
    zero = F.transform(b, lambda _: F.lit(0))
    def next_row(row: Column, x: Column) -> Column:
        shifted = F.concat(
            F.array(F.lit(0)), F.slice(row, 1, F.greatest(F.size(b) - 1, F.lit(0)))
        )
        scores = F.zip_with(row, shifted, lambda up, diag: F.struct(up.alias("up"), diag.alias("diag")))
        diag_or_up = F.zip_with(
            b, scores, lambda y, c: F.when(y == x, c["diag"] + 1).otherwise(c["up"])
        )
        return F.aggregate(
            diag_or_up,
            F.array().cast("array<int>"),
            lambda acc, v: F.concat(
                acc, F.array(F.greatest(v, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0))))
            ),
        )
    last = F.aggregate(a, zero, next_row)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0)).otherwise(
        F.coalesce(F.try_element_at(last, F.lit(-1)), F.lit(0))
    )


def seq_similarity(a: Column, b: Column) -> Column:
    """Order-sensitive similarity of two arrays: 2 * LCS / (n + m)."""
    def share(a: Column, b: Column) -> Column:
        total = F.size(a) + F.size(b)
        return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * _lcs_length(a, b) / total)
    return bind2(a, b, share)


def soft_overlap(a: Column, b: Column) -> Column:
    """Overlap of two arrays of word arrays, each entry by its best partner.

    The mean of both directions, never more than the better side's own mean,
    with near misses worth less than equal entries.
    """
    return bind2(a, b, _soft_overlap)


def _soft_overlap(a: Column, b: Column) -> Column:
    def best(x: Column, ys: Column) -> Column:
        return F.coalesce(
            F.array_max(
                F.transform(ys, lambda y: F.when(x == y, F.lit(1.0)).otherwise(seq_similarity(x, y)))
            ),
            F.lit(0.0),
        )
    def total(xs: Column, ys: Column) -> Column:
        return F.aggregate(F.transform(xs, lambda x: best(x, ys)), F.lit(0.0), lambda s, v: s + v)
    sa, sb = total(a, b), total(b, a)
    side = lambda s, n: F.when(n == 0, F.lit(0.0)).otherwise(s / n)
    raw = (sa + sb) / (F.size(a) + F.size(b))
    cap = F.greatest(side(sa, F.size(a)), side(sb, F.size(b)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(F.least(raw, cap))


def shingles(words: Column, n: int = 3) -> Column:
    """Every run of ``n`` consecutive words, joined by blanks; empty if too short."""
    def build(ws: Column) -> Column:
        return F.when(
            F.size(ws) >= n,
            F.transform(
                F.sequence(F.lit(1), F.size(ws) - (n - 1)),
                lambda i: F.array_join(F.slice(ws, i, n), " "),
            ),
        ).otherwise(F.array().cast("array<string>"))
    return bind(words, build)


def uniq(arr: Column) -> Column:
    """Distinct entries in order of first appearance."""
    return F.array_distinct(arr)


def minus(a: Column, b: Column) -> Column:
    """Distinct entries of ``a`` that ``b`` lacks, in ``a``'s order."""
    return F.array_except(a, b)


def kept_count(words: Column, other: Column) -> Column:
    """How many of the words, repeats included, the other list has."""
    return F.size(F.filter(words, lambda w: F.array_contains(other, w)))


def words_kept(words: Column, other: Column, share: float = 0.8, least: int = 4) -> Column:
    """Whether most words of a comment long enough to tell are in the other list."""
    return (F.size(words) >= least) & (kept_count(words, other) >= share * F.size(words))


def holds_run(words: Column, other: Column) -> Column:
    """Whether the words appear in the other list in order and without a break."""
    mark = lambda a: F.concat(F.lit("\u0001"), F.array_join(a, "\u0001"), F.lit("\u0001"))
    return (F.size(words) > 0) & F.contains(mark(other), mark(words))
