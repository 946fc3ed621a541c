"""Matching: one-to-one assignment, unique matches, best targets, set joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage


def greedy_one_to_one(
    edges: DataFrame, left: list[str], right: list[str], order: list[Column]
) -> DataFrame:
    """One-to-one assignment taking edges in ``order``, as a sequential greedy would.

    An edge that comes first among all edges of both its ends is one the
    sequential greedy must take, whatever else exists. Each round takes all such
    edges at once, drops the edges that touch their ends, and repeats until none
    is left. ``order`` has to be a total order on the edges, so the result is the
    sequential one exactly, and no group of edges is ever collected in one place:
    every step is a partial aggregation or a join on one end's key.
    """
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    left_key = F.struct(*[F.col(c) for c in left])
    right_key = F.struct(*[F.col(c) for c in right])
    live = stage(edges.select("*", rank.alias("_rank"), left_key.alias("_l"), right_key.alias("_r")), "edges")
    taken: list[DataFrame] = []
    while True:
        first_l = live.groupBy("_l").agg(F.min("_rank").alias("_rank"))
        first_r = live.groupBy("_r").agg(F.min("_rank").alias("_rank"))
        won = stage(
            live.join(first_l, ["_l", "_rank"], "left_semi").join(first_r, ["_r", "_rank"], "left_semi"),
            "won",
        )
        if won.isEmpty():
            break
        taken.append(won)
        live = stage(
            live.join(won.select("_l"), "_l", "left_anti").join(won.select("_r"), "_r", "left_anti"),
            "edges",
        )
        if live.isEmpty():
            break
    if not taken:
        return edges.limit(0)
    return reduce(DataFrame.unionByName, taken).select(*edges.columns)


def unique_two_sided(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Rows of both sides with equal keys, where each side has exactly one.

    Keys are counted with partial aggregation before anything is joined, so a
    key that a third of all rows share is gone before the join.
    """
    once = lambda d: d.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter("_n = 1").drop("_n")
    keys = once(left).join(once(right), key, "inner")
    return left.join(keys, key, "left_semi").join(right.join(keys, key, "left_semi"), key, "inner")


def best_targets(candidates: DataFrame, group: list[str], score: Column) -> DataFrame:
    """The best-scoring candidates per group; ``ties`` says how many share the best.

    With one, it is the target; with more, none is and all are listed, one row
    each. The best score and the number of ties come from one partial
    aggregation by score, so no group's candidates are gathered.
    """
    scored = candidates.withColumn("score", score)
    by_score = scored.groupBy(*group, "score").agg(F.count(F.lit(1)).alias("ties"))
    best = by_score.groupBy(*group).agg(F.max(F.struct("score", "ties")).alias("_b"))
    top = best.select(*group, F.col("_b.score").alias("score"), F.col("_b.ties").alias("ties"))
    return scored.join(top, [*group, "score"])


def keep_twinless(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Rows without a partner of the same key on the other side."""
    return left.join(right, key, "left_anti")


def keep_twins(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Rows with a partner of the same key on the other side, once each."""
    return left.join(right, key, "left_semi")


def similar_sets(
    left: DataFrame, right: DataFrame, lid: list[str], rid: list[str], lset: str, rset: str,
    threshold: float, within: list[str] | None = None,
) -> DataFrame:
    """Pairs of rows whose sets have Jaccard similarity of at least ``threshold``.

    Exact, without comparing all pairs: sets are ordered from the element rarest
    in the left sets to the one most frequent there, and two sets that similar
    must share an element among the first ``n - ceil(threshold * n) + 1`` of each.
    Elements that no left set has come first and meet nothing, so a right set
    only counts them. Right sets too large or small for any left one, or with too
    few of the left sets' elements, are left out before anything is joined by
    element; what stays of a right set is its share of those elements, which is all
    an intersection needs. ``within`` names columns that must be equal too.
    """
    within = within or []

    def sets(d: DataFrame, ids: list[str], col: str, side: str) -> DataFrame:
        named = [F.col(c).alias(f"{side}{c}") for c in ids]
        known = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in [*within, *ids]])
        return d.filter(known).select(*within, *named, F.array_distinct(col).alias("_s"))

    def need(n: Column) -> Column:
        return F.ceil(F.lit(threshold) * n - 1e-9)

    lids, rids = [f"l_{c}" for c in lid], [f"r_{c}" for c in rid]
    left_sets = stage(sets(left, lid, lset, "l_").withColumn("_k", F.monotonically_increasing_id()), "left_sets")
    one = left_sets.select(*within, "_k", F.size("_s").alias("l_n"), F.explode("_s").alias("_e"))
    items = stage(one.groupBy(*within, "_e").agg(F.count(F.lit(1)).alias("_df"), F.min("l_n").alias("_lo"), F.max("l_n").alias("_hi")), "left_items")
    # Each right set becomes its elements that left sets have, rarest first, in one pass over the texts.
    met = sets(right, rid, rset, "r_").withColumn("_row", F.monotonically_increasing_id())
    met = met.select(*within, *rids, "_row", F.size("_s").alias("r_n"), F.explode("_s").alias("_e")).join(items, [*within, "_e"])
    met = met.filter((F.col("_hi") >= F.col("r_n") * threshold - 1e-9) & (F.col("r_n") >= F.col("_lo") * threshold - 1e-9))
    kept = met.groupBy(*within, *rids, "_row", "r_n").agg(F.array_sort(F.collect_list(F.struct("_df", "_e"))).alias("_o"))
    kept = stage(kept.withColumn("_need", need(F.col("r_n"))).filter(F.size("_o") >= F.col("_need")), "right_sets")
    first = lambda n: F.slice("_o", F.lit(1), n.cast("int"))
    # Of the n - need + 1 first elements of a right set, those that left sets lack are gone already.
    b = kept.select(*within, "_row", "r_n", F.explode(first(F.size("_o") - F.col("_need") + 1)).alias("_x")).select(*within, "_row", "r_n", F.col("_x._e").alias("_e"))
    ordered = one.join(items.select(*within, "_e", "_df"), [*within, "_e"]).groupBy(*within, "_k", "l_n").agg(F.array_sort(F.collect_list(F.struct("_df", "_e"))).alias("_o"))
    a = ordered.select(*within, "_k", "l_n", F.explode(first(F.col("l_n") - need(F.col("l_n")) + 1)).alias("_x")).select(*within, "_k", "l_n", F.col("_x._e").alias("_e"))
    alike = (F.col("l_n") >= F.col("r_n") * threshold - 1e-9) & (F.col("r_n") >= F.col("l_n") * threshold - 1e-9)
    pairs = a.join(b, [*within, "_e"]).filter(alike).select("_k", "_row").distinct()
    full = pairs.join(left_sets.select("_k", *lids, F.col("_s").alias("l_set")), "_k").join(
        kept.select(*within, "_row", *rids, "r_n", F.transform("_o", lambda x: x["_e"]).alias("r_set")), "_row"
    )
    shared = F.size(F.array_intersect("l_set", "r_set"))
    score = shared / (F.size("l_set") + F.col("r_n") - shared)
    return full.select(*within, *lids, *rids, score.alias("jaccard")).filter(F.col("jaccard") >= threshold - 1e-9)


def contained_runs(
    needles: DataFrame, hay: DataFrame, nid: list[str], hid: list[str], share: float = 0.5,
    within: list[str] | None = None,
) -> DataFrame:
    """Which texts carry at least ``share`` of another text's word runs.

    ``needles`` and ``hay`` have a ``runs`` array. Runs are made distinct inside
    each row before they are exploded, and the matches are counted with partial
    aggregation, so only runs found on both sides travel. Every run of a needle
    counts, repeats included, as each is a place in the text.
    """
    within = within or []
    total = needles.select(*within, *nid, F.size("runs").alias("runs_total")).filter("runs_total > 0")
    wanted = needles.select(*within, *nid, F.explode("runs").alias("run")).groupBy(*within, *nid, "run").agg(
        F.count(F.lit(1)).alias("times")
    )
    have = hay.select(*within, *hid, F.explode(F.array_distinct("runs")).alias("run"))
    hits = wanted.join(have, [*within, "run"]).groupBy(*within, *nid, *hid).agg(F.sum("times").alias("runs_found"))
    return hits.join(total, [*within, *nid]).filter(F.col("runs_found") >= share * F.col("runs_total"))


def rank_within(df: DataFrame, group: list[str], order: list[Column], k: int, out: str = "rank") -> DataFrame:
    """The first ``k`` rows per group in ``order``; ties go by the order's last key."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= k)


def first_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key: the first in ``order``, found by partial aggregation."""
    rest = [c for c in df.columns if c not in key and c not in order]
    picked = df.groupBy(*key).agg(F.min(F.struct(*order, *[F.col(c) for c in rest])).alias("_f"))
    return picked.select(*key, *[F.col(f"_f.{c}").alias(c) for c in [*order, *rest]])


def enclosing(dirs: DataFrame, col: str, outer: str, inner: str) -> DataFrame:
    """Pairs of folders where one lies inside the other.

    Each folder lists the folders above it, so the pairs come from an equality
    join on the folder's full path instead of comparing every two.
    """
    parts = F.split(F.col(col), "/")
    above = dirs.select(
        F.col(col).alias(inner),
        F.explode(
            F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))
        ).alias(outer),
    )
    return above.join(dirs.select(F.col(col).alias(outer)), outer, "left_semi").select(outer, inner)
