"""Mixes sources to target weights.

The words of each source are counted, the sources' targets follow from weights and caps, a source's repetition rate is its
target over its words, and every document is emitted floor(rate) times plus once more by a hash-seeded draw whose chance is
the fraction of the rate. Everything is DataFrame operations.

A few seeds are tried for every source and the one whose words come nearest the target is taken, in the same aggregation
that costs a pass over narrow rows; the draws of a document depend on its id and the seed alone, so reruns agree.

Nulls: a null text has no words; null sources form one source, the last; documents with a null id all draw alike. The
documents of a source without words are not emitted. Repeated rows draw alike and count each. An empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

#: Weights of the sources in code point order, repeated; the share of all words the mix has; the most a source repeats.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: Draws of 8 hexadecimal digits; four come from each digest.
SEEDS = 16


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Adds ``target`` to rows of source, source_size: shares by weight, no source above ``most`` times its size.

    With the sources sorted by cap over weight, those that stop at their cap are a first part of that order. What remains
    over the rest's weight is the level at that place; it rises while capped sources are left behind and falls after, so its
    maximum is the level of all that stay below their caps. The table has one row a source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("place"))
    before, every = filling.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    return (
        sizes.withColumn("place", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")))
        .withColumn("cap", F.lit(float(most)) * F.col("source_size"))
        .withColumn("left", F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
        .withColumn("target", F.least(F.col("cap"), F.col("weight") * F.max("level").over(every)))
        .drop("cap", "left", "level", "weight", "place")
    )


def draw(doc_id: Column, seed: int) -> Column:
    """A number from 0 to 1 that id and seed fix: 8 digits of a digest."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed // 4}")).cast("binary"))
    return F.conv(F.substring(digest, seed % 4 * 8 + 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def rates(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target, whole (copies of every document), part (chance of one more), seed (from 1)."""
    narrow = stage(docs.select("doc_id", "source", words(F.col("text")).alias("size")), "mix-sizes")
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    rate = F.coalesce(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size")), F.lit(0.0))
    found = targets(sizes, weights, share, most).withColumn("whole", F.floor(rate)).withColumn("part", rate - F.floor(rate))
    found = stage(found, "mix-targets")
    taken = narrow.join(found, narrow["source"].eqNullSafe(found["source"])).select(
        found["source"], "target", "size", *[((F.col("whole") + (draw(F.col("doc_id"), j) < F.col("part")).cast("long")) * F.col("size")).alias(f"t{j}") for j in range(SEEDS)]
    )
    away = taken.groupBy("source").agg(*[F.abs(F.sum(f"t{j}") - F.first("target")).alias(f"t{j}") for j in range(SEEDS)])
    all_away = F.array(*[f"t{j}" for j in range(SEEDS)])
    best = away.select(F.col("source").alias("_source"), F.array_position(all_away, F.array_min(all_away)).alias("seed"))
    return stage(found.join(best, F.col("source").eqNullSafe(F.col("_source"))).drop("_source"), "mix-rates")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Every document once, with struct ``_mix`` of size, source_size, target and copies."""
    found = rates(docs, weights, share, most)
    found = found.select(*[F.col(c).alias(f"_mix_{c}") for c in found.columns])
    chosen = F.element_at(F.array(*[draw(F.col("doc_id"), j) for j in range(SEEDS)]), F.col("_mix_seed").cast("int"))
    copies = F.col("_mix_whole") + (chosen < F.col("_mix_part")).cast("long")
    made = F.struct(words(F.col("text")).alias("size"), F.col("_mix_source_size").alias("source_size"), F.col("_mix_target").alias("target"), copies.alias("copies"))
    return docs.join(found, docs["source"].eqNullSafe(found["_mix_source"])).select(*[docs[c] for c in docs.columns], made.alias("_mix"))


def emit(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken."""
    mixed = mix(docs).filter("_mix.copies > 0")
    return mixed.withColumn("_mix", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mix.copies")))).drop("_mix")


def _sql_draw(seed: int) -> str:
    return f"(('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':{seed // 4}'), {seed % 4 * 8 + 1}, 8))::BIGINT::DOUBLE / 4294967296.0)"


def sql(table: str = "documents") -> str:
    """DuckDB SQL for doc_id, source, size, source_size, target and copies of each row of a table."""
    weight = " ".join(f"WHEN {i} THEN {float(w)}" for i, w in enumerate(WEIGHTS))
    tried = ", ".join(f"abs(sum((whole + ({_sql_draw(j)} < part)::BIGINT) * size) - any_value(target))" for j in range(SEEDS))
    draws = ", ".join(_sql_draw(j) for j in range(SEEDS))
    return f"""
    WITH narrow AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM {table}),
    sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM narrow GROUP BY source),
    placed AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS place FROM sizes),
    weighed AS (SELECT *, CASE place % {len(WEIGHTS)} {weight} END AS weight, {float(MOST)} * source_size AS cap FROM placed),
    levels AS (SELECT *, ({SHARE} * sum(source_size) OVER () - coalesce(sum(cap) OVER f, 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0.0)) AS level
               FROM weighed WINDOW f AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    targets AS (SELECT source, source_size, least(cap, weight * max(level) OVER ()) AS target FROM levels),
    rated AS (SELECT *, coalesce(target / nullif(source_size, 0), 0.0) AS rate FROM targets),
    parts AS (SELECT *, floor(rate)::BIGINT AS whole, rate - floor(rate) AS part FROM rated),
    tried AS (SELECT n.source, [{tried}] AS away FROM narrow n JOIN parts p ON n.source IS NOT DISTINCT FROM p.source GROUP BY n.source),
    seeds AS (SELECT source, list_position(away, list_min(away)) AS seed FROM tried)
    SELECT n.doc_id, n.source, n.size, p.source_size, p.target, p.whole + (([{draws}])[s.seed] < p.part)::BIGINT AS copies
    FROM narrow n JOIN parts p ON n.source IS NOT DISTINCT FROM p.source JOIN seeds s ON n.source IS NOT DISTINCT FROM s.source"""
