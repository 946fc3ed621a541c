"""How five document filters work together: what each removes in every order in which they can be applied.

Every document becomes a mask of the filters it fails. Rows are counted by text first, so that copies of one text, however many,
are one row before anything is joined; then by part, mask and labels. What is left is a cell for each part and mask, at most 32 a
part. Each cell folds across the array of all orders: ``transform`` walks the orders and their steps, ``aggregate`` folds the
earlier steps of an order into the mask they remove, and the cell's counts weigh the 600 structs that come out. The arrays of a
part's cells are merged by sums element by element. The array of orders is a constant of fixed size that goes out with the plan.

Failing: A under ``LEAST_WORDS`` words; B distinct words under 80 % of words; C capitals A-Z over 10 % of code points; D any of
#$%&*|; E the text of a smaller doc_id. Words are maximal runs without white space, compared as they stand.

Defined results: a null text is empty (fails A, and E after the first). A null lang and an empty one are one part, "". A null
doc_id has no labels, is no one's smaller id and never fails E. Rows that repeat a doc_id count each; those of the smallest id of
a text all pass E. A document has a label if any of its rows in ``labels`` says 1. No documents, no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
LEAST_WORDS = 100
WORD = r"[^\x20\x09-\x0D]+"
COUNTS = ("n", "good", "toxic")
SUMS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def own_failures(n: Column, distinct: Column, length: Column, capitals: Column, marked: Column) -> Column:
    """Bits 1, 2, 4, 8 of the filters A to D that a text fails by itself."""
    fails = (n < LEAST_WORDS, 100 * distinct < 80 * n, 100 * capitals > 10 * length, marked)
    return sum((F.when(fail, 1 << i).otherwise(0) for i, fail in enumerate(fails)), F.lit(0))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, part, own (mask of A to D) and digest of every document."""
    text, long = F.coalesce(F.col("text"), F.lit("")), lambda c: c.cast("long")
    words = docs.select(
        long(F.col("doc_id")).alias("doc_id"), F.coalesce(F.col("lang"), F.lit("")).alias("part"), text.alias("text"),
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"),
    )
    return words.select(
        "doc_id", "part", F.sha2(F.col("text").cast("binary"), 256).alias("digest"),
        own_failures(
            long(F.size("words")), long(F.size(F.array_distinct("words"))), long(F.length("text")),
            long(F.length("text") - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))), F.col("text").rlike(r"[#$%&*|]"),
        ).alias("own"),
    )


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents of each part by the filters they fail, and those among them with each label."""
    rows = measured(docs).groupBy("digest", "own", "part", "doc_id").agg(F.count("*").alias("n"))
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    weighed = [(F.coalesce(F.col(c), F.lit(0)) * F.col("n")).alias(c) for c in ("good", "toxic")]
    # Null ids have no labels; their texts are part of the key, so that they do not all meet in one task.
    apart = F.when(F.col("doc_id").isNull(), F.col("digest")).otherwise("")
    every = rows.withColumn("apart", apart).join(known.withColumn("apart", F.lit("")), ["doc_id", "apart"], "left").select("digest", "own", "part", "doc_id", "n", *weighed)

    # Of each text, the rows of the smallest id pass E. The first id of the text in each part is enough to find them.
    some = F.col("doc_id").isNotNull()
    texts = every.groupBy("digest", "own", "part").agg(
        *[F.sum(c).alias(c) for c in COUNTS], F.sum(F.when(some, 0).otherwise(F.col("n"))).alias("nameless"), F.min(F.when(some, F.struct("doc_id", *COUNTS))).alias("first")
    )
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))  # one row for each part that holds the text
    leads = F.coalesce(F.col("first.doc_id") == F.col("least"), F.lit(False))
    passing = {c: F.when(leads, F.col(f"first.{c}")).otherwise(0) + (F.col("nameless") if c == "n" else 0) for c in COUNTS}
    sides = [(F.col("own"), passing), (F.col("own") + 16, {c: F.col(c) - v for c, v in passing.items()})]
    split = F.inline(F.array(*[F.struct(mask.alias("mask"), *[v.alias(c) for c, v in counts.items()]) for mask, counts in sides]))
    return texts.withColumn("least", least).select("part", split).filter("n > 0").groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in COUNTS])


def fold(cell: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Per part, order of the filters and step: the sums of all cells, and each filter's removals over all orders.

    ``cell`` has part, mask (bit i: fails filter i), n, good and toxic; parts and masks are few. The merge of a part's cells
    takes 2 ** len(filters) arrays at most.
    """
    names = ["".join(x) for x in permutations(filters)]
    orders = F.expr("array({})".format(", ".join("array({})".format(", ".join(str(1 << filters.index(x)) for x in name)) for name in names)))

    def steps(order: Column) -> Column:
        def one(bit: Column, i: Column) -> Column:
            gone = F.aggregate(F.slice(order, F.lit(1), i), F.lit(0), lambda m, x: m.bitwiseOR(x)).bitwiseAND(F.col("mask")) != 0
            fails = F.col("mask").bitwiseAND(bit) != 0
            when = (~gone & ~fails, ~gone & fails, gone & fails, F.col("mask") == bit, ~gone & fails, ~gone & fails)
            weight = ("n", "n", "n", "n", "good", "toxic")
            return F.struct(bit.alias("bit"), *[F.when(w, F.col(c)).otherwise(F.lit(0).cast("long")).alias(s) for w, c, s in zip(when, weight, SUMS, strict=True)])

        return F.transform(order, one)

    added = lambda a, b: F.struct(a["bit"].alias("bit"), *[(a[s] + b[s]).alias(s) for s in SUMS])
    folded = cell.select("part", F.flatten(F.transform(orders, steps)).alias("cell")).groupBy("part").agg(F.collect_list("cell").alias("cells"))
    merged = folded.select("part", F.aggregate(F.slice("cells", 2, 1 << len(filters)), F.element_at("cells", 1), lambda a, b: F.zip_with(a, b, added)).alias("sums"))
    shapley = F.aggregate("sums", F.lit(0).cast("long"), lambda s, x: s + F.when(x["bit"] == F.col("one.bit"), x["removed"]).otherwise(0))
    each = merged.select("part", "sums", F.posexplode("sums").alias("at", "one"))
    place = (F.col("at") / len(filters)).cast("int") + 1
    return each.select(
        "part", F.element_at(F.split(F.lit(" ".join(names)), " "), place).alias("filter_order"), (F.col("at") % len(filters) + 1).cast("int").alias("step"),
        *[F.col(f"one.{s}").alias(s) for s in SUMS], shapley.alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, the counts of ``SUMS`` and shapley: 600 rows a part."""
    return fold(cells(docs, labels))


def sql() -> str:
    """DuckDB SQL for the rows of ``audit`` over the tables documents and labels."""
    letters = ", ".join(f"('{c}', {1 << i})" for i, c in enumerate(FILTERS))
    joined = " || ".join(f"f{i}.c" for i in range(1, 6))
    apart = " AND ".join(f"f{i}.c <> f{j}.c" for j in range(2, 6) for i in range(1, j))
    return rf"""
    WITH words AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    masked AS (SELECT doc_id, part, text,
        (len(w) < {LEAST_WORDS})::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT
        + 4 * (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT AS own FROM words),
    labelled AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
    failing AS (SELECT part, own + 16 * coalesce(m.doc_id > min(m.doc_id) OVER (PARTITION BY text), false)::INT AS mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
        FROM masked m LEFT JOIN labelled l ON m.doc_id = l.doc_id),
    cells AS (SELECT part, mask, count(*) AS n, sum(good)::BIGINT AS good, sum(toxic)::BIGINT AS toxic FROM failing GROUP BY ALL),
    letters(c, bit) AS (VALUES {letters}),
    orders AS (SELECT {joined} AS filter_order FROM letters f1, letters f2, letters f3, letters f4, letters f5 WHERE {apart}),
    steps AS (SELECT filter_order, step::INT AS step, c, bit,
        coalesce((SELECT sum(e.bit) FROM letters e WHERE strpos(filter_order, e.c) < step), 0)::INT AS before FROM orders, range(1, 6) r(step), letters WHERE c = filter_order[step]),
    counted AS (SELECT part, filter_order, step, c,
        sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
        sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
        sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
        FROM cells, steps GROUP BY part, filter_order, step, c)
    SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, c)::BIGINT AS shapley FROM counted"""
