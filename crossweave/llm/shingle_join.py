"""Joins documents whose sets of word shingles are alike (Jaccard), by token-combination prefixes.

A document's set is its distinct shingles of ``k`` words, each a 64-bit hash. All sets are ordered by one order: shingles of the
frequent class last, within a class those of common words last, then by hash. Two sets of sizes n and m whose Jaccard similarity is at least ``num / den`` share at least
num/(num+den) of n + m shingles, so each holds few that the other lacks:

* The first shared shingle stands among the first ``lacking(n) + 1`` of either set (the prefix). If it is of the rare class, the
  two meet under that shingle alone. Every set indexes the rare shingles of its prefix.
* Otherwise all their shared shingles are frequent, and both have a frequent one in their prefix. Such sets extend the prefix to
  ``differing(n) + 2 + lacking(n)``: of the first ``differing + 2`` shared shingles, two follow each other with none between that
  only one set holds, since there are at most ``differing`` of those. So the two meet under a pair of neighbours, and these sets
  index the pairs of neighbours of the extended prefix. That is one key a place, not one for every pair of shingles.

The argument holds whatever shingles count as frequent and whatever words as common. Both are therefore tables of fixed size,
filled by a pass over all documents with the most frequent shingles and with the counts of words by slot, and are small
enough to be sent to all tasks. The order keeps shingles that unlike texts share by chance out of the prefixes.

Equal sets are one node. Under each key, the smallest node is the leader: every other is first compared with its leader only
(one pair a row, never all pairs of a key). Where a key then still holds several components, members of different components are
compared in blocks by sizes and by parity sketches, which bound how many shingles two sets can differ in; pairs that may be
alike go on to the exact comparison. So no link between components is lost, and copies are never expanded into pairs.

For the number of links the remaining pairs that share a key are compared too, those within one component included; this costs the
square of a group's size in pairs. ``join(count=False)`` leaves it out.

Results: one row a document with the size of its set, its component (the smallest doc_id reachable by links) and how many other
rows with an id are linked to it, copies included. Null and
empty texts have no set and are linked with nothing. Documents with fewer than ``k`` words have one shingle, all their words.
Repeated rows of a doc_id are repeated in the result. Rows with a null doc_id take the component of the other
rows with their set, or null.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from . import texts as T
from .components import components
from .scratch import Scratch

#: Bits of the table of frequent shingles, and how many shingles may set one.
CLASS_BITS = 1 << 21
CLASS_MOST = 1 << 16
#: Slots by which words are counted.
WORD_SLOTS = 1 << 16
#: A shingle is taken to be frequent from this many documents of a slice of the input on, and this many in all.
SLICE_LEAST = 4
FREQUENT = 64
#: Bits of the shortest parity sketch; members compared in one block; members a task compares with their leader at once.
SKETCH = 512
BLOCK = 1024
MEMBERS = 512
#: Bits of the filter that tells which documents' sets are needed.
NEEDED_BITS = 1 << 23

_MIX = list(np.random.default_rng(99).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1))


@dataclass(frozen=True)
class Rule:
    """Shingles of ``k`` words; alike from a Jaccard similarity of num / den on."""

    k: int = 5
    num: int = 8
    den: int = 10

    def __post_init__(self):
        if not 4 * self.num >= 3 * self.den > 0 or self.num > self.den:
            raise ValueError("the similarity must lie between 3/4 and 1")

    def lacking(self, n: int) -> int:
        """How many of its n shingles a set can hold that an alike set lacks."""
        return n - -(-self.num * n // self.den)

    def differing(self, n: int) -> int:
        """How many shingles at most one of two alike sets can hold, if one has n."""
        return (n + self.den * n // self.num) * (self.den - self.num) // (self.den + self.num)


@dataclass(frozen=True)
class Classes:
    """The bits of the frequent shingles and the commonness of words by slot, as bytes of fixed size."""

    frequent: bytes
    common: bytes

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        return np.unpackbits(np.frombuffer(self.frequent, np.uint8)).astype(bool), np.frombuffer(self.common, np.uint8)


def shingles(data: np.ndarray, offsets: np.ndarray, k: int, common: np.ndarray | None = None):
    """The sorted distinct shingles of each text, and how common the words of each are together (0 without a table)."""
    data = T.LOWER[data]
    starts, ends, first = T.spans(data, offsets, T.NOT_SPACE)
    h = T.word_hashes(data, starts, ends)
    n = max(0, len(h) - k + 1)
    made, score = np.zeros(n, np.uint64), np.zeros(n, np.uint16)
    own = common[(h & np.uint64(WORD_SLOTS - 1)).astype(np.int64)] if common is not None else None
    for j in range(k if n else 0):
        made += h[j : j + n] * _MIX[j]
        if own is not None:
            score += own[j : j + n]
    made = T.mix(made)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k and own is not None:
            tokens, at = np.unique(made[a : b - k + 1], return_index=True)
            yield tokens, score[a + at]
        elif b - a >= k:
            tokens = np.unique(made[a : b - k + 1])
            yield tokens, np.zeros(len(tokens), np.uint16)
        elif b > a:
            short = (h[a:b] * np.array(_MIX[: b - a])).sum(dtype=np.uint64) + np.uint64(b - a)
            yield T.mix(np.array([short], np.uint64)), np.zeros(1, np.uint16)
        else:
            yield made[:0], score[:0]


def classes(docs: DataFrame, rule: Rule, scratch: Scratch) -> Classes:
    """Shingles that recur within slices of the input, counted over all of it, and the words of all documents by slot."""

    def run(batches):
        words = np.zeros(WORD_SLOTS, np.int64)
        for batch in batches:
            for _, _, data, offsets in T.slices(batch.column(0), 2 * T.SLICE):
                low = T.LOWER[data]
                starts, ends, _ = T.spans(low, offsets, T.NOT_SPACE)
                words += np.bincount((T.word_hashes(low, starts, ends) & np.uint64(WORD_SLOTS - 1)).astype(np.int64), minlength=WORD_SLOTS)
                found, n = np.unique(np.concatenate([t for t, _ in shingles(data, offsets, rule.k)] or [np.zeros(0, np.uint64)]), return_counts=True)
                keep = n >= SLICE_LEAST
                yield pa.record_batch([pa.array(np.zeros(int(keep.sum()), bool)), pa.array(found[keep].view(np.int64)), pa.array(n[keep])], names=["word", "token", "n"])
        held = np.flatnonzero(words)
        yield pa.record_batch([pa.array(np.ones(len(held), bool)), pa.array(held), pa.array(words[held])], names=["word", "token", "n"])

    found = scratch.stage(T.over_batches(docs.select("text"), run, "word boolean, token long, n long").groupBy("word", "token").agg(F.sum("n").alias("n")), "shingle-classes")
    most = found.filter((F.col("n") >= FREQUENT) & ~F.col("word")).orderBy(F.desc("n"), "token").limit(CLASS_MOST).select("token").toPandas()["token"].to_numpy(np.int64)
    bits = np.zeros(CLASS_BITS, bool)
    bits[(most.view(np.uint64) & np.uint64(CLASS_BITS - 1)).astype(np.int64)] = True
    slots = found.filter("word").select("token", "n").toPandas()
    common = np.zeros(WORD_SLOTS, np.uint8)
    common[slots["token"].to_numpy(np.int64)] = np.log2(slots["n"].to_numpy(np.float64) + 1).astype(np.uint8)
    scratch.drop(found)
    return Classes(np.packbits(bits).tobytes(), common.tobytes())


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Parity of the number of shingles at each place: sketches differ in at most as many bits as the sets do in shingles.

    It has two bits a shingle or more, a power of two; its halves combine to the sketch of half the size.
    """
    bits = SKETCH
    while bits < 2 * len(tokens):
        bits *= 2
    at = (tokens >> np.uint64(32)) & np.uint64(bits - 1)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=bits) & 1).view(np.int64)


def keys_of(tokens: np.ndarray, score: np.ndarray, frequent: np.ndarray, rule: Rule) -> np.ndarray:
    """The keys a set is indexed under, from its sorted shingles."""
    n, order = len(tokens), np.argsort(score, kind="stable")
    tokens = tokens[order]
    often = frequent[tokens & np.uint64(CLASS_BITS - 1)]
    rare, many = tokens[~often], tokens[often]
    prefix = rule.lacking(n) + 1
    if len(rare) >= prefix:
        return rare[:prefix]
    longer = many[: max(0, rule.differing(n) + 2 + rule.lacking(n) - len(rare))]
    pairs = T.mix(longer[:-1] * _MIX[62] + longer[1:] * _MIX[63])
    return np.concatenate([rare, pairs])


def index(docs: DataFrame, rule: Rule, known: Classes) -> DataFrame:
    """doc_id, n, whole (hash of the set), sketch and keys of every document."""
    schema = "doc_id long, n long, whole long, sketch array<long>, keys array<long>"

    def work():
        frequent, common = known.tables()

        def step(data, offsets):
            n, whole, sketches, keys, sizes = [], [], [], [], [0]
            for tokens, score in shingles(data, offsets, rule.k, common):
                n.append(len(tokens))
                whole.append(int(T.mix(np.array([tokens.sum(dtype=np.uint64) + np.uint64(len(tokens))], np.uint64)).view(np.int64)[0]))
                sketches.append(sketch(tokens))
                keys.append(keys_of(tokens, score, frequent, rule) if len(tokens) else tokens)
                sizes.append(sizes[-1] + len(keys[-1]))
            values = np.concatenate(keys).view(np.int64)
            return [np.array(n, np.int64), np.array(whole, np.int64), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in sketches])]), pa.int32()), pa.array(np.concatenate(sketches))), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(values))]

        return step

    return T.per_text(docs, ["doc_id", "text"], schema, work)


def _needed(ids: DataFrame) -> bytes:
    """A filter of fixed size over document ids."""
    slot = F.pmod(F.xxhash64("id"), F.lit(NEEDED_BITS))
    found = ids.select(slot.alias("slot")).groupBy(F.shiftright("slot", 5).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 32 as int))")).alias("bits"))
    rows = found.toPandas()  # NEEDED_BITS / 32 rows at most
    words = np.zeros(NEEDED_BITS // 32, np.uint32)
    words[rows["at"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).astype(np.uint32)
    return words.tobytes()


def verified(pairs: DataFrame, docs: DataFrame, rule: Rule, scratch: Scratch) -> DataFrame:
    """The pairs a, b (ids of documents) whose whole sets are alike, recomputed from the texts."""
    schema = "id long, tokens array<long>"
    sizes = pairs.groupBy("a").count()
    asked = (
        pairs.join(sizes, "a").select("a", F.col("b").alias("id"), F.pmod(F.xxhash64("b"), F.ceil(F.col("count") / MEMBERS)).alias("part"))
        .union(sizes.select("a", "a", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("count") / MEMBERS) - 1))))
    )
    asked = scratch.stage(asked, "asked")
    bits = _needed(asked.select("id").distinct())
    near = docs.select("doc_id", "text").withColumn("slot", F.pmod(F.xxhash64("doc_id"), F.lit(NEEDED_BITS)))

    def wanted(batches):
        words = np.frombuffer(bits, np.uint32)
        for batch in batches:
            slot = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((words[slot >> 5] >> (slot & 31).astype(np.uint32)) & 1 == 1))
            for lo, hi, data, offsets in T.slices(batch.column(1)):
                made = [t for t, _ in shingles(data, offsets, rule.k)]
                at = np.concatenate([[0], np.cumsum([len(x) for x in made])])
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(made).view(np.int64)))
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), lists], names=["id", "tokens"])

    sets = T.over_batches(near.filter("doc_id is not null"), wanted, schema)
    met = asked.join(sets, "id").repartition("a", "part").sortWithinPartitions("a", "part", F.col("id") != F.col("a"))

    def compare(batches):
        group, leader = None, None
        for batch in batches:
            a, part, ids = (batch.column(i).to_numpy() for i in range(3))
            tokens = batch.column(3)
            at, values = tokens.offsets.to_numpy(), tokens.values.to_numpy()
            out = []
            for i in range(len(a)):
                own = values[at[i] : at[i + 1]]
                if (a[i], part[i]) != group:
                    group, leader = (a[i], part[i]), np.array(own)
                elif ids[i] != a[i]:
                    both = len(np.intersect1d(leader, own, assume_unique=True))
                    if both * rule.den >= rule.num * (len(leader) + len(own) - both):
                        out.append((int(a[i]), int(ids[i])))
            yield pa.record_batch([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    return T.over_batches(met.select("a", "part", "id", "tokens"), compare, "a long, b long").distinct()


def possible(rule: Rule) -> Column:
    """Whether sizes and sketches of two sets (n_a, n_b, sketch_a, sketch_b) allow them to be alike."""
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    halved = lambda c: F.zip_with(F.slice(c, F.lit(1), (F.size(c) / 2).cast("int")), F.slice(c, (F.size(c) / 2 + 1).cast("int"), (F.size(c) / 2).cast("int")), lambda x, y: x.bitwiseXOR(y))
    a, b = (F.when(F.size(x) > F.size(y), halved(x)).otherwise(F.col(x)) for x, y in (("sketch_a", "sketch_b"), ("sketch_b", "sketch_a")))
    apart = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return (small * rule.den >= large * rule.num) & (apart * (rule.den + rule.num) <= (F.col("n_a") + F.col("n_b")) * (rule.den - rule.num))


def block_pairs(members: DataFrame, rule: Rule) -> DataFrame:
    """Pairs of members of one key that are of different components and whose sketches allow them to be alike.

    members: key, id, component, n, sketch. A key of many members is cut into blocks by a hash, and every two blocks meet in
    a group of their own, so a group has 2 * BLOCK members on average at most.
    """
    counts = members.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    own = members.join(counts, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = own.withColumn("with", other).select(
        "key", F.least("block", "with").alias("p"), F.greatest("block", "with").alias("q"), "block", "id", "component", "n", "sketch"
    )
    dealt = dealt.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "n")

    def pairs(rows):
        ids, comp, n, block, sk, p, q = rows
        # By size, sketches of one length stand together; those of the next length are halved to meet them.
        lengths = np.array([len(x) for x in sk])
        tables, halves, spans = {}, {}, {}
        for size in np.unique(lengths).tolist():
            lo, hi = np.searchsorted(lengths, [size, size + 1]).tolist()
            table = np.stack(sk[lo:hi])
            tables[size], spans[size] = table, (lo, hi)
            halves[size // 2] = table[:, : size // 2] ^ table[:, size // 2 :]
        found = []
        for i in range(len(ids) - 1):
            hi = int(np.searchsorted(n, rule.den * int(n[i]) // rule.num, "right"))
            if hi <= i + 1:
                continue
            ok = comp[i + 1 : hi] != comp[i]
            if p != q:
                ok &= block[i + 1 : hi] != block[i]
            j = np.flatnonzero(ok) + i + 1
            if len(j):
                most = (n[j] + n[i]) * (rule.den - rule.num) // (rule.den + rule.num)
                size = len(sk[i])
                lo, end = spans[size]
                same = tables[size][j[j < end] - lo] ^ sk[i]
                longer = halves[size][j[j >= end] - end] ^ sk[i] if j[-1] >= end else same[:0]
                j = j[np.bitwise_count(np.concatenate([same, longer])).sum(1) <= most]
                found.append(np.stack([np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])]))
        return np.concatenate(found, 1) if found else np.zeros((2, 0), np.int64)

    def run(batches):
        held, group = [], None

        def done():
            rows = [np.concatenate([x[i] for x in held]) for i in range(4)]
            made = pairs((*rows, [s for x in held for s in x[4]], group[1], group[2]))
            return pa.record_batch([pa.array(made[0]), pa.array(made[1])], names=["a", "b"])

        for batch in batches:
            key, p, q, block, ids, comp, n = (batch.column(i).to_numpy() for i in range(7))
            lists = batch.column(7)
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
            sk = [values[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            cut = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])]))
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(key)], strict=True):
                now = (key[a], p[a], q[a])
                if held and now != group:
                    yield done()
                    held = []
                group = now
                held.append((ids[a:b], comp[a:b], n[a:b], block[a:b], sk[a:b]))
        if held:
            yield done()

    return T.over_batches(dealt.select("key", "p", "q", "block", "id", "component", "n", "sketch"), run, "a long, b long").distinct()


def join(docs: DataFrame, rule: Rule, count: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id and, with ``count``, n_links (other rows with an id and an alike set) of every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scratch = Scratch()
    stage = scratch.stage
    whole = stage(index(docs, rule, classes(docs, rule, scratch)), "shingle-index")
    made = stage(whole.select("doc_id", "n", "whole"), "shingle-sets")
    known = whole.filter("n > 0 and doc_id is not null")
    nodes = stage(known.groupBy("whole", "n").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies")), "shingle-nodes")
    alone = nodes.select(F.col("id").alias("doc_id"), "whole", "n")
    first = stage(known.join(alone, ["doc_id", "whole", "n"], "left_semi").select("doc_id", "n", "sketch", "keys"), "shingle-first")
    scratch.drop(whole)
    keyed = first.select(F.explode("keys").alias("key"), F.col("doc_id").alias("id"))
    leaders = keyed.groupBy("key").agg(F.min("id").alias("leader"), F.count("*").alias("members")).filter("members > 1")
    shared = stage(keyed.join(leaders, "key"), "shingle-keys")
    sizes = first.select(F.col("doc_id").alias("id"), "n", "sketch").dropDuplicates(["id"])

    def sized(pairs):
        a, b = (sizes.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}")) for x in "ab")
        return pairs.join(a, "a").join(b, "b").filter(possible(rule)).select("a", "b")

    stars = stage(sized(shared.filter("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()), "shingle-stars")
    links = stage(verified(stars, docs, rule, scratch), "shingle-links")
    reached = components(links, scratch)

    label = F.coalesce("component", "id").alias("component")
    placed = shared.filter("members > 2").join(reached.withColumnRenamed("node", "id"), "id", "left").select("key", "id", label)
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("key")
    rest = stage(placed.join(mixed, "key").join(sizes, "id").select("key", "id", "component", "n", "sketch"), "shingle-rest")
    if not count:
        scratch.drop(shared)
    more = stage(block_pairs(rest, rule).join(stars, ["a", "b"], "left_anti"), "shingle-more")
    scratch.drop(rest)
    links = stage(links.union(verified(more, docs, rule, scratch)), "shingle-all")
    reached = components(links, scratch)

    grouped = nodes.join(reached.withColumnRenamed("node", "id"), "id", "left").select("id", "whole", "n", "copies", F.coalesce("component", "id").alias("component"))
    if count:
        # Every other pair that shares a key (of two members, one is the leader): as components of their own, members of one component meet too.
        every = stage(shared.filter("members > 2").join(sizes, "id").select("key", "id", F.col("id").alias("component"), "n", "sketch"), "shingle-every")
        scratch.drop(shared)
        inner = stage(block_pairs(every, rule).join(stars.union(more), ["a", "b"], "left_anti"), "shingle-inner")
        scratch.drop(every)
        links = stage(links.union(verified(inner, docs, rule, scratch)), "shingle-counted")
        ends = links.select(F.col("a").alias("id"), F.col("b").alias("to")).union(links.select("b", "a"))
        degree = ends.join(nodes.select(F.col("id").alias("to"), "copies"), "to").groupBy("id").agg(F.sum("copies").alias("alike"))
        grouped = grouped.join(degree, "id", "left").withColumn("alike", F.coalesce("alike", F.lit(0)) + F.col("copies"))
    out = made.select("doc_id", "n", "whole").join(grouped, ["whole", "n"], "left")
    own = F.when(F.col("n") > 0, F.least("component", "doc_id")).otherwise(F.col("doc_id"))
    found = [F.col("doc_id"), F.col("n").alias("n_shingles"), own.alias("component_id")]
    if count:
        found.append(F.coalesce(F.col("alike") - F.col("doc_id").isNotNull().cast("long"), F.lit(0)).cast("long").alias("n_links"))
    return scratch.keep(out.select(*found), "shingle-join")


def distinct_documents(docs: DataFrame, rule: Rule | None = None) -> DataFrame:
    """The documents without their near duplicates: of each group the smallest doc_id stays, as one row; null ids stay."""
    own = join(docs, rule or Rule(), count=False).filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("first"), F.count("*").alias("rows"))
    # Written first, so that their sizes are known when the joins are planned. Whole texts are only sorted for ids with several rows.
    far = stage(own.filter(~F.col("first")).select(F.col("doc_id").alias("_id")), "near-duplicates")
    again = stage(own.filter(F.col("first") & (F.col("rows") > 1)).select(F.col("doc_id").alias("_id")), "repeated")
    rows, same = docs.join(far, F.col("doc_id") == F.col("_id"), "left_anti"), F.col("doc_id") == F.col("_id")
    return rows.join(again, same, "left_anti").unionByName(rows.join(again, same, "left_semi").dropDuplicates(["doc_id"]))
