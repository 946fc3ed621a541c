"""Operators against brute force on small fixtures, and properties that must hold."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from crossweave.functions import seqs
from crossweave.functions.values import evaluate, literal
from crossweave.operators import hierarchy, matching
from crossweave.operators.align import align_units, lcs_share, unit_similarity
from crossweave.operators.demangle import readable
from crossweave.operators.runs import Ordered
from crossweave.operators.scan import scan_text
from crossweave.sources.patch import fill_gaps, patch_rows


def test_integer_literals_of_both_languages():
    values = {
        "7": 7, "1_000": 1000, "0x1F": 31, "0XfF": 255, "0b101": 5, "010": 10,
        "7u": 7, "7UL": 7, "0xFFull": 255, "8z": 8, "10u32": 10, "0xFFu8": 255, "3usize": 3, "5_i64": 5, "0x1_0_u64": 16,
    }
    for text, value in values.items():
        assert literal(text) == value and evaluate(text, {}) == value, text
    for text in ("0x", "12ab", "0b12", "u32", "_", "1.5", "7u33"):
        assert literal(text) is None, text
    assert evaluate("(10u32 << 2) | BIT(0) as u64", {}) == 41 and evaluate("a :: kB + 1", {"B": 2}) == 3


def sequential_greedy(edges):
    used_l, used_r, out = set(), set(), []
    for e in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        if e[0] not in used_l and e[1] not in used_r:
            used_l.add(e[0])
            used_r.add(e[1])
            out.append(e)
    return sorted(out)


def test_greedy_equals_sequential(spark):
    rnd = random.Random(7)
    edges = list({(rnd.randrange(30), rnd.randrange(30)): rnd.randrange(12) for _ in range(300)}.items())
    edges = [(l, r, float(s)) for (l, r), s in edges]
    # A third of all edges touch one end.
    edges += [(99, r, 5.5) for r in range(30)]
    df = spark.createDataFrame(edges, "l int, r int, s double")
    got = matching.greedy_one_to_one(df, ["l"], ["r"], [-F.col("s"), F.col("l"), F.col("r")]).collect()
    assert sorted(tuple(r) for r in got) == sequential_greedy(edges)


def test_similar_sets_equals_brute_force(spark):
    rnd = random.Random(3)
    mk = lambda n: [(i, sorted({rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(1, 7))})) for i in range(n)]
    a, b = mk(40), mk(40)
    da, db = spark.createDataFrame(a, "i int, s array<string>"), spark.createDataFrame(b, "j int, s array<string>")
    for t in (0.3, 0.5, 0.8):
        got = {(r.l_i, r.r_j) for r in matching.similar_sets(da, db, ["i"], ["j"], "s", "s", t).collect()}
        want = {(i, j) for i, x in a for j, y in b if len(set(x) & set(y)) / len(set(x) | set(y)) >= t - 1e-9}
        assert got == want


def test_split_sequences_equal_plain_ones(spark):
    rnd = random.Random(5)
    # One key has most of the rows.
    rows = [("hot" if rnd.random() < 0.7 else f"k{rnd.randrange(4)}", i, rnd.choice("aab"), float(rnd.randrange(9))) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, i int, v string, x double")
    def run(seq):
        out = seq.previous("v", "p").running_sum(F.lit(1), "n").running_last(F.when(F.col("v") == "b", F.col("i")), "l").max_before("x", "m").frame(2, 2, F.sum("x"), "f").runs_of_equal("v")
        return sorted((r.k, r.i, r.p, r.n, r.l, r.m, r.f, r.island) for r in out.df.collect())
    assert run(Ordered(df, ["k"], ["i"])) == run(Ordered.split(df, ["k"], ["i"], chunk_rows=7))


def test_best_targets_reports_ties(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 3), ("b", "y", 3)], "g string, t string, s int")
    got = sorted((r.g, r.t, r.ties) for r in matching.best_targets(df, ["g"], F.col("s")).collect())
    assert got == [("a", "y", 1), ("b", "x", 2), ("b", "y", 2)]


def test_column_lcs_equals_python(spark):
    rnd = random.Random(1)
    rows = [("".join(rnd.choice("abc") for _ in range(rnd.randrange(7))), "".join(rnd.choice("abc") for _ in range(rnd.randrange(7)))) for _ in range(60)]
    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", seqs.seq_similarity(F.filter(F.split("a", ""), lambda c: c != ""), F.filter(F.split("b", ""), lambda c: c != "")).alias("s"))
    for r in df.collect():
        assert abs(r.s - lcs_share(list(r.a), list(r.b))) < 1e-12


def unit(kind="stmt", calls=(), names=(), depth=0, **more):
    base = dict(kind=kind, depth=depth, calls=list(calls), idents=[], names=sorted({*names, *calls}), errors=[], locks=[], comment=[], propagates=False, checks_error=False, safety=False, lock_plumbing=False, ret=None)
    return {**base, **more}


units = st.lists(st.builds(lambda k, c: unit(k, [c]), st.sampled_from(["stmt", "if", "return", "loop", "else"]), st.sampled_from(["a", "b_c", "b_d", "e"])), max_size=7)


@settings(max_examples=60, deadline=None)
@given(units, units)
def test_alignment_is_whole_and_in_order(a, b):
    rows = align_units(a, b)
    assert sorted(c for c, _, _ in rows if c is not None) == list(range(len(a)))
    assert sorted(r for _, r, _ in rows if r is not None) == list(range(len(b)))
    both = [(c, r) for c, r, _ in rows if c is not None and r is not None]
    assert both == sorted(both) and all(x[1] < y[1] for x, y in zip(both, both[1:]))


@settings(max_examples=60, deadline=None)
@given(units, units)
def test_unit_similarity_is_symmetric(a, b):
    for x in a:
        for y in b:
            assert abs(unit_similarity(x, y) - unit_similarity(y, x)) < 1e-12


def test_cfg_units_never_pair_by_position():
    rows = align_units([unit("cfg", idents=["x"])], [unit("if", idents=["y"])])
    assert [(c, r) for c, r, _ in rows] == [(0, None), (None, 0)]


def test_constant_expressions():
    names = {"FOO": 5}
    assert evaluate("(BIT(3) | 0x10) + FOO as u64", names) == 29
    assert evaluate("1 << 3 + 1", names) == 16
    assert evaluate("~0", names) == (1 << 64) - 1
    assert evaluate("u64::from(FOO) * 2", names) == 10
    assert evaluate("1 << 64", names) is None and evaluate("BAR", names) is None and evaluate("f(1)", names) is None


def test_demangling():
    assert readable("_ZN4Lamp4DrawEi") == "Lamp::Draw(int)"
    assert readable("_ZNK3Foo3BarEPKc") == "Foo::Bar(char const*) const"
    assert readable("_ZStrange") == "_ZStrange"


def test_patch_counts_decide_what_is_a_hunk():
    text = "diff --git a/x.cc b/x.cc\nindex 12..34\n--- a/x.cc\n+++ b/x.cc\n@@ -3,2 +3,1 @@\n--- gone\n keep\n@@ -9,0 +9,1 @@\n+++ fresh\n"
    got = [(s, n, t, hit) for _, _, s, n, t, hit in patch_rows(text)]
    assert got == [("old", 3, "-- gone", True), ("old", 4, "keep", False), ("new", 3, "keep", False), ("new", 9, "++ fresh", True)]


def test_gaps_balance_braces():
    lines = ["", "", "        a();", "    }", ""]
    fixed = fill_gaps(lines, {3, 4})
    text = "\n".join(fixed)
    assert text.count("{") >= 2 and "fn " in fixed[0]


def test_scanner_survives_broken_code():
    for text in ("void f( {", "fn f() { if x {", "}}}}", 'fn f() { "unterminated }', "class X { void f() { } "):
        for lang in ("cpp", "rust"):
            scan_text(lang, text)


def test_scan_finds_functions():
    s = scan_text("cpp", "namespace a { int B::f(int x) { if (x) return 1; else return 2; } }")
    assert [f["name"] for f in s.functions] == ["B::f"]
    assert [p[2] for p in s.pieces] == ["signature", "head", "stmt", "head", "stmt"]


def test_aliases_end_or_go_in_circles(spark):
    from crossweave.operators.constants import follow_aliases

    rows = [(f"A{i}", f"A{i + 1}") for i in range(12)] + [("X", "Y"), ("Y", "Z"), ("Z", "X"), ("W", "X"), ("S", "S")]
    got = {r["name"]: (r["canonical"], r["hops"]) for r in follow_aliases(spark.createDataFrame(rows, "name string, target string"), [], "name", "target").collect()}
    assert got == {**{f"A{i}": ("A12", 12 - i) for i in range(12)}, "X": ("Y", 1), "Y": ("Z", 1), "Z": ("X", 1), "W": ("X", 1), "S": ("S", 1)}


def test_generics_of_any_depth(spark):
    from pyspark.sql import functions as F

    from crossweave.functions.idents import strip_generics

    texts = ["a<b>::c", "a<b<c<d<e<f<g>>>>>>::h", "plain", "a<b", "a::<X<Y>>(z)", "x->y", "a<b>c<d>e", ""]
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select(strip_generics(F.col("t"))).collect()
    assert [r[0] for r in rows] == ["a::c", "a::h", "plain", "a", "a::(z)", "x->y", "ace", ""]


def test_ancestors_by_doubling(spark):
    rng = random.Random(11)
    edges = [(i, i + 1) for i in range(70)] + [(100, 101), (101, 102), (102, 100), (103, 100), (5, 5)]  # a chain, a circle, itself
    edges += [(200 + i, 200 + rng.randrange(40)) for i in range(40) for _ in range(2)]
    want, out = set(), {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    for start in out:
        near, seen, d = {start}, {start}, 0
        while near:
            d += 1
            near = {y for x in near for y in out.get(x, ())} - seen
            seen |= near
            want |= {(start, y, d) for y in near}
    got = hierarchy.ancestors(spark.createDataFrame(edges, "a int, b int"), [], "a", "b").select("cls", "ancestor", "distance").collect()
    assert sorted(tuple(r) for r in got) == sorted(want)
