"""What a review costs: names read once, files scanned few at a time, rows written seldom."""

import threading
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from crossweave import session
from crossweave.functions import idents, text
from crossweave.operators import checks, scan, units


def test_long_names_are_read_in_linear_time(spark):
    long = "a" * 60_000
    rows = [(long,), (f"{long}(x) ~b(3c(a~d(9",), ("T::get(y) + k::<V>::new(z); foo_bar!{",)]
    began = time.time()
    found = spark.createDataFrame(rows, "t string").select(text.extract_all(F.col("t"), units.CALL, 1).alias("c")).collect()
    assert [r.c for r in found] == [[], [long, "~b", "c", "~d"], ["T::get", "k::<V>::new", "foo_bar"]]
    assert time.time() - began < 15


NAMES = {"": "", "a": "a", "a_b2": "a_b2", "a__b": "a_b", "_a_": "a", "CommitRange": "commit_range", "r#type": "type", "x\n": "x", "HTTPServer": "http_server", "é_É": "é_É"}


def test_names_spelled_as_wanted_stay(spark):
    got = spark.createDataFrame([(n,) for n in NAMES], "n string").select("n", idents.ident(F.col("n")).alias("i")).collect()
    assert {r.n: r.i for r in got} == NAMES


@pytest.mark.parametrize("call, name", [("foo_raw_mut", "foo"), ("foo_mut_raw", "foo_mut"), ("_mut", "mut"), ("arch_x86_go", "go"), ("x86_arch_go", "arch_go"), ("a_unchecked_raw_mut", "a"), ("arch_", "arch")])
def test_endings_and_beginnings_of_calls_go_once(spark, call, name):
    assert spark.range(1).select(idents.call(F.lit(call)).alias("c")).first().c == name


def test_files_of_a_batch_are_scanned_few_at_a_time():
    n = 3 * scan.AT_ONCE + 1
    rows = {"change_id": [str(i) for i in range(n)], "file_ix": pa.array([0] * n, pa.int32()), "side": ["cpp_old"] * n, "lang": ["cpp"] * n, "path": ["x.cc"] * n, "text": ["int f(int a) {\n  return a;\n}\n"] * (n - 1) + [None]}
    out = list(scan._scan_batches(iter([pa.record_batch(rows)])))
    assert [b.num_rows for b in out] == [scan.AT_ONCE] * 3 + [1]
    files = pa.Table.from_batches(out).to_pylist()
    assert files[0]["pieces"][1] == {"fn": 0, "seq": 1, "piece": "stmt", "start_line": 2, "end_line": 2, "depth": 0, "tail": False, "text": "return a;"}
    assert files[0]["functions"][0]["unsafe_at"] == [] and files[-1]["functions"] == [] == files[-1]["pieces"]


def test_rows_of_pairs_are_written_seldom(report, monkeypatch):
    """Rows hold both units; every rule once wrote them anew."""
    wide, whole = [], checks.stage

    def staged(df, label):
        if {"cu", "ru"} <= set(df.columns):
            wide.append(label)
        return whole(df, label)

    monkeypatch.setattr(checks, "stage", staged)
    pairs = report.pairs.filter("origin = 'changed'").select("change_id", "c_fid", "r_fid", "link", "why", "shim", "forwarder", "duplicate_of", "origin", "rust_untouched")
    _, rows = checks.checked_rows(pairs, report.inputs.cpp, report.inputs.universe, report.inputs)
    assert len(wide) <= 3
    assert not set(checks.ROW_ONLY) & set(rows.columns)
    key = [*checks.PAIR, "row_ix", "at_side"]
    assert sorted(map(tuple, rows.select(*key).collect())) == sorted(map(tuple, report.rows.join(pairs.select("change_id", F.concat_ws(">", "c_fid", "r_fid").alias("pair_id")), checks.PAIR, "left_semi").select(*key).collect()))


def test_work_beside_a_block_runs_while_the_block_does(spark):
    met = threading.Barrier(2, timeout=20)
    with session.beside(spark, lambda: met.wait() + 1) as work:
        met.wait()
    assert work.result() in (1, 2)
    with pytest.raises(ZeroDivisionError), session.beside(spark, lambda: 1 // 0) as work:
        work.result()


def test_tests_of_conditions_are_compared_once(spark):
    """Every note on conditions once compared all conjuncts of both sides anew."""
    notes = checks._conditions(F.col("cu"), F.col("ru"), F.col("_tests"))
    assert len(notes) == 3 and not any("jaccard" in str(n) or "==|!=" in str(n) for n in notes)
    test = "array<struct<text:string,names:array<string>>>"
    unit = f"struct<kind:string,checks_error:boolean,conjuncts:{test}>"
    amount, closed, less = ("a > LIMIT", ["a", "limit"]), ("!closed", ["closed"]), ("a <= kLimit", ["a", "limit"])
    branch = lambda *tests, kind="if", checks=False: (kind, checks, list(tests))
    rows = [
        (0, branch(amount), branch(amount, closed), [amount], [amount, closed]), (1, branch(amount), branch(less), [amount], [less]),
        (2, branch(amount, checks=True), branch(closed), [], []), (3, branch(kind="stmt"), branch(closed), [], []), (4, None, branch(closed), None, []),
        (5, branch(("x", [])), branch(closed), [], []),
    ]
    x = spark.createDataFrame(rows, f"k int, cu {unit}, ru {unit}, near_c {test}, near_r {test}").withColumn("_tests", checks._lost_tests(F.col("cu"), F.col("ru")))
    got = {r.k: (r.lost and tuple(r.lost), [n and n.code for n in r.notes]) for r in x.select("k", F.col("_tests").alias("lost"), F.array(*notes).alias("notes")).collect()}
    none = (None, [None] * 3)
    assert got == {0: (([], ["!closed"]), [None, "test-added", None]), 1: ((["a > LIMIT"], ["a <= kLimit"]), ["condition", None, None]), 2: none, 3: none, 4: none, 5: none}


def test_types_are_only_looked_for_in_bindings(spark):
    """The pattern looks back from every position of a text; errors are named with a prefix."""
    assert spark.createDataFrame([("foo(ZX_ERR_NO_MEMORY, Status::BAD)",), ("x.ok()",), (None,)], "t string").select(text.error_codes(F.col("t")).alias("e")).collect() == [(["NO_MEMORY", "BAD"],), ([],), (None,)]
    schema = "change_id string, side string, file_ix int, lang string, fn int, seq int, kind string, text string, comment array<string>, safety boolean"
    texts = ["call(first: T, second = 3);", "let total: Vec<Item> = make();", "let mut (aa, bb): Pair = both();"]
    features = units._features(spark.createDataFrame([("c", "rust_new", 0, "rust", 0, k, "stmt", t, [], False) for k, t in enumerate(texts)], schema))
    assert "StartsWith(" in features._jdf.queryExecution().optimizedPlan().toString()
    assert [r.names for r in features.orderBy("seq").select("names").collect()] == [["call", "first", "second"], ["make", "total"], ["aa", "bb", "both", "pair"]]
