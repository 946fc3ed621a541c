"""What lets queries grow: work dealt over all cores, texts read once, plans that stay small."""

import pytest
from pyspark.sql import functions as F

from crossweave.operators import lints, matching
from crossweave.plans import table_queries
from crossweave.plans.registry import Tables
from crossweave.sources.patch import versions_of_patches


def test_constants_of_one_split_go_to_all_cores(spark, tmp_path):
    rows = [(k, k % 50) for k in range(1, 41)]
    spark.createDataFrame(rows, "p_partkey long, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    found = table_queries.constant_values(Tables(spark, str(tmp_path)))
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    want = {k: (((1 << size % 8) | 16) & ~3) ^ ((k + 2) * 3 << 1) for k, size in rows}
    assert {r.p_partkey: int(r.value) for r in found.collect()} == want


PATCH = """Subject: x
diff --git a/k/fan.cc b/k/fan.cc
index 1111111..2222222 100644
--- a/k/fan.cc
+++ b/k/fan.cc
@@ -3,2 +3,1 @@
 int a;
-int b;
diff --git a/k/fan.rs b/k/fan.rs
new file mode 100644
--- /dev/null
+++ b/k/fan.rs
@@ -0,0 +1,2 @@
+fn a() {
+}
"""


def test_patches_are_parsed_once(spark):
    versions = versions_of_patches(spark.createDataFrame([("c", PATCH), ("none", None)], "change_id string, text string"))
    assert versions._jdf.queryExecution().optimizedPlan().toString().count("MapIn") == 1
    found = {(r.side, r.path): (r.text, r.changed) for r in versions.collect()}
    assert found == {
        ("cpp_old", "k/fan.cc"): ("\n\nint a;\nint b;\n", [4]),
        ("cpp_new", "k/fan.cc"): ("\n\nint a;\n", []),
        ("rust_new", "k/fan.rs"): ("fn a() {\n}\n", [1, 2]),
    }


@pytest.mark.parametrize("threshold", [0.25, 0.5, 0.8])
def test_similar_sets_of_rows_that_share_an_id(spark, threshold):
    left = [(0, list("ab")), (1, list("abcdef")), (2, [])]
    right = [(1, list("ab")), (1, list("cdefgh")), (2, list("abcdxyz")), (3, None), (None, list("ab"))]
    share = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y))
    want = sorted((i, j, round(share(x, y), 6)) for i, x in left for j, y in right if j is not None and x and y and share(x, y) >= threshold)
    a, b = spark.createDataFrame(left, "i int, s array<string>"), spark.createDataFrame(right, "j int, s array<string>")
    found = matching.similar_sets(a, b, ["i"], ["j"], "s", "s", threshold)
    assert sorted((r.l_i, r.r_j, r.j) for r in found.select("l_i", "r_j", F.round("jaccard", 6).alias("j")).collect()) == want


def test_plan_of_inlined_helpers_stays_small(report, monkeypatch):
    """Every test of the helpers once doubled the plan of what came before it."""
    from crossweave.operators import structure

    joins, whole = {}, structure.stage

    def staged(df, label):
        joins[label] = max(joins.get(label, 0), df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return whole(df, label)

    monkeypatch.setattr(structure, "stage", staged)
    ctx = report.pairs.withColumn("r_ids", F.array().cast("array<string>"))
    structure.structure_checks(ctx, report.rows, report.inputs)
    assert max(joins.values()) < 30


def test_lints_cut_texts_into_lines_once(spark, monkeypatch):
    cut, got = [], []
    empty = spark.createDataFrame([], "change_id string, kind string")
    monkeypatch.setattr(lints, "rust_lines", lambda inp: cut.append(inp) or spark.createDataFrame([("c", 0, "x.rs", 1, "// a", True)], "change_id string, file_ix int, path string, line int, raw string, touched boolean"))
    for rule in ("provenance_comments", "undocumented_unsafe", "invented_lifetimes", "mangled_symbols"):
        monkeypatch.setattr(lints, rule, lambda inp, lines: got.append(lines) or empty)
    for rule in ("extern_signatures", "shim_logic", "dense_unsafe"):
        monkeypatch.setattr(lints, rule, lambda inp: empty)
    assert lints.all_lints("inputs").count() == 0
    assert cut == ["inputs"] and len(got) == 4 and all(lines is got[0] for lines in got)
    assert len(got[0].inputFiles()) >= 1 and [r.raw for r in got[0].collect()] == ["// a"]  # written, not cut again by each reader
