"""Planted differences: exact lists of issues, so that false ones fail too."""

from pyspark.sql import functions as F


def issues(report, change):
    rows = report.findings.filter((F.col("change_id") == change) & (F.col("severity") == "issue")).orderBy("c_path", "c_line", "r_line").collect()
    return [(r.category, r.message) for r in rows]


def pairs(report, change):
    return {(r.c_name, r.r_name): r for r in report.pairs.filter(F.col("change_id") == change).collect()}


def test_faithful_port_has_no_issue(report):
    assert issues(report, "faithful") == []
    assert len(pairs(report, "faithful")) == 4


def test_planted_differences(report):
    assert [c for c, _ in issues(report, "planted")] == ["error-path", "value", "comment", "trace"]


def test_override_is_folded(report):
    assert set(pairs(report, "classes")) == {("Shape::Draw", "Shape::draw")}
    assert report.overrides.filter("change_id = 'classes'").count() == 1
    assert issues(report, "classes") == []


def test_second_definition(report):
    found = pairs(report, "duplicates")
    assert len(found) == 2 or len(report.pairs.filter("change_id = 'duplicates'").collect()) == 3
    extra = report.pairs.filter("change_id = 'duplicates' AND duplicate_of IS NOT NULL").collect()
    assert [r.r_path for r in extra] == ["k/probe_fast.rs"]
    assert "pairing" in [c for c, _ in issues(report, "duplicates")]


def test_other_architecture_is_never_paired(report):
    rows = report.pairs.filter("change_id = 'arch'").collect()
    assert [(r.c_path, r.r_path) for r in rows] == [("k/arch/x86/timer.cc", "k/arch/x86/src/timer.rs")]


def test_similarity_pairs_a_renamed_function(report):
    (pair,) = pairs(report, "renamed").values()
    assert pair.link == "similarity" and pair.why.startswith("alike by names and bodies")
    assert issues(report, "renamed") == []


def test_flow(report):
    found = issues(report, "flow")
    cats = [c for c, _ in found]
    assert cats.count("conditional") == 1
    assert cats.count("assert") == 1 and any("within DEBUG_ASSERT" in m for _, m in found)
    assert any("a check is new" in m and "returning BAD_STATE" in m for _, m in found)
    assert any(c == "atomic" and "less strict" in m for c, m in found)
    assert not any("a check is gone" in m for _, m in found), "merged checks are not missing"


def test_macro_expanded_inline(report):
    assert [m for _, m in issues(report, "macros")] == [
        "C++ macro COPY_PAIR is written out in the Rust; as a macro of its own (macro_rules!) it would stand where it stands in the C++"
    ]


def test_ffi_link_and_signature(report):
    found = pairs(report, "ffi")
    pair = found[("Fan::SetSpeed", "Fan::change_speed")]
    assert pair.link == "ffi" and "rust_fan_set_speed" in pair.why
    lint = report.lints.filter("change_id = 'ffi' AND kind = 'extern-signature'").collect()
    assert ["parameter 2" in x.message and "8-byte vs 4-byte" in x.message for x in lint] == [True]
    stays = report.cpp_changes.filter("change_id = 'ffi'").collect()
    assert [(r.functions, r.text) for r in stays] == [(["Fan::Keep"], "Stay(3);")]


def test_lints(report):
    rows = report.lints.filter("change_id = 'lints'").collect()
    kinds = sorted((r.kind, r.path, r.line) for r in rows)
    assert kinds == [
        ("invented-lifetime", "k/raw.rs", 4), ("mangled-symbol", "k/raw.rs", 20), ("provenance-comment", "k/raw.rs", 1),
        ("shim-logic", "k/raw.rs", 28), ("unsafe-density", "k/dense.rs", 1), ("unsafe-safety", "k/raw.rs", 4),
        ("unsafe-safety", "k/raw.rs", 7), ("unsafe-safety", "k/raw.rs", 18),
    ]


def test_pointers_are_followed_through_any_number_of_lets(report):
    (found,) = report.lints.filter("change_id = 'chain' AND kind = 'invented-lifetime'").collect()
    assert found.line == 10


def test_unchanged_cpp_is_found(report):
    (pair,) = pairs(report, "lookup").values()
    assert pair.origin == "unchanged" and pair.c_path == "k/dial.cc"
    assert issues(report, "lookup") == []


def test_issues_only(report):
    strict = report.issues_only()
    assert strict.findings.filter("severity = 'note'").count() == 0
    assert strict.pairs.filter("change_id = 'faithful'").count() == 0


def test_sinks(report):
    import json

    from crossweave.config import Options
    from crossweave.sinks import html, text
    from crossweave.sinks import json as as_json

    doc = json.loads(as_json.as_documents(report).filter("change_id = 'planted'").first().json)
    assert doc["summary"]["issues"] == 4 and len(doc["pairs"]) == 4
    lines = [r.line for r in text.report_lines(report, Options(layout="stacked")).filter("change_id = 'planted'").orderBy("ord").collect()]
    assert lines[0].startswith("4 pairs, 4 issues")
    assert sum(l.startswith("    ! ") for l in lines) == 4
    page = html.pages(report).filter("change_id = 'planted'").first().html
    assert page.startswith("<!doctype html>") and "http" not in page.replace("http-equiv", "")
