"""Revision ranges of git repositories as versions of a change."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .patch import patch_lines
from ..functions.paths import language


def git(repo: str, *args: str) -> str:
    done = subprocess.run(["git", "-C", repo, *args], capture_output=True, check=False)
    if done.returncode != 0:
        raise RuntimeError(done.stderr.decode(errors="replace").strip() or f"git {args[0]} failed")
    return done.stdout.decode(errors="replace")


def is_repo(repo: str) -> bool:
    try:
        git(repo, "rev-parse", "--git-dir")
        return True
    except RuntimeError:
        return False


def split_range(rev: str) -> tuple[str, str]:
    """``R`` is its parent to itself; ``A..B`` and ``A...B`` end at HEAD when B is left out."""
    if ".." not in rev:
        return f"{rev}^", rev
    base, head = rev.split("..", 1)
    return base, head.lstrip(".") or "HEAD"


def _diff_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(r.change_id, git(r.repo, "diff", "-U0", "-M", r.base, r.head)) for r in pdf.itertuples(index=False)]
        yield pd.DataFrame(rows, columns=["change_id", "text"])


def _show_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts = [git(r.repo, "show", f"{r.rev}:{r.path}") for r in pdf.itertuples(index=False)]
        yield pdf.drop(columns=["repo", "rev"]).assign(text=texts)


def versions_of_ranges(ranges: DataFrame) -> DataFrame:
    """Versions for a table of ``change_id, repo, base, head``; one range or many.

    The diffs run one per row, and every file side is one row of a second pass,
    so the reads spread over the cluster; the repository must be reachable there.
    """
    patches = ranges.mapInPandas(_diff_batches, "change_id string, text string")
    lines = patch_lines(patches)
    shown = F.coalesce("new_path", "old_path")
    lines = lines.withColumn("lang", language(shown)).filter("lang IS NOT NULL AND (lang = 'cpp' OR side = 'new')")
    path = F.when(F.col("side") == "old", F.col("old_path")).otherwise(F.col("new_path"))
    lines = lines.withColumn("path", path).filter("path IS NOT NULL")
    # With no context a side without changed lines shows none; both sides of a C++ file are read.
    files = lines.groupBy("change_id", "file_ix", "lang", "old_path", "new_path").agg(
        F.array_sort(F.collect_list(F.when((F.col("side") == "old") & F.col("touched"), F.col("line_no")))).alias("gone"),
        F.array_sort(F.collect_list(F.when((F.col("side") == "new") & F.col("touched"), F.col("line_no")))).alias("fresh"),
    ).join(ranges.select("change_id", "repo", "base", "head"), "change_id")
    sides = F.array(
        F.when((F.col("lang") == "cpp") & F.col("old_path").isNotNull(), F.struct(F.lit("cpp_old").alias("side"), F.col("base").alias("rev"), F.col("old_path").alias("path"), F.col("gone").alias("changed"))),
        F.when((F.col("lang") == "cpp") & F.col("new_path").isNotNull(), F.struct(F.lit("cpp_new").alias("side"), F.col("head").alias("rev"), F.col("new_path").alias("path"), F.col("fresh").alias("changed"))),
        F.when((F.col("lang") == "rust") & F.col("new_path").isNotNull(), F.struct(F.lit("rust_new").alias("side"), F.col("head").alias("rev"), F.col("new_path").alias("path"), F.col("fresh").alias("changed"))),
    )
    asks = files.select("change_id", "file_ix", "lang", "repo", F.explode(F.filter(sides, lambda s: s.isNotNull())).alias("s")).select("change_id", "file_ix", "s.side", "lang", "s.path", "s.changed", "repo", "s.rev")
    out = "change_id string, file_ix int, side string, lang string, path string, changed array<int>, text string"
    return asks.mapInPandas(_show_batches, out).select("change_id", "file_ix", "side", "lang", "path", "text", "changed")


def versions_of_range(spark: SparkSession, repo: str, rev: str, change_id: str | None = None) -> DataFrame:
    base, head = split_range(rev)
    ranges = spark.createDataFrame([(change_id or rev, repo, base, head)], "change_id string, repo string, base string, head string")
    return versions_of_ranges(ranges)


def _list_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for r in pdf.itertuples(index=False):
            names = git(r.repo, "ls-tree", "-r", "--name-only", r.rev).splitlines()
            yield pd.DataFrame({"change_id": r.change_id, "repo": r.repo, "rev": r.rev, "path": names})


def repo_files(ranges: DataFrame, folder: str | None = None) -> DataFrame:
    """C++ files of each range's head: ``change_id, path, text``, read one per row."""
    heads = ranges.select("change_id", "repo", F.col("head").alias("rev"))
    listed = heads.mapInPandas(_list_batches, "change_id string, repo string, rev string, path string")
    listed = listed.filter(language(F.col("path")) == "cpp")
    if folder:
        listed = listed.filter(F.col("path").startswith(folder))
    spread = listed.repartition("path").select("change_id", "path", "repo", "rev")
    return spread.mapInPandas(_show_batches, "change_id string, path string, text string")


def _blob_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Asks one ``cat-file --batch`` process for each repository; it lives as long as the partition's rows last."""
    asked: dict[str, subprocess.Popen] = {}
    try:
        for pdf in batches:
            texts = []
            for r in pdf.itertuples(index=False):
                if r.repo not in asked:
                    git(r.repo, "rev-parse", "--git-dir")
                    asked[r.repo] = subprocess.Popen(["git", "-C", r.repo, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE)
                texts.append(_ask(asked[r.repo], r.blob))
            yield pdf.assign(text=texts)
    finally:
        for process in asked.values():
            process.stdin.close()
            process.wait()


def _ask(process: subprocess.Popen, blob: str) -> str | None:
    process.stdin.write(f"{blob}\n".encode())
    process.stdin.flush()
    head = process.stdout.readline().decode(errors="replace").split()
    if not head:
        raise RuntimeError(f"git cat-file ended at {blob}")
    if len(head) < 3 or not head[2].isdigit():  # missing or ambiguous
        return None
    content = process.stdout.read(int(head[2]))
    process.stdout.read(1)
    return content.decode(errors="replace") if head[1] == "blob" else None


def blobs(asks: DataFrame) -> DataFrame:
    """repo, id and text of the blobs of a table of ``repo, id``; ids may be abbreviated.

    A blob that the repository does not hold has no text: a patch names both sides, and its new one exists only once it is
    applied. A repository that can't be read is an error.
    """
    asked = asks.select("repo", F.col("id").alias("blob")).distinct().repartition("repo", "blob")
    return asked.mapInPandas(_blob_batches, "repo string, blob string, text string").select("repo", F.col("blob").alias("id"), "text")


def subject(repo: str, rev: str) -> str:
    return git(repo, "log", "-1", "--format=%s", split_range(rev)[1]).strip()
