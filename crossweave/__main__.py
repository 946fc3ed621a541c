"""Command line: ``python -m crossweave files F... | patch [FILE] | git REV``."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from .config import DEFAULT_WIDTH, Options
from .plans.review import review
from .session import local_session
from .sources import files as file_source
from .sources import gitrepo, patch
from .sinks import html, json, text


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="crossweave")
    sub = p.add_subparsers(dest="mode", required=True)
    for mode, arg in (("files", "paths"), ("patch", "file"), ("git", "rev")):
        s = sub.add_parser(mode)
        s.add_argument(arg, nargs={"files": "+", "patch": "?", "git": None}[mode])
        s.add_argument("-C", dest="repo", default=None if mode == "patch" else ".")
        s.add_argument("--base")
        s.add_argument("--format", choices=["text", "html", "json"], default="text")
        s.add_argument("--output", "-o")
        s.add_argument("--layout", choices=["side-by-side", "stacked"], default="side-by-side")
        s.add_argument("--width", type=int, default=int(os.environ.get("COLUMNS", DEFAULT_WIDTH)))
        s.add_argument("--context", "-U", type=int)
        s.add_argument("--summary", action="store_true")
        s.add_argument("--issues-only", action="store_true")
        s.add_argument("--pair", action="append", default=[])
        s.add_argument("--min-changed", type=float, default=0.25)
        s.add_argument("--no-search", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return run(args)
    except (RuntimeError, OSError, ValueError, PySparkException) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


def run(args) -> int:
    spark = local_session()
    opts = Options(min_changed=args.min_changed, context=args.context, issues_only=args.issues_only, summary=args.summary, layout=args.layout, width=args.width)
    repo = title = None
    if args.mode == "files":
        rows = [("change", p, open(p, encoding="utf-8", errors="replace").read()) for p in args.paths]
        versions = file_source.versions_of_files(spark.createDataFrame(rows, "change_id string, path string, text string"))
    elif args.mode == "patch":
        piped = args.file in (None, "-")
        raw = sys.stdin.read() if piped else open(args.file, encoding="utf-8", errors="replace").read()
        patches, blobs = spark.createDataFrame([("change", raw)], "change_id string, text string"), None
        title = patch.title(patches).first()["title"] or ("patch from standard input" if piped else args.file)
        if args.repo and gitrepo.is_repo(args.repo):
            # Whole texts where the repository has them; the hunks stand in for the others.
            where = os.path.abspath(args.repo)
            blobs = gitrepo.blobs(patch.blob_ids(patches).select(F.lit(where).alias("repo"), "id"))
            if not args.no_search:
                base = args.base or "HEAD"
                repo = gitrepo.repo_files(spark.createDataFrame([("change", where, base, base)], "change_id string, repo string, base string, head string"))
        versions = patch.versions_of_patches(patches, blobs)
    else:
        base, head = gitrepo.split_range(args.rev)
        ranges = spark.createDataFrame([("change", os.path.abspath(args.repo), args.base or base, head)], "change_id string, repo string, base string, head string")
        versions = gitrepo.versions_of_ranges(ranges)
        title = gitrepo.subject(args.repo, args.rev) or args.rev
        repo = None if args.no_search else gitrepo.repo_files(ranges)
    wanted = [("change", *p.split("=", 1)) for p in args.pair]
    forced = spark.createDataFrame(wanted, "change_id string, cpp_name string, rust_name string") if wanted else None
    report = review(versions, opts, forced, repo)
    if opts.issues_only:
        report = report.issues_only()
    if args.format == "json":
        out = json.as_documents(report).select(F.col("json").alias("s"))
    elif args.format == "html":
        out = html.pages(report).select(F.col("html").alias("s"))
    else:
        out = text.report_lines(report, opts).orderBy("ord").select(F.col("line").alias("s"))
    target = open(args.output, "w", encoding="utf-8") if args.output else sys.stdout
    try:
        if title and args.format == "text":
            print(title, file=target)
        for row in out.toLocalIterator():
            print(row["s"], file=target)
    except BrokenPipeError:
        pass
    status = report.totals().agg(F.max("exit_status").alias("s")).first()
    return int(status["s"] or 0)


if __name__ == "__main__":
    sys.exit(main())
