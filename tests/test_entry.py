"""The driver's entry module with and without the corpus operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LIST = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(q.startswith('op') or q == 'pipeline' for q in e.queries()))"


def listed(folder):
    made = subprocess.run([sys.executable, "-B", "-c", LIST], cwd=folder, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": ""})
    assert made.returncode == 0, made.stderr
    queries, oracles, corpus = made.stdout.split()[-3:]
    return int(queries), int(oracles), corpus == "True"


def test_queries_are_listed_without_the_corpus_operators(tmp_path):
    whole = tmp_path / "whole"
    leave = shutil.ignore_patterns(".git", "__pycache__", "tests", "*.json", "llm", "corpus_pipeline.py")
    shutil.copytree(ROOT, whole, ignore=leave)
    queries, oracles, corpus = listed(whole)
    assert queries >= 60 and oracles >= 60 and not corpus
    if os.path.exists(f"{ROOT}/corpus_pipeline.py"):
        # The pipeline alone, without the folder it calls, is left out too.
        shutil.copy(f"{ROOT}/corpus_pipeline.py", whole)
        assert listed(whole) == (queries, oracles, False)
