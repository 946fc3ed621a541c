import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from crossweave.session import local_session

    s = local_session("8", "tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def report(spark):
    """One review of every case of the corpus, each its own change."""
    import corpus
    from crossweave.plans.review import review
    from crossweave.sources.files import versions_of_files, versions_of_trees

    table = lambda cases: spark.createDataFrame([(c, p, t) for c, fs in cases.items() for p, t in fs], "change_id string, path string, text string")
    versions = versions_of_files(table(corpus.FILES)).unionByName(versions_of_trees(table(corpus.BEFORE), table(corpus.AFTER)))
    repo = spark.createDataFrame(corpus.REPO, "change_id string, path string, text string")
    return review(versions, repo_files=repo)
