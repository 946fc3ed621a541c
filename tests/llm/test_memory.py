"""What steps over whole texts hold beside the JVM's heap."""

import pyarrow as pa
import small_corpus as corpus
from pyspark.sql import functions as F

from crossweave.llm import texts as T
from crossweave.llm import tokens
from crossweave.llm.scratch import Scratch

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_texts_are_handed_over_in_small_batches(spark):
    docs = spark.range(0, 6000, 1, 1).select(F.expr("repeat(cast(id as string), 1000)").alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.num_rows], pa.int64()), pa.array([batch.nbytes], pa.int64())], names=["n", "size"])

    was = spark.conf.get(LIMIT)
    got = Scratch().stage(docs.mapInArrow(sizes, "n long, size long"), "sizes").collect()
    assert sum(r["n"] for r in got) == 6000
    assert len(got) > 1 and max(r["size"] for r in got) <= T.HANDED + (1 << 16)
    assert spark.conf.get(LIMIT) == was
    try:
        spark.conf.set(LIMIT, "1m")
        smaller = Scratch().stage(docs.mapInArrow(sizes, "n long, size long"), "sizes").collect()
        assert max(r["size"] for r in smaller) <= (1 << 20) + (1 << 16)
        assert spark.conf.get(LIMIT) == "1m"
    finally:
        spark.conf.set(LIMIT, was)


def test_token_files_leave_no_encoder_and_no_other_workers(spark, tmp_path):
    folder, files = tokens.write(corpus.table(spark, corpus.rows()), f"file://{tmp_path}/out")
    assert "ExistingRDD" not in files._jdf.queryExecution().toString()  # rows of Python objects pass through workers of their own

    def held(batches):
        for _ in batches:
            T.worker_store()["encoder of a test"] = None
            tokens.drop_encoders()
            yield pa.record_batch([pa.array([sum(x.startswith("encoder ") for x in T.worker_store())], pa.int64())], names=["n"])

    assert [r["n"] for r in spark.range(0, 1, 1, 1).mapInArrow(held, "n long").collect()] == [0]
    assert tokens.read(folder, files).count() == len(corpus.rows())


def test_workers_give_memory_back_when_a_task_ends(monkeypatch):
    class Frame:
        def mapInArrow(self, run, schema):
            return run

    calls = []
    T.release()  # bears being called anywhere
    monkeypatch.setattr(T, "release", lambda: calls.append("released"))
    made = T.over_batches(Frame(), lambda batches: (calls.append(x) or x for x in batches), "id long")(iter([1, 2]))
    assert list(made) == [1, 2] and calls == [1, 2, "released"]
