"""Intermediate tables of one run of an operator, removed when its result stands on its own."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..session import scratch_dir
from . import texts as T


class Scratch:
    """Writes tables to the shared folder, as ``stage`` does, and removes them again.

    Written tables survive lost executors and cut lineage. ``drop`` removes those that no later step reads;
    ``keep`` writes the result and removes all others.
    """

    def __init__(self):
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def stage(self, df: DataFrame, label: str) -> DataFrame:
        spark = df.sparkSession
        path = f"{scratch_dir(spark)}/crossweave/{label}-{uuid.uuid4().hex}"
        with T.small_batches(spark):
            df.write.parquet(path)
        made = spark.read.schema(df.schema).parquet(path)
        self.paths[id(made)] = (made, path)
        return made

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            made, path = self.paths.pop(id(table))
            jvm = made.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(made.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        before = [made for made, _ in self.paths.values()]
        made = self.stage(df, label)
        self.drop(*before)
        self.paths.clear()
        return made
