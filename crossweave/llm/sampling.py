"""Bounded samples of labelled rows for fitting a model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import texts as T

_SCALE = 1 << 30


def labelled_sample(rows: DataFrame, bound: int, key: str = "doc_id", seed: int = 7) -> DataFrame:
    """About ``bound`` of the rows, or all if there are fewer, chosen by a hash of the key: a rerun chooses the same."""
    n = rows.select(key).count()
    chance = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(_SCALE)) < int(min(1.0, bound / max(n, 1)) * _SCALE)
    return rows.filter(chance)


def learning_rows(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """doc_id, text and y of the documents a model may learn from; a document with contradicting labels is left out."""
    own = (
        labels.filter(T.learnable(F.col("doc_id")) & F.col(label).isin(0, 1))
        .groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("_most")).filter("y = _most").select("doc_id", F.col("y").cast("int").alias("y"))
    )
    return own.join(docs.select("doc_id", "text"), "doc_id")
