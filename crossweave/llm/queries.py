"""The operators as queries over the shared tables, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, filter_audit, impact_index, langid, licenses, maintext, mixing, neighbours, periodic_runs, quality, shingle_join, tokens, toxicity
from . import texts as T

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return wrap


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_license_scan")
def op1(spark, folder):
    return licenses.scan(table(spark, folder, "documents"))


@query("op2_toxicity")
def op2(spark, folder):
    docs = table(spark, folder, "documents")
    made = toxicity.score(docs, toxicity.learn(docs, table(spark, folder, "labels")))
    return made.select("doc_id", T.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.ACCEPT).cast("int").alias("predicted"))


@query("op3_nearest_neighbours")
def op3(spark, folder):
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return neighbours.search(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


@query("op4_decontamination")
def op4(spark, folder):
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op5_ngram_jaccard")
def op5(spark, folder):
    return shingle_join.join(table(spark, folder, "documents"), shingle_join.Rule(3, 9, 10), count=False)


@query("op6_quality")
def op6(spark, folder):
    docs = table(spark, folder, "documents")
    made = quality.score(docs, quality.learn(docs, table(spark, folder, "labels")))
    return made.select("doc_id", T.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= quality.ACCEPT).cast("int").alias("predicted"), "n_passages")


@query("op7_main_text")
def op7(spark, folder):
    return maintext.extract(table(spark, folder, "pages"))


@query("op8_token_binary")
def op8(spark, folder):
    return tokens.tokens(table(spark, folder, "documents"))


@query("op9_source_mix", f"SELECT doc_id, size, source_size, target, size * copies AS taken FROM ({mixing.sql()})")
def op9(spark, folder):
    made = mixing.mix(table(spark, folder, "documents").select("doc_id", "text", "source"))
    return made.select("doc_id", "_mix.size", "_mix.source_size", "_mix.target", (F.col("_mix.size") * F.col("_mix.copies")).alias("taken"))


@query("op10_language_id")
def op10(spark, folder):
    docs = table(spark, folder, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    made = langid.predict(docs, langid.learn(docs))
    return made.select("doc_id", T.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query("op11_exact_top_k", impact_index.sql())
def op11(spark, folder):
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return impact_index.search(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


@query("op12_periodic_runs")
def op12(spark, folder):
    docs = table(spark, folder, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), periodic_runs.planted(F.col("doc_id"), F.col("text")).alias("text"))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return periodic_runs.find(docs, ["doc_id"]).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "strongest.start", "strongest.length", "strongest.period",
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query("op13_filter_audit", filter_audit.sql())
def op13(spark, folder):
    return filter_audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))
