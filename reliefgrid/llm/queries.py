"""The registered queries of this folder and the SQL forms of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reliefgrid.session import scratch_path

VOCABULARY = "byte_bpe_50k.json"


def reach(spark: SparkSession) -> None:
    """Workers import this package too; where it is not installed they find it here."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    reach(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    from reliefgrid.llm.ngram_join import ngram_jaccard_join

    return ngram_jaccard_join(_table(spark, sf, "documents"))


def op2_benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    from reliefgrid.llm.decontaminate import contamination

    found = contamination(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), "contaminated",
    )


def op3_token_files(spark: SparkSession, sf: str) -> DataFrame:
    from reliefgrid.llm.tokenfiles import read_documents, write_token_files

    out = scratch_path(spark, "tokens")
    write_token_files(_table(spark, sf, "documents"), out, VOCABULARY)
    return read_documents(spark, out, digest=True)


def op4_exact_top_k(spark: SparkSession, sf: str) -> DataFrame:
    from reliefgrid.llm.topk import exact_top_k

    vectors = _table(spark, sf, "embeddings")
    return exact_top_k(vectors, vectors.where("vec_id % 20 = 0")).withColumnRenamed("id", "vec_id")


def op5_secret_scans(spark: SparkSession, sf: str) -> DataFrame:
    from reliefgrid.llm.secrets import secrets

    found = secrets(_table(spark, sf, "documents"), scratch_path(spark, "ledger"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["begin"], s["end"])), ",")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"),
    )


def op6_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    from reliefgrid.llm import toxicity

    docs = _table(spark, sf, "documents")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))
    model = toxicity.train(docs, _table(spark, sf, "labels").where(fold != 2))
    return toxicity.score(docs, model).select(
        "doc_id", (F.coalesce(fold, F.lit(-1)) == 2).alias("held_out"), "score", (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"))


def op7_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    from reliefgrid.llm.quality import quality

    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))
    labels = _table(spark, sf, "labels").where(fold != 2)
    scored = quality(_table(spark, sf, "documents"), labels)
    return scored.withColumn("held_out", F.coalesce(fold, F.lit(-1)) == 2).withColumn("keep", F.col("score") >= 0.5)


def op8_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    from reliefgrid.llm import htmltext

    pages = _table(spark, sf, "pages")
    return htmltext.extract(pages, htmltext.train(pages))


def op9_language_id(spark: SparkSession, sf: str) -> DataFrame:
    from reliefgrid.llm import langid

    docs = _table(spark, sf, "documents")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3))
    model = langid.train(docs.where(fold != 1))
    return langid.predict(docs, model).withColumn("held_out", F.coalesce(fold, F.lit(-1)) == 1)


def op10_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    from reliefgrid.llm.packing import pack, word_count

    packed = pack(_table(spark, sf, "documents"), "doc_id", word_count(F.col("text")))
    return packed.withColumnRenamed("id", "doc_id")


def op11_centroid_clustering(spark: SparkSession, sf: str) -> DataFrame:
    from reliefgrid.llm.centroids import cluster

    return cluster(_table(spark, sf, "embeddings")).drop("scans")


def op12_pii_sanitisation(spark: SparkSession, sf: str) -> DataFrame:
    from reliefgrid.llm.sanitise import KINDS, find

    found = find(_table(spark, sf, "documents"))
    listed = lambda own: F.array_join(F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["begin"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "term")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(k.name) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed("spans").alias("spans"))


def op13_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    from reliefgrid.llm.spelling import group_variants

    return group_variants(_table(spark, sf, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_ngram_jaccard_join, op2_benchmark_decontamination, op3_token_files, op4_exact_top_k, op5_secret_scans,
        op6_toxicity, op7_quality_classifier, op8_html_extraction, op9_language_id, op10_best_fit_packing,
        op11_centroid_clustering, op12_pii_sanitisation, op13_spelling_variants,
    )
}
