"""Corpus cleaning: toxicity, near duplicates, benchmark passages and secrets go, the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reliefgrid.llm import decontaminate, ngram_join, packing, secrets, toxicity
from reliefgrid.llm.queries import reach
from reliefgrid.session import cut, scratch_path

#: The first stage learns from labels, which SQL cannot express.
ORACLE_SQL = None


def _renamed(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """``docs`` under names that no operator uses, and those of the id and the text."""
    names = [f"column{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), names[docs.columns.index("doc_id")], names[docs.columns.index("text")]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of these documents, does not reject."""
    reach(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows, _, text = _renamed(docs)
    scored = toxicity.score(rows, model, text_col=text, keep=tuple(rows.columns))
    return scored.where(F.col("score") < toxicity.CUT).select(rows.columns).toDF(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component; of rows with one id, one stays.

    Of those it is the row whose columns have the smallest hash, so a retry keeps the same one.
    Rows without id belong to no component and stay.
    """
    reach(spark)
    found = ngram_join.ngram_jaccard_join(docs)
    others = found.where("doc_id != component_id").select("doc_id").distinct()
    kept = docs.join(others, "doc_id", "left_anti").select(docs.columns)
    repeated = cut(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    if repeated.isEmpty():
        return kept
    single = kept.join(repeated, "doc_id", "left_anti").select(docs.columns)
    rows, key, _ = _renamed(kept.join(repeated, "doc_id", "left_semi").select(docs.columns))
    one = rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), F.xxhash64(*rows.columns)).alias("row")).select("row.*")
    return single.union(one.select(rows.columns).toDF(*docs.columns))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    reach(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows, _, text = _renamed(docs)
    found = decontaminate.contamination(rows, benchmark, text_col=text, keep=tuple(rows.columns))
    return found.where(~F.col("contaminated")).select(rows.columns).toDF(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by their kinds; ``n_chars`` follows the text."""
    rows, key, text = _renamed(docs)
    clean = secrets.redact(rows, scratch_path(spark, "ledger"), id_col=key, text_col=text).toDF(*docs.columns)
    return clean.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long")).select(docs.columns)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document with its bin."""
    return packing.pack(docs, "doc_id", packing.word_count(F.col("text"))).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark),
    ("secret_scans", redact_secrets),
    ("best_fit_packing", pack_documents),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
