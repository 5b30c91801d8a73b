"""Gold and predicted place lists, list matching per post, and overall scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reliefgrid.functions.matching import match_exact, match_partial
from reliefgrid.functions.scalars import normalise_list
from reliefgrid.functions.text import clean_text
from reliefgrid.operators.posts import keep_first
from reliefgrid.operators.tagging import tag_places

# Fixed value: added to each denominator.
EPSILON = 1e-9


def gold_lists(labels: DataFrame, key: str = "id", order: str = "ord") -> DataFrame:
    """Per id the first text and its distinct trimmed labels; rows without an id are dropped.

    Grouping by label first spreads an id with very many labels over the cluster.
    """
    first_text = F.min_by("text", order)
    by_label = (
        labels.where(F.col(key).isNotNull())
        .groupBy(key, F.trim("toponym").alias("label"))
        .agg(first_text.alias("text"), F.min(order).alias(order))
    )
    return by_label.groupBy(key).agg(
        first_text.alias("text"), F.sort_array(F.collect_list("label")).alias("locations")
    )


def pred_lists(
    labels: DataFrame, names: DataFrame, key: str = "id", order: str = "ord", max_words: int = 3
) -> DataFrame:
    """Per id the cleaned text and its place mentions in order, repeats kept."""
    unique = keep_first(labels.select(key, order, "text"), [key], [order])
    texts = unique.select(key, clean_text("text").alias("cleaned"))
    tagged = tag_places(texts, names, key, max_words, distinct=False)
    found = F.coalesce("locations", F.array().cast("array<string>"))
    return texts.join(tagged, key, "left").select(key, F.col("cleaned").alias("text"), found.alias("locations"))


def compare_lists(gold: DataFrame, pred: DataFrame, key: str = "id", partial: bool = True) -> DataFrame:
    """Full outer match of both sides by id: lists, hits, false and missed items, and the text."""
    g = gold.select(key, F.col("text").alias("g_text"), F.col("locations").alias("g_list"))
    p = pred.select(key, F.col("text").alias("p_text"), F.col("locations").alias("p_list"))
    lists = g.join(p, key, "full").select(
        key,
        F.coalesce("g_text", "p_text").alias("text"),
        normalise_list("g_list").alias("gold"),
        normalise_list("p_list").alias("pred"),
    )
    rule = match_partial if partial else match_exact
    return lists.withColumn("m", rule("gold", "pred")).select(key, "text", "gold", "pred", "m.*")


def extraction_scores(results: DataFrame) -> DataFrame:
    """Precision, recall and F1 over all items of all posts."""
    totals = results.agg(
        F.coalesce(F.sum(F.size("tp")), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.size("fp")), F.lit(0)).alias("fp"),
        F.coalesce(F.sum(F.size("fn")), F.lit(0)).alias("fn"),
    )
    precision = F.col("tp") / (F.col("tp") + F.col("fp") + EPSILON)
    recall = F.col("tp") / (F.col("tp") + F.col("fn") + EPSILON)
    scored = totals.withColumns({"precision": precision, "recall": recall})
    p, r = F.col("precision"), F.col("recall")
    return scored.withColumn("f1", F.lit(2.0) * p * r / (p + r + EPSILON))


def error_samples(results: DataFrame, key: str = "id", n: int = 5) -> DataFrame:
    """The first ``n`` posts with a false or a missed item."""
    wrong = (F.size("fp") > 0) | (F.size("fn") > 0)
    return results.where(wrong).orderBy(key).limit(n)
