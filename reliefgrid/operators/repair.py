"""Schema repair, aligned unions, quality gate and row rejection."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Defaults = Mapping[str, tuple[str, object]]


def default_value(kind: str, value: object) -> Column:
    if isinstance(value, list):
        return F.array(*[F.lit(v) for v in value]).cast(kind)
    return F.lit(value).cast(kind)


def repair_schema(df: DataFrame, expected: Defaults) -> DataFrame:
    """Add each missing column with its default; columns present stay as they are."""
    missing = {c: default_value(*expected[c]).alias(c) for c in expected if c not in df.columns}
    kept = [c for c in df.columns if c not in expected]
    return df.select(*[missing.get(c, F.col(c)) for c in expected], *kept)


def union_aligned(old: DataFrame, new: DataFrame, expected: Defaults) -> DataFrame:
    """Bag union by name after widening both sides to the expected columns."""
    return repair_schema(old, expected).unionByName(repair_schema(new, expected), allowMissingColumns=True)


def union_posts(first: DataFrame, *others: DataFrame) -> DataFrame:
    out = first
    for other in others:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def quality_gate(df: DataFrame, expected: Defaults) -> DataFrame:
    """One row: size, missing columns, columns without any value, and whether to start over."""
    present = [c for c in expected if c in df.columns]
    missing = [c for c in expected if c not in df.columns]
    stats = df.agg(F.count("*").alias("row_count"), *[F.count(c).alias(f"_n_{c}") for c in present])
    blank = F.array_compact(F.array(*[F.when(F.col(f"_n_{c}") == 0, F.lit(c)) for c in present]))
    return stats.select(
        "row_count",
        F.array(*[F.lit(c) for c in missing]).cast("array<string>").alias("missing_columns"),
        blank.cast("array<string>").alias("empty_columns"),
        ((F.col("row_count") == 0) | F.lit(not present)).alias("start_over"),
    )


def fill_defaults(entities: DataFrame, defaults: Mapping[str, Column]) -> DataFrame:
    """Default record where extraction gave nothing."""
    return entities.withColumns({c: F.coalesce(F.col(c), d) for c, d in defaults.items()})


def entity_defaults() -> dict[str, Column]:
    none = F.array().cast("array<string>")
    return {
        "disasters": none,
        "locations": none,
        "sentiment": F.lit("Neutral"),
        "polarity": F.lit(0.0),
    }


def split_rejects(df: DataFrame, checks: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows passing every check, and the others with the name of the first failed one."""
    reason = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])
    marked = df.withColumn("reason", reason)
    return marked.where(F.col("reason").isNull()).drop("reason"), marked.where(F.col("reason").isNotNull())


def drop_null_state(df: DataFrame) -> DataFrame:
    return df.na.drop(subset=["state"])
