"""Append store for posts and versioned snapshots for aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reliefgrid.session import cut


def _children(spark: SparkSession, root: str) -> list[str]:
    """Names of the folders below ``root`` that hold a finished write."""
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(base):
        return []
    return sorted(
        status.getPath().getName()
        for status in fs.listStatus(base)
        if status.isDirectory() and fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS"))
    )


def versions(spark: SparkSession, root: str, key: str = "v") -> list[int]:
    prefix = f"{key}="
    return sorted(int(n[len(prefix):]) for n in _children(spark, root) if n.startswith(prefix))


def write_snapshot(df: DataFrame, root: str) -> int | None:
    """Write a new version next to the old ones; an empty result writes nothing.

    A version counts once its success marker exists, so readers never see half a write
    and a job may read the version it replaces.
    """
    rows = cut(df)
    if rows.isEmpty():
        return None
    done = versions(df.sparkSession, root)
    version = (done[-1] + 1) if done else 1
    rows.write.mode("overwrite").parquet(f"{root}/v={version}")
    return version


def read_snapshot(spark: SparkSession, root: str) -> DataFrame | None:
    """The latest finished version, or nothing on a fresh start."""
    done = versions(spark, root)
    return spark.read.parquet(f"{root}/v={done[-1]}") if done else None


def append_posts(batch: DataFrame, root: str) -> None:
    batch.write.mode("append").parquet(root)
