"""Session settings and the shared folder used for checkpoints and stream state."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"

# Adaptive execution sizes partitions, switches to broadcast joins on measured sizes
# and splits skewed join partitions. Shuffle partitions are left to the cluster.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("reliefgrid")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a temporary one only for a local master."""
    configured = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder every executor can reach")
    made = tempfile.mkdtemp(prefix="reliefgrid-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


_MADE: list[str] = []
#: Of each thread, the lists of the ``scratch`` blocks it is in.
_OWN = threading.local()


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def drop_scratch(spark: SparkSession) -> int:
    """Delete the tables that ``cut`` wrote in this process so far; how many there were.

    Call it when a job's results are stored: frames that read those tables are of no use afterwards.
    """
    paths, _MADE[:] = list(_MADE), []
    _delete(spark, paths)
    return len(paths)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that ``cut`` writes inside the block, by its own thread, when it ends.

    For steps that store their results inside the block; frames that read those tables are of no use afterwards.
    """
    blocks = _OWN.__dict__.setdefault("blocks", [])
    blocks.append([])
    try:
        yield
    finally:
        _delete(spark, blocks.pop())


def cut(df: DataFrame) -> DataFrame:
    """Write a frame that several branches read as a table in the shared folder.

    It is then computed once, survives lost executors, and its measured size lets Spark
    choose joins before shuffling anything.
    """
    path = scratch_path(df.sparkSession, "table")
    blocks = getattr(_OWN, "blocks", None)
    (blocks[-1] if blocks else _MADE).append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
