"""Tables that change together, batch by batch, made visible by one log."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOG = "batch long, kind string, name string, attempt string"


class Store:
    """Rows of several tables, appended under a batch number and an attempt.

    A batch is finished when the log holds it, and the log is written last; so a reader sees all
    tables of a batch or none, and what a broken attempt left behind is never read. A batch that
    comes again is left alone. Readers match rows with the log by a join: nothing lists folders or
    names batches. One writer at a time; batches of one store come in order. ``shown`` turns the
    stored rows of a table, ``_batch`` among them, into those that readers get.
    """

    def __init__(
        self, spark: SparkSession, root: str, tables: Mapping[str, str],
        shown: Mapping[str, Callable[[DataFrame], DataFrame]] | None = None,
    ) -> None:
        self.spark, self.root, self.tables, self.shown = spark, root, dict(tables), dict(shown or {})
        for name, schema in (*self.tables.items(), ("_log", _LOG)):
            # Only the first opening writes; an empty table has a schema and no rows.
            empty = self.spark.createDataFrame([], self._schema(name, schema))
            empty.write.mode("ignore").parquet(f"{root}/{name}")
            if set(self.spark.read.parquet(f"{root}/{name}").columns) != set(empty.columns):
                raise ValueError(f"{root}/{name} was written with other columns")

    @staticmethod
    def _schema(name: str, schema: str) -> str:
        return schema if name == "_log" else f"{schema}, _batch long, _attempt string"

    def log(self) -> DataFrame:
        return self.spark.read.schema(_LOG).parquet(f"{self.root}/_log")

    def holds(self, number: int) -> bool:
        return not self.log().where((F.col("kind") == "batch") & (F.col("batch") == number)).isEmpty()

    def _append(self, name: str, rows: DataFrame, number: int, attempt: str) -> None:
        kept = [f.name for f in self.spark.createDataFrame([], self.tables[name]).schema]
        stamped = rows.select(*kept, F.lit(number).cast("long").alias("_batch"), F.lit(attempt).alias("_attempt"))
        stamped.write.mode("append").parquet(f"{self.root}/{name}")

    def _finish(self, number: int, kind: str, name: str, attempt: str) -> None:
        self.spark.createDataFrame([(number, kind, name, attempt)], _LOG).coalesce(1).write.mode("append").parquet(f"{self.root}/_log")

    def commit(self, number: int, rows: Mapping[str, DataFrame]) -> bool:
        """Append a batch's rows to their tables; false if the batch is there already."""
        if self.holds(number):
            return False
        attempt = uuid.uuid4().hex
        for name, own in rows.items():
            self._append(name, own, number, attempt)
        self._finish(number, "batch", "", attempt)
        return True

    def read(self, name: str) -> DataFrame:
        """Rows of the latest total of a table, and of all finished batches behind it, with ``_batch``."""
        return self.shown.get(name, lambda rows: rows)(self._stored(name))

    def _stored(self, name: str) -> DataFrame:
        rows = self.spark.read.schema(self._schema(name, self.tables[name])).parquet(f"{self.root}/{name}")
        log = self.log()
        total = log.where((F.col("kind") == "total") & (F.col("name") == name)).agg(
            F.max("batch").alias("upto"), F.max_by("attempt", "batch").alias("latest"))
        seen = log.crossJoin(F.broadcast(total)).where(
            ((F.col("kind") == "batch") & (F.col("batch") > F.coalesce("upto", F.lit(-1)))) | (F.col("attempt") == F.col("latest")))
        return rows.join(seen.select(F.col("attempt").alias("_attempt")).distinct(), "_attempt", "left_semi").drop("_attempt")

    def fold(self, name: str, merge: Callable[[DataFrame], DataFrame]) -> int | None:
        """Write what ``merge`` makes of a table as its new total, so that reading stays short."""
        last = self.log().where("kind = 'batch'").agg(F.max("batch")).head()[0]
        if last is None:
            return None
        attempt = uuid.uuid4().hex
        self._append(name, merge(self._stored(name).drop("_batch")), last, attempt)
        self._finish(last, "total", name, attempt)
        return last
