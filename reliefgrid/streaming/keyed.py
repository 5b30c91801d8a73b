"""Running counts held in the stream's own keyed state, with no list of past batches.

Exact counts live in Spark's state of a grouped stream: one row for each group and city, so a hot
group is spread over its cities. The halving average depends on the order of batches; its state is
one small row for each group. Every batch puts out the groups that changed; a store keeps them
under the batch number, and the latest row of a key counts.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from reliefgrid.functions.scalars import POLARITY_SCALE, polarity_units
from reliefgrid.operators import counts
from reliefgrid.streaming.store import Store

TOTALS = "country string, state string, disasters string, city string, n long, u long"
LEVELS = "country string, state string, disasters string, count long, avg_sentiment double, expired boolean"


def _complete(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("country").isNotNull() & F.col("state").isNotNull() & F.col("disasters").isNotNull())


def keyed_totals(rows: DataFrame) -> DataFrame:
    """Rows and polarity units for each group and city; on a stream, of all batches so far."""
    return _complete(rows).groupBy(*counts.KEYS, "city").agg(
        F.count("*").alias("n"), F.coalesce(F.sum(polarity_units("polarity")), F.lit(0)).cast("long").alias("u"))


def latest_totals(rows: DataFrame) -> DataFrame:
    """The last row of each group and city."""
    last = F.max_by(F.struct("n", "u"), "_batch")
    return rows.groupBy(*counts.KEYS, "city").agg(last.alias("s")).select(*counts.KEYS, "city", "s.n", "s.u")


def keyed_counts(store: Store) -> DataFrame:
    """Exact running counts with severity, of the table ``totals``."""
    by_city = latest_totals(store.read("totals"))
    partials = by_city.groupBy(*counts.KEYS).agg(
        F.sum("n").alias("count"), F.sum("u").alias("polarity_units"), F.sort_array(F.collect_list(F.when(F.col("city") != "", F.col("city")))).alias("cities"))
    return counts.severity(counts.finish_counts(partials))


def keyed_levels(rows: DataFrame, moment: str | None = None, delay: str = "1 day", expire: str | None = None) -> DataFrame:
    """Count and halving average of each group whose rows a batch holds.

    The state of a group is its count and its average in whole cents. The mean of a batch's rows is
    rounded to cents and averaged with the level before. With ``expire``, a group without rows for
    that long behind the watermark of ``moment`` is put out once more as ``expired`` and its state
    goes; its next row starts afresh.
    """
    kept = _complete(rows)
    patience = 0
    if expire is not None:
        if moment is None:
            raise ValueError("state expires by event time: name the column of the moment")
        kept = kept.withColumn(moment, F.col(moment).cast("timestamp")).withWatermark(moment, delay)
        patience = int(rows.sparkSession.sql(f"SELECT unix_millis(TIMESTAMP'1970-01-01 00:00:00Z' + INTERVAL {expire})").head()[0])
    columns = [*counts.KEYS, polarity_units("polarity").alias("units"), *([moment] if expire is not None else [])]

    def step(key: tuple, parts: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        if state.hasTimedOut:
            count, level = state.get
            state.remove()
            yield pd.DataFrame([(*key, count, None if level is None else level / counts.CENTS, True)], columns=_names(LEVELS))
            return
        count, level = state.get if state.exists else (0, None)
        units, seen, latest = 0, 0, None
        # A hot group comes in parts; only its sums are kept.
        for part in parts:
            count += len(part)
            known = part["units"].dropna()
            units += int(known.sum())
            seen += len(known)
            if expire is not None and len(part):
                top = part[moment].max()
                latest = top if latest is None else max(latest, top)
        if seen:
            # Half cents go to the even one, as rounding does elsewhere.
            cents = round(units / (seen * POLARITY_SCALE) * counts.CENTS)
            level = cents if level is None else round((level + cents) / 2)
        state.update((count, level))
        if latest is not None:
            state.setTimeoutTimestamp(max(int(latest.timestamp() * 1000), state.getCurrentWatermarkMs()) + patience + 1)
        yield pd.DataFrame([(*key, count, None if level is None else level / counts.CENTS, False)], columns=_names(LEVELS))

    timeout = GroupStateTimeout.EventTimeTimeout if expire is not None else GroupStateTimeout.NoTimeout
    return kept.select(*columns).groupBy(*counts.KEYS).applyInPandasWithState(step, LEVELS, "count long, level int", "update", timeout)


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def latest_levels(rows: DataFrame) -> DataFrame:
    """The last row of each group; groups that expired are gone."""
    last = F.max_by(F.struct("count", "avg_sentiment", "expired"), "_batch")
    return rows.groupBy(*counts.KEYS).agg(last.alias("s")).select(*counts.KEYS, "s.*").where(~F.col("expired")).drop("expired")


def run_keyed(changes: DataFrame, store: Store, name: str, checkpoint: str) -> None:
    """Work off all input there is now; each batch's changes enter the store once."""
    query = (
        changes.writeStream.outputMode("update").foreachBatch(lambda batch, number: store.commit(number, {name: batch}))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
