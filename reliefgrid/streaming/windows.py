"""Counts in event-time windows. State ends behind the watermark.

The same functions work on tables and on streams. On a stream, a window is emitted once, when the
watermark (the latest moment of earlier batches, less ``delay``) passes its end; its state goes with
it. A row all of whose windows have ended by then is late: it changes no result, and Spark's
progress reports count it. Rows without a moment belong to no window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reliefgrid.functions.scalars import polarity_units


def _counted(rows: DataFrame, span: Column, moment: str, delay: str, keys: Sequence[str], value: str | None) -> DataFrame:
    timed = rows.withColumn(moment, F.col(moment).cast("timestamp")).where(F.col(moment).isNotNull()).withWatermark(moment, delay)
    # Sums are whole millionths, so they do not depend on the order of batches and tasks.
    total = F.sum(polarity_units(value)) if value else F.count("*")
    grouped = timed.groupBy(span.alias("_span"), *keys).agg(F.count("*").alias("count"), total.alias("units"))
    return grouped.select(F.col("_span.start").alias("window_start"), F.col("_span.end").alias("window_end"), *keys, "count", "units")


def window_counts(
    rows: DataFrame, moment: str, size: str, delay: str, keys: Sequence[str] = (), value: str | None = None, slide: str | None = None
) -> DataFrame:
    """``window_start, window_end, keys, count, units`` of windows of one size.

    Windows stand side by side, or begin every ``slide``, so that a row counts in several.
    ``units`` sums ``value`` in millionths.
    """
    return _counted(rows, F.window(moment, size, slide or size), moment, delay, keys, value)


def session_counts(rows: DataFrame, moment: str, gap: str, delay: str, keys: Sequence[str], value: str | None = None) -> DataFrame:
    """The same of sessions: rows of a key that follow each other within ``gap``.

    A session ends one gap behind its last row.
    """
    return _counted(rows, F.session_window(moment, gap), moment, delay, keys, value)


def append_windows(windows: DataFrame, path: str, checkpoint: str) -> list[dict]:
    """Work off all input there is now and append the windows that ended; each once, also after a restart.

    Returns the progress reports: rows kept in state, rows dropped as late.
    """
    query = (
        windows.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return list(query.recentProgress)
