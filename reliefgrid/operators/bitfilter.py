"""A filter of key hashes, small enough to send everywhere, that spares most rows a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a filter. It has a row for each 64 of them, so at most 2^20 short rows are broadcast
#: whatever the table holds. A full filter lets more rows through and loses none.
BITS = 1 << 26


def _slot(hashed: Column) -> Column:
    return F.pmod(hashed, F.lit(BITS))


def bit_filter(hashes: DataFrame, hashed: str) -> DataFrame:
    """``word, bits``: the bits that the hashes of a table set."""
    at = _slot(F.col(hashed))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))
    return hashes.groupBy(F.floor(at / 64).alias("word")).agg(F.bit_or(one).alias("bits"))


def marked(rows: DataFrame, hashed: Column, bits: DataFrame, flag: str) -> DataFrame:
    """``rows`` with whether the filter holds their hash: never false for a hash that was set."""
    own = rows.withColumn("_slot", _slot(hashed)).withColumn("word", F.floor(F.col("_slot") / 64))
    joined = own.join(F.broadcast(bits), "word", "left")
    hit = F.coalesce(F.getbit("bits", F.pmod("_slot", F.lit(64)).cast("int")) == 1, F.lit(False))
    return joined.select(*rows.columns, hit.alias(flag))


def likely(rows: DataFrame, hashed: Column, bits: DataFrame) -> DataFrame:
    """The rows whose hash the filter holds: all whose hash was set, and few others."""
    own = rows.withColumn("_slot", _slot(hashed)).withColumn("word", F.floor(F.col("_slot") / 64))
    joined = own.join(F.broadcast(bits), "word")
    return joined.where(F.getbit("bits", F.pmod("_slot", F.lit(64)).cast("int")) == 1).select(*rows.columns)
