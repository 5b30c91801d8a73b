"""Small tables carried inside expressions: filters and dictionaries that a row looks things up in.

A table becomes one constant array, hashed by key, which travels with the expression. Looking a word up is one hash and one array access, so rows need no join, no shuffle
and no explode. Values are bounded: a filter by its bits, a dictionary by the entries of a part;
larger dictionaries come in several parts, looked up one after the other.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reliefgrid.session import cut

#: Bits of a filter at most (half a megabyte), and how many a key gets below that.
MOST_BITS, BITS_PER_KEY = 1 << 22, 16
#: Entries of a dictionary's part, about.
PART = 1 << 14


def _power(n: int) -> int:
    return 1 << max(6, (max(1, n) - 1).bit_length())


def _dense(rows: DataFrame, place: str, value: str, size: int, empty: Column) -> Column:
    """The values of a table at their places of one constant array; ``empty`` elsewhere.

    The array passes through the driver; its size is the caller's bound.
    """
    every = rows.sparkSession.range(size).join(rows, F.col("id") == F.col(place), "left")
    listed = F.sort_array(F.collect_list(F.struct("id", F.coalesce(value, empty).alias("v"))))
    array = every.agg(F.transform(listed, lambda x: x["v"]).alias("a"))
    return F.from_json(F.lit(array.select(F.to_json("a")).head()[0]), array.schema["a"].dataType)


@dataclass
class Filter:
    """Bits set by the hashes of keys: false is certain, true is likely."""

    bits: Column
    size: int

    def holds(self, hashed: Column) -> Column:
        slot = F.pmod(hashed, F.lit(self.size))
        word = F.get(self.bits, F.floor(slot / 64).cast("int"))
        return F.getbit(word, F.pmod(slot, F.lit(64)).cast("int")) == 1


def make_filter(keys: DataFrame, hashed: Column, most: int = MOST_BITS) -> Filter:
    """A filter of a table's keys. Beyond its size more passes it; nothing set is ever missed."""
    hashes = cut(keys.select(hashed.alias("h")).distinct())
    size = min(most, _power(BITS_PER_KEY * hashes.count()))
    slot = F.pmod("h", F.lit(size))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int"))
    words = hashes.groupBy(F.floor(slot / 64).alias("word")).agg(F.bit_or(one).alias("set"))
    return Filter(_dense(words, "word", "set", size // 64, F.lit(0).cast("long")), size)


@dataclass
class Dictionary:
    """Rows of a table by key, in parts of bounded size."""

    parts: list[tuple[Column, int]]

    def find(self, key: Column) -> Column:
        """The row of a key as a struct; null without one."""
        def within(part: Column, size: int) -> Column:
            slot = F.get(part, F.pmod(F.xxhash64(key), F.lit(size)).cast("int"))
            return F.get(F.filter(slot, lambda e: e["key"] == key), F.lit(0))

        return F.coalesce(*[within(part, size) for part, size in self.parts])

    def sums(self, keys: Column, start: Column, add: Callable[[Column, Column], Column]) -> Column:
        """``add`` folded over the rows of all keys of an array that have one."""
        def step(acc: Column, key: Column) -> Column:
            row = self.find(key)
            return F.when(row.isNotNull(), add(acc, row)).otherwise(acc)

        return F.aggregate(keys, start, step)


def make_dictionary(table: DataFrame, key: str, values: Sequence[str], part: int = PART) -> Dictionary:
    """A dictionary of a table with one row for each key; rows without a key have no place in it."""
    rows = cut(table.where(F.col(key).isNotNull()).select(F.struct(F.col(key).alias("key"), *values).alias("e"), F.xxhash64(key).alias("h")))
    count = rows.count()
    # The empty list takes the type of the entries.
    none = rows.schema["e"].dataType.simpleString()
    parts = []
    number = max(1, -(-count // part))
    size = _power(min(count, part))
    for i in range(number):
        own = rows.where(F.pmod(F.xxhash64("h"), F.lit(number)) == i)
        slots = own.groupBy(F.pmod("h", F.lit(size)).alias("slot")).agg(F.collect_list("e").alias("own"))
        parts.append((_dense(slots, "slot", "own", size, F.array().cast(f"array<{none}>")), size))
    return Dictionary(parts)
