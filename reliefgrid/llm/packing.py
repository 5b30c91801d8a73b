"""Variable-capacity best-fit packing.

Several sequence lengths are permitted. Pieces go, longest first, to the open bin they leave
the least room in; where none fits, the bin size is opened that costs least for what it is
expected to hold, and at the end every bin shrinks to the smallest permitted length that holds
its contents. Documents are dealt into groups of bounded size by a hash, and each group is packed
on its own, so no task sees more than a group.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reliefgrid.llm.tokenfiles import read_documents
from reliefgrid.session import cut

CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: Pieces of a group, about: large enough that bins left open at its end hardly count.
GROUP = 4096
#: A sequence costs its length and, for attention, its length squared over this.
ATTENTION = 65536


def bin_cost(capacity: int, attention: int = ATTENTION) -> float:
    """What a sequence of a length costs to train on."""
    return capacity + capacity * capacity / attention


def pack_sizes(sizes: list[int], capacities: tuple[int, ...] = CAPACITIES) -> tuple[list[int], list[int], list[int], list[int]]:
    """Bin number and place of each piece, final capacity and contents of each bin.

    Pieces come longest first and none is longer than the largest capacity.
    """
    left = int(sum(sizes))
    open_bins: list[tuple[int, int]] = []  # (room, bin), sorted
    room, used, capacity, bins, places = [], [], [], [], []
    for size in sizes:
        at = bisect_left(open_bins, (size, -1))
        if at < len(open_bins):
            _, chosen = open_bins.pop(at)
        else:
            # A larger bin pays only where enough is left to fill it.
            fitting = [c for c in capacities if c >= size]
            opened = min(fitting, key=lambda c: (bin_cost(c) / min(c, left), -c))
            chosen = len(room)
            room.append(opened)
            capacity.append(opened)
            used.append(0)
        bins.append(chosen)
        places.append(used[chosen])
        used[chosen] += size
        room[chosen] -= size
        left -= size
        if room[chosen] > 0:
            insort(open_bins, (room[chosen], chosen))
    final = [min(c for c in capacities if c >= n) for n in used]
    return bins, places, final, used


def pack(docs: DataFrame, id_col: str, length: Column, capacities: tuple[int, ...] = CAPACITIES, group_size: int = GROUP) -> DataFrame:
    """``id, piece, n_pieces, length, bin_id, bin_capacity, bin_used, place`` for every piece of every row.

    A document longer than the largest capacity becomes full pieces of that length and a rest;
    nothing is dropped or cut off. Lengths that are null or not positive are empty pieces with
    no bin. Bin ids are unique over all groups. Equal lengths of a group are packed in order of ids;
    rows of a repeated id are packed each. Which pieces share a group follows from how Spark
    splits the rows. Further columns are ignored; an empty table gives no rows.
    """
    largest = max(capacities)
    capacities = tuple(sorted(capacities))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.greatest(F.coalesce(length.cast("long"), F.lit(0)), F.lit(0)).alias("total"))
    n_pieces = F.greatest(F.ceil(F.col("total") / largest), F.lit(1))
    pieces = rows.withColumn("n_pieces", n_pieces).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_pieces") - 1))).select(
        "id", "piece", "n_pieces", F.least(F.lit(largest), F.col("total") - F.col("piece") * largest).alias("length"))
    # Equal rows differ by their numbers alone; those are written out, so that all retries see the same.
    return _packed(cut(pieces.withColumn("row", F.monotonically_increasing_id())), capacities, group_size)


def _packed(pieces: DataFrame, capacities: tuple[int, ...], group_size: int) -> DataFrame:
    groups = max(1, math.ceil(pieces.count() / group_size))
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups))).drop("row")

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("id", "ascending"), ("piece", "ascending")])
        sizes = table.column("length").to_pylist()
        real = sum(x > 0 for x in sizes)
        bins, places, final, used = pack_sizes(sizes[:real], capacities)
        base = (table.column("group")[0].as_py() + 1) << 32
        none = [None] * (len(sizes) - real)
        return pa.table({
            "id": table.column("id"), "piece": table.column("piece"), "n_pieces": table.column("n_pieces"), "length": table.column("length"),
            "bin_id": pa.array([base + b for b in bins] + none, pa.int64()), "bin_capacity": pa.array([final[b] for b in bins] + none, pa.int64()),
            "bin_used": pa.array([used[b] for b in bins] + none, pa.int64()), "place": pa.array(places + none, pa.int64())})

    return dealt.groupBy("group").applyInArrow(
        fill, "id long, piece long, n_pieces long, length long, bin_id long, bin_capacity long, bin_used long, place long")


def pack_tokens(spark: SparkSession, tokens: str, out: str, capacities: tuple[int, ...] = CAPACITIES, group_size: int = GROUP) -> None:
    """Packs the documents of token files into sequences of ids and writes them to ``out``.

    A row is a sequence: ``bin_id, bin_capacity, bin_used``, its ``ids`` side by side, and for each
    piece in ``parts`` the document's id, its first id's place in the whole stream (which tells
    documents of one id apart), the piece's number, its place in the sequence and its length.
    """
    # Documents are known by where they start; written out, as sizes and ids are read apart.
    docs = cut(read_documents(spark, tokens))
    pieces = pack(docs, "start", F.col("n_tokens"), capacities, group_size)
    largest = max(capacities)
    own = pieces.join(docs.select(F.col("start").alias("id"), "doc_id", "ids"), "id").select(
        "bin_id", "bin_capacity", "bin_used",
        F.struct("place", "doc_id", F.col("id").alias("start"), "piece", "length", F.slice(
            "ids", (F.col("piece") * largest + 1).cast("int"), F.col("length").cast("int")).alias("ids")).alias("p"))
    # A sequence holds no more than the largest capacity.
    bins = own.groupBy("bin_id", "bin_capacity", "bin_used").agg(F.sort_array(F.collect_list("p")).alias("p"))
    bins.select(
        "bin_id", "bin_capacity", "bin_used", F.flatten("p.ids").alias("ids"),
        F.transform("p", lambda p: F.struct(p["doc_id"], p["start"], p["piece"], p["place"], p["length"])).alias("parts"),
    ).write.parquet(out)


def unpack_tokens(spark: SparkSession, packed: str) -> DataFrame:
    """``doc_id, start, ids`` of every document of packed sequences."""
    rows = spark.read.parquet(packed)
    each = rows.select("ids", F.explode("parts").alias("p")).select(
        "p.doc_id", "p.start", "p.piece", F.slice("ids", (F.col("p.place") + 1).cast("int"), F.col("p.length").cast("int")).alias("ids"))
    joined = each.groupBy("doc_id", "start").agg(F.sort_array(F.collect_list(F.struct("piece", "ids"))).alias("own"))
    return joined.select("doc_id", "start", F.flatten("own.ids").alias("ids"))


def word_count(text: Column) -> Column:
    """Words between white space, and one for the end mark; the length used where no tokens are at hand."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "x")
    return F.length(F.regexp_replace(plain, r"[\x20\x09-\x0D]+", "")) + 1
