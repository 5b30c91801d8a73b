"""Exact top-k inner products by tiled matrix products.

Vectors are packed into shards and queries into blocks, one Parquet row each. Shards stay where
they are: a round broadcasts query blocks of bounded size, and every shard of a task meets each of
them in a tile, one matrix product and a partial selection per query. A task merges the lists of
its own shards; lists of tasks are merged in a tree, a few at a time, so no task holds all lists of
a query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reliefgrid.llm.centroids import from_bytes, to_bytes, whole_numbers
from reliefgrid.session import cut

SHARD = 4096
QUERY_BLOCK = 1024
#: Bytes of query blocks that a round broadcasts, about.
ROUND_BYTES = 32 << 20
FAN = 8
_PACK = pa.schema([("dim", pa.int32()), ("part", pa.int64()), ("ids", pa.binary()), ("width", pa.int32()), ("vectors", pa.binary())])
_LISTS = "block long, dim int, shard long, queries binary, ids binary, width int, scores binary"


def _whole(payload: bytes, rows: int, width: int) -> np.ndarray:
    """The matrix that ``_payload`` wrote: longs, or Python integers where those need more than eight bytes."""
    if not rows or not payload:
        return np.zeros((rows, 0), np.int64)
    if width <= 8:
        return np.frombuffer(payload, np.dtype(f"<i{width}")).reshape(rows, -1)
    step = len(payload) // rows
    return from_bytes([payload[i:i + step] for i in range(0, len(payload), step)], step // width)[0][1]


def _payload(matrix: np.ndarray) -> tuple[int, bytes]:
    """Bytes of a component and all components, row by row."""
    if not matrix.size:
        return 8, b""
    if matrix.dtype == object and max(abs(x) for x in matrix.ravel()) < 1 << 62:
        matrix = matrix.astype(np.int64)
    [flat] = to_bytes(matrix.reshape(1, -1))
    return len(flat) // matrix.size, flat


def _packed(batches, rows: int, scale: int) -> Iterator[pa.RecordBatch]:
    """Vectors of one length as whole numbers, packed into rows of about ``rows``."""
    waiting: dict[int, list] = {}
    task, made = TaskContext.get().partitionId(), 0

    def row(dim: int) -> pa.RecordBatch:
        nonlocal made
        made += 1
        ids, vectors = zip(*waiting.pop(dim))
        matrix = np.zeros((len(ids), dim), np.int64)
        groups = whole_numbers(np.array(vectors, np.float64), scale, dim) if dim else []
        if any(m.dtype == object for _, m in groups):
            matrix = matrix.astype(object)
        for at, m in groups:
            matrix[at] = m
        width, flat = _payload(matrix)
        return pa.RecordBatch.from_pylist([{"dim": dim, "part": (task << 32) + made, "ids": np.array(ids, np.int64).tobytes(),
                                            "width": width, "vectors": flat}], schema=_PACK)

    for batch in batches:
        for key, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            waiting.setdefault(len(vector), []).append((key, vector))
            if len(waiting[len(vector)]) == rows:
                yield row(len(vector))
    for dim in list(waiting):
        yield row(dim)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` highest scores of each row, ties to smaller ids."""
    if scores.dtype == object:
        # Their ranks order Python integers as they are.
        values, place = np.unique(scores, return_inverse=True)
        ids, place = _best(ids, place.reshape(scores.shape).astype(np.int64), k)
        return ids, values[place]
    n = scores.shape[1]
    if n > 4 * k:
        # Keep all that reach the k-th score, so ties at the edge are ordered by id below.
        edge = np.partition(scores, n - k, axis=1)[:, n - k, None]
        keep = scores >= edge
        most = int(keep.sum(axis=1).max())
        columns = np.argsort(~keep, axis=1, kind="stable")[:, :most]
        ids, scores = np.take_along_axis(ids, columns, 1), np.take_along_axis(scores, columns, 1)
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)


#: The score of a query with itself, below all others; more than eight bytes need the second one.
_NONE = -(1 << 63) + 1
_WIDE_NONE = -(1 << 5000)


def _tile(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows, in floats where those cannot round."""
    top = [max((abs(int(x)) for x in (m.max(initial=0), m.min(initial=0))), default=0) if m.dtype != object else max(abs(x) for x in m.ravel()) for m in (left, right)]
    largest = top[0] * top[1] * max(1, left.shape[1])
    exact = np.float32 if largest < 1 << 24 else np.float64 if largest < 1 << 53 else np.int64 if largest < 1 << 62 else object
    scores = left.astype(exact) @ right.T.astype(exact)
    return scores if exact is object else scores.astype(np.int64)


def _joined(ids: list[np.ndarray], scores: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """One list for each query from several."""
    if any(s.dtype == object for s in scores):
        scores = [np.where(s == _NONE, _WIDE_NONE, s.astype(object)) for s in scores]
    both, all_scores = np.concatenate(ids, axis=1), np.concatenate(scores, axis=1)
    return _best(both, all_scores, min(k, both.shape[1]))


def _list_row(block: int, dim: int, shard: int, qids: bytes, ids: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    width, flat = (8, scores.astype("<i8").tobytes()) if scores.dtype != object else _payload(scores)
    if width < 8:
        width, flat = 8, scores.astype(np.int64).astype("<i8").tobytes()
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary())
    values = (block, dim, shard, qids, ids.astype(np.int64).tobytes(), width, flat)
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, kinds)], [x.split()[0] for x in _LISTS.split(", ")])


def _tiles(batches, k: int) -> Iterator[pa.RecordBatch]:
    """A list for each query block over all shards of a task."""
    held: dict[tuple[int, int], list] = {}
    for batch in batches:
        for block, dim, shard, qids, q_width, queries, vids, v_width, vectors in zip(*(batch.column(i).to_pylist() for i in range(9))):
            q, v = np.frombuffer(qids, np.int64), np.frombuffer(vids, np.int64)
            left, right = _whole(queries, len(q), q_width), _whole(vectors, len(v), v_width)
            found_ids, found = [], []
            for low in range(0, len(q), 128):
                scores = _tile(left[low:low + 128], right)
                scores[q[low:low + 128, None] == v[None, :]] = _NONE if scores.dtype != object else _WIDE_NONE
                ids, best = _best(np.broadcast_to(v, scores.shape), scores, min(k, len(v)))
                found_ids.append(ids)
                found.append(best)
            if any(s.dtype == object for s in found):
                found = [np.where(s == _NONE, _WIDE_NONE, s.astype(object)) for s in found]
            ids, scores = np.concatenate(found_ids), np.concatenate(found)
            if (block, dim) in held:
                _, _, old_ids, old = held[block, dim]
                ids, scores = _joined([old_ids, ids], [old, scores], k)
            held[block, dim] = [shard, qids, ids, scores]
    for (block, dim), (shard, qids, ids, scores) in held.items():
        yield _list_row(block, dim, shard, qids, ids, scores)


def _merge(table: pa.Table, k: int) -> pa.Table:
    rows = table.to_pylist()
    n = len(rows[0]["queries"]) // 8
    ids = [np.frombuffer(r["ids"], np.int64).reshape(n, -1) for r in rows]
    ids, scores = _joined(ids, [_whole(r["scores"], n, r["width"]) for r in rows], k)
    return pa.Table.from_batches([_list_row(rows[0]["block"], rows[0]["dim"], min(r["shard"] for r in rows), rows[0]["queries"], ids, scores)])


def _ranked(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for qids, ids, width, scores in zip(*(batch.column(i).to_pylist() for i in range(4))):
            q = np.frombuffer(qids, np.int64)
            ids = np.frombuffer(ids, np.int64).reshape(len(q), -1)
            scores = _whole(scores, len(q), width)
            real = scores != (_NONE if scores.dtype != object else _WIDE_NONE)
            rank = np.cumsum(real, axis=1)
            shown = [x if abs(x) < 1 << 63 else None for x in scores[real].tolist()]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(q, real.sum(axis=1))), pa.array(rank[real].astype(np.int32)), pa.array(ids[real]), pa.array(shown, pa.int64()),
            ], ["query_id", "rank", "id", "score"])


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """``query_id, rank, id, score``: the ``k`` largest integer inner products of each query.

    Components become ``floor(scale * x)`` with x as double, of any finite size. Candidates are all
    vectors of the query's length whose id is not the query's; with fewer than ``k`` all are
    returned. Ties go to smaller ids. Rows without id or vector, or with a null or non-finite
    component, take no part. A score that no long holds is ranked exactly and shown as null. A
    repeated query row is answered once for each row. Further columns are ignored; empty tables
    give no rows.
    """
    def clean(df: DataFrame) -> DataFrame:
        fine = F.forall(F.col(vector_col), lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
        return df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & fine).select(
            F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))

    schema = "dim int, part long, ids binary, width int, vectors binary"
    shards = cut(clean(vectors).mapInArrow(partial(_packed, rows=SHARD, scale=scale), schema))
    asked = clean(queries)
    blocks = asked.repartition(max(1, -(-asked.count() // QUERY_BLOCK)), "id").mapInArrow(partial(_packed, rows=QUERY_BLOCK, scale=scale), schema)
    return _answered(cut(blocks), shards, k)


def _answered(blocks: DataFrame, shards: DataFrame, k: int) -> DataFrame:
    """Tiles in rounds of query blocks, then merges up the tree."""
    # A few numbers for each block, a thousandth of the queries.
    sizes = blocks.select("dim", "part", (F.length("vectors") + F.length("ids")).cast("long").alias("bytes"))
    so_far = F.sum("bytes").over(Window.orderBy("dim", "part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("bytes")
    numbered = cut(blocks.join(sizes.select("dim", "part", F.floor(so_far / ROUND_BYTES).cast("int").alias("round")), ["dim", "part"]))
    rounds = numbered.agg(F.max("round")).head()[0]
    given = shards.select(F.col("dim").alias("d"), F.col("part").alias("shard"), F.col("ids").alias("vids"), F.col("width").alias("v_width"), "vectors")

    def merge(table: pa.Table) -> pa.Table:
        return _merge(table.drop_columns(["group"]), k)

    found = None
    for r in range((rounds or 0) + 1):
        own = numbered.where(F.col("round") == r).select(
            F.col("part").alias("block"), "dim", F.col("ids").alias("qids"), F.col("width").alias("q_width"), F.col("vectors").alias("queries"))
        # A round holds ROUND_BYTES and one block more at most.
        met = given.join(F.broadcast(own), F.col("d") == F.col("dim"))
        tiles = met.select("block", "dim", "shard", "qids", "q_width", "queries", "vids", "v_width", "vectors")
        lists = cut(tiles.mapInArrow(partial(_tiles, k=k), _LISTS))
        left = lists.agg(F.countDistinct("shard")).head()[0]
        while left > 1:
            groups = math.ceil(left / FAN)
            keyed = lists.withColumn("group", F.pmod(F.xxhash64("shard"), F.lit(groups)))
            lists = keyed.groupBy("block", "dim", "group").applyInArrow(merge, _LISTS)
            left = groups
        found = lists if found is None else found.union(lists)
    return found.select("queries", "ids", "width", "scores").mapInArrow(_ranked, "query_id long, rank int, id long, score long")
