"""Centroid clustering on whole numbers with bounds tightened by the geometry of the drift.

A vector keeps its cluster, and a lower bound of its distance to every other centroid. When
centroids move, the bound of a cluster's members is loosened by no more than what a centroid can
come nearer to any point of the sphere that holds them, which plane geometry bounds below the full
drift. A vector whose own centroid stays nearer than its bound keeps its cluster; all others are
scanned against every centroid. Distances are compared as exact whole numbers, so bounds decide
what is scanned and never what is found.

Each round reads the table of the round before and writes the next one below the shared folder.
Every task adds one short row of exact sums for each cluster, so centroids come from a few rows a
task. Vectors stay where they are; nothing but those sums moves.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reliefgrid.session import cut

#: Sums travel as digits of this many bits, so any magnitude adds up exactly.
DIGIT = 40
_LONG = 1 << 63
_NEAR = 1 + 1e-12
_STATE = pa.schema([
    ("id", pa.int64()), ("parts", pa.binary()), ("cluster", pa.int32()), ("distance", pa.int64()), ("lower", pa.float64()),
    ("scans", pa.int32()), ("radius", pa.float64()), ("sums", pa.list_(pa.int64())),
])
_STATE_SQL = "id long, parts binary, cluster int, distance long, lower double, scans int, radius double, sums array<long>"


def narrow_limit(dims: int) -> int:
    """Components below this have squared distances that fit a long."""
    return math.isqrt((1 << 62) // max(1, dims)) // 2


def whole_numbers(values: np.ndarray, scale: int, dims: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """``floor(scale * x)`` as (row numbers, matrix): longs, and Python integers for rows with larger ones."""
    if not len(values):
        return []
    with np.errstate(over="ignore"):
        scaled = np.floor(values * float(scale))
    wide = (np.abs(scaled) >= narrow_limit(dims)).any(axis=1)
    groups = [(np.flatnonzero(~wide), scaled[~wide].astype(np.int64))]
    if wide.any():
        exact = [[int(x) * scale if abs(x) >= 2.0**52 else math.floor(x * scale) for x in row] for row in values[wide].tolist()]
        groups.append((np.flatnonzero(wide), np.array(exact, object)))
    return [g for g in groups if len(g[0])]


def to_bytes(matrix: np.ndarray) -> list[bytes]:
    """Rows as bytes of the narrowest width; over eight bytes a component for Python integers."""
    if matrix.dtype != object:
        most = int(np.abs(matrix).max(initial=0))
        kind = np.int8 if most < 1 << 7 else np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64
        return [row.tobytes() for row in matrix.astype(kind)]
    out = []
    for row in matrix.tolist():
        width = max(9, 1 + max(abs(x).bit_length() for x in row) // 8)
        out.append(b"".join(x.to_bytes(width, "little", signed=True) for x in row))
    return out


def from_bytes(parts: list[bytes], dims: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The inverse of ``to_bytes`` for rows of mixed widths, as (row numbers, matrix)."""
    widths = np.array([len(x) // dims for x in parts])
    out = []
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        if width <= 8:
            flat = np.frombuffer(b"".join([parts[i] for i in rows]), np.dtype(f"<i{width}"))
            out.append((rows, flat.reshape(len(rows), dims).astype(np.int64)))
        else:
            out.append((rows, np.array([
                [int.from_bytes(parts[i][j:j + width], "little", signed=True) for j in range(0, len(parts[i]), width)] for i in rows], object)))
    return out


class Centres:
    """Centroids as Python integers, and as arrays where longs hold them."""

    def __init__(self, rows: list[list[int]]) -> None:
        self.rows = rows
        dims = len(rows[0])
        most = max(abs(x) for row in rows for x in row)
        self.narrow = most < narrow_limit(dims)
        self.matrix = np.array(rows, np.int64 if self.narrow else object)
        #: Beyond this, products of floats would round.
        self.float_limit = math.isqrt((1 << 51) // dims)
        self.small = most < self.float_limit

    def distances(self, matrix: np.ndarray) -> np.ndarray:
        """Exact squared distances of every row to every centroid."""
        if matrix.dtype == object or not self.narrow:
            return np.stack([((matrix.astype(object) - np.array(c, object)) ** 2).sum(axis=1) for c in self.rows], axis=1)
        if self.small and int(np.abs(matrix).max(initial=0)) < self.float_limit:
            own, other = matrix.astype(np.float64), self.matrix.astype(np.float64)
            return ((own**2).sum(axis=1)[:, None] - 2 * own @ other.T + (other**2).sum(axis=1)).astype(np.int64)
        return np.stack([((matrix - c) ** 2).sum(axis=1) for c in self.matrix], axis=1)

    def own_distances(self, matrix: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        if matrix.dtype == object or not self.narrow:
            return ((matrix.astype(object) - np.array(self.rows, object)[cluster]) ** 2).sum(axis=1)
        return ((matrix - self.matrix[cluster]) ** 2).sum(axis=1)


def _root(squares: np.ndarray) -> np.ndarray:
    if squares.dtype != object:
        return np.sqrt(squares.astype(np.float64))
    return np.array([math.sqrt(x) if x < 1 << 1000 else math.inf for x in squares], np.float64)


def scan(matrix: np.ndarray, centres: Centres) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (ties: the smaller number), its squared distance, and a bound of all others."""
    squares = centres.distances(matrix)
    cluster = np.argmin(squares, axis=1)
    place = np.arange(len(matrix))
    best = squares[place, cluster]
    lower = np.full(len(matrix), math.inf)
    for j in range(squares.shape[1]):
        other = cluster != j
        lower[other] = np.minimum(lower[other], _root(squares[other, j]))
    # Where roots may overflow, no bound is kept and the vector is scanned again.
    lower = np.where(np.isinf(lower) & (squares.shape[1] > 1), -math.inf, lower / _NEAR)
    return cluster.astype(np.int64), best, lower


def drift_bound(centre: np.ndarray, radius: float, before: np.ndarray, after: np.ndarray) -> float:
    """The most by which a centroid that moved can have come nearer to a point of the sphere.

    ``|x - before| - |x - after|`` is at most the drift times the cosine of the angle, at the
    drift's midpoint, between the drift and ``x``: the sum of both distances is at least twice the
    distance from the midpoint. Seen from there, the sphere fills a cone of the angle
    ``asin(radius / distance)`` around its centre, so all happens in the plane of the drift and
    that centre.
    """
    move = after - before
    drift = float(np.sqrt((move**2).sum()))
    if drift == 0:
        return 0.0
    away = centre - (before + after) / 2
    distance = float(np.sqrt((away**2).sum()))
    if not radius < distance:
        return drift * (1 + 1e-9)
    between = math.acos(max(-1.0, min(1.0, float(away @ move) / (distance * drift))))
    cosine = math.cos(max(0.0, between - math.asin(radius / distance)))
    return drift * min(1 + 1e-9, max(0.0, cosine + 1e-7))


def loosening(before: Centres, after: Centres, radius: list[float]) -> list[float]:
    """How much the bound of each cluster's members is loosened by the moves of all other centroids."""
    k = len(before.rows)
    if not (before.narrow and after.narrow):
        return [math.inf] * k
    old, new = before.matrix.astype(np.float64), after.matrix.astype(np.float64)
    return [max((drift_bound(old[i], radius[i], old[j], new[j]) for j in range(k) if j != i), default=0.0) for i in range(k)]


def digits(values: list[int]) -> list[int]:
    """Whole numbers as digits of ``DIGIT`` bits, the lowest ones of all values first; the last is signed."""
    count = 1 + max(abs(x).bit_length() for x in values) // DIGIT
    mask = (1 << DIGIT) - 1
    return [x >> DIGIT * i if i == count - 1 else x >> DIGIT * i & mask for i in range(count) for x in values]


def _step(batches, first: bool, last: bool, centres: list[list[int]], loosen: list[float] | None, dims: int, scale: int) -> Iterator[pa.RecordBatch]:
    """One round over a task's vectors, then a row of sums for each of its clusters."""
    model, k = Centres(centres), len(centres)
    count, inertia, radius = [0] * k, [0] * k, [0.0] * k
    total = np.zeros((k, dims), object)
    slack = np.array(loosen) if loosen is not None else None
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        parts: list[bytes] = [b""] * rows
        cluster, lower, scans = np.zeros(rows, np.int64), np.zeros(rows), np.ones(rows, np.int32)
        distance: list[int | None] = [None] * rows
        if first:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            groups = whole_numbers(flat.reshape(rows, dims), scale, dims)
        else:
            parts = batch.column(1).to_pylist()
            groups = from_bytes(parts, dims)
            held, bound, before = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
        for at, matrix in groups:
            if first:
                own, best, low = scan(matrix, model)
                for i, x in zip(at.tolist(), to_bytes(matrix)):
                    parts[i] = x
            else:
                own, low = held[at].astype(np.int64), bound[at] - slack[held[at]]
                best = model.own_distances(matrix, own)
                unsure = ~(_root(best) * _NEAR < low)
                scans[at] = before[at] + unsure
                if unsure.any():
                    own[unsure], found, low[unsure] = scan(matrix[unsure], model)
                    best = best.astype(found.dtype) if found.dtype == object else best
                    best[unsure] = found
            cluster[at], lower[at] = own, low
            for i, x in zip(at.tolist(), best.tolist()):
                distance[i] = x if x < _LONG else None
            reach = _root(best) * _NEAR
            for c in np.unique(own).tolist():
                mine = own == c
                count[c] += int(mine.sum())
                inertia[c] += sum(best[mine].tolist())
                radius[c] = max(radius[c], float(reach[mine].max()))
                total[c] += matrix[mine].sum(axis=0).astype(object)
        none = pa.nulls(rows)
        yield pa.RecordBatch.from_arrays([
            batch.column(0).cast(pa.int64()), none.cast(pa.binary()) if last else pa.array(parts, pa.binary()), pa.array(cluster.astype(np.int32)),
            pa.array(distance, pa.int64()), pa.array(lower), pa.array(scans), none.cast(pa.float64()), none.cast(_STATE.field("sums").type),
        ], schema=_STATE)
    yield pa.RecordBatch.from_pylist([
        {"cluster": c, "radius": radius[c], "sums": digits([count[c], inertia[c], *total[c].tolist()])} for c in range(k) if count[c]], schema=_STATE)


def _sums(state: DataFrame, k: int, dims: int) -> tuple[list[int], list[int], list[list[int]], list[float]]:
    """Counts, inertias, component sums and radii of the clusters, from the rows that tasks added."""
    width = dims + 2
    rows = (
        state.where("radius is not null").select("cluster", "radius", F.posexplode("sums").alias("place", "digit"))
        .groupBy("cluster", "place").agg(F.sum("digit").alias("digit"), F.max("radius").alias("radius")).collect()
    )
    totals, radius = [[0] * width for _ in range(k)], [0.0] * k
    for row in rows:
        totals[row.cluster][row.place % width] += row.digit << DIGIT * (row.place // width)
        radius[row.cluster] = max(radius[row.cluster], row.radius)
    return [t[0] for t in totals], [t[1] for t in totals], [t[2:] for t in totals], radius


def start_hash(id_col: str, seed: str) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256)


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: str = "1", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Every kept vector's ``id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256, scans``.

    Vectors with exactly ``dims`` components, none null or non-finite, are kept as
    ``floor(scale * x)``. Centroids start as the ``k`` kept vectors (all, if fewer) with the smallest
    hash of seed and id; equal ids go by their components, rows without id come last. Each of
    ``rounds`` rounds assigns every vector to the nearest centroid and moves the centroids that have
    vectors to the floor of their mean; then vectors are assigned once more. ``scans`` counts the
    assignments that met every centroid, from 1 to ``rounds + 1``. Repeated rows and rows without id
    are vectors of their own; further columns are ignored; an empty table gives no rows. Components
    of any finite size are exact; a distance or inertia that no long holds is null.
    """
    x = F.col(vector_col)
    finite = F.forall(x, lambda v: F.coalesce(F.abs(v.cast("double")) < F.lit(float("inf")), F.lit(False)))
    kept = vectors.where((F.size(x) == dims) & finite).select(F.col(id_col).cast("long").alias("id"), x.alias("vector"))
    chosen = kept.orderBy(start_hash("id", seed).asc_nulls_last(), "vector").limit(k).collect()
    schema = f"`{id_col}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, scans int"
    if not chosen:
        return vectors.sparkSession.createDataFrame([], schema)
    centres = []
    for row in chosen:
        [(_, matrix)] = whole_numbers(np.array([row.vector], np.float64), scale, dims)
        centres.append(matrix[0].tolist())
    state, loosen = kept, None
    for i in range(rounds + 1):
        columns = state if i == 0 else state.where("radius is null").select("id", "parts", "cluster", "lower", "scans")
        step = partial(_step, first=i == 0, last=i == rounds, centres=centres, loosen=loosen, dims=dims, scale=scale)
        state = cut(columns.mapInArrow(step, _STATE_SQL))
        counts, inertias, sums, radius = _sums(state, len(centres), dims)
        if i < rounds:
            moved = [[s // n for s in own] if n else old for n, own, old in zip(counts, sums, centres)]
            loosen = loosening(Centres(centres), Centres(moved), radius)
            centres = moved
    whole = sum(inertias)
    stats = vectors.sparkSession.createDataFrame([
        (c, own if own < _LONG else None, whole if whole < _LONG else None, hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest())
        for c, own in enumerate(inertias)], "_cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # One row for each of the k centroids, so the broadcast is bounded.
    found = state.where("radius is null").join(F.broadcast(stats), F.col("cluster") == F.col("_cluster"))
    return found.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "scans")
