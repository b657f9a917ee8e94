"""Centroid clustering by sort-means over integer vectors.

Vectors are turned into integers once, so that sums, distances and ties are exact whatever the partitioning. In each
round every centroid has the others in order of their distance from it. A vector starts at the centroid it was
assigned to before and looks at that centroid's list; once the next one is strictly farther from the starting centroid
than twice the vector's own distance to it, no later one can win or tie (triangle inequality), and the scan ends.

The vectors with their clusters are a table that each round reads and writes; only sums for each cluster and component
reach the driver, k * dims rows at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import Scratch, tidy

#: Integer components lie below this in absolute value, so that a squared distance and a task's sums fit 64 bits.
COMPONENT_BOUND = 1 << 27
#: Vectors that one numpy step works on.
STEP_ROWS = 1 << 14
ROWS = "vec_id long, vector array<int>, cluster int"
ASSIGNED = ROWS + ", distance long"


@dataclass(frozen=True)
class Clustering:
    """assigned: vec_id, vector (its integers), cluster, distance (squared) for each kept vector; centroids in their order."""

    assigned: DataFrame
    centroids: list[list[int]]


def as_integers(vectors: DataFrame, dims: int, scale: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, vector, cluster 0) of the vectors with exactly `dims` components, none of them null, NaN or infinite; a component x is
    floor(scale * x). Components of COMPONENT_BOUND or more in absolute value are an error, as 64-bit distances can't hold them."""

    @tidy
    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1)
            kept = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(vectors), dims), False))
            flat = pc.list_flatten(kept.column(1))
            x = np.asarray(pc.fill_null(flat, np.nan).to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dims)
            fine = np.isfinite(x).all(axis=1)
            units = np.floor(scale * x[fine])
            if (np.abs(units) >= COMPONENT_BOUND).any():
                raise ValueError(f"a component times {scale} reaches {COMPONENT_BOUND}")
            ids = kept.column(0).filter(pa.array(fine))
            yield _rows(ids, units.astype(np.int32), np.zeros(len(ids), dtype=np.int32))

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return rows.mapInArrow(turn, ROWS)


def _rows(ids: pa.Array, x: np.ndarray, cluster: np.ndarray, distance: np.ndarray | None = None) -> pa.RecordBatch:
    offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * np.int32(x.shape[1]))
    columns = [ids, pa.ListArray.from_arrays(offsets, pa.array(x.reshape(-1))), pa.array(cluster)]
    names = ["vec_id", "vector", "cluster"]
    return pa.RecordBatch.from_arrays(columns + ([] if distance is None else [pa.array(distance)]), names=names + ([] if distance is None else ["distance"]))


def first_centroids(rows: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors with the smallest sha256 of `seed:id`, in that order; equal ids follow their components, vectors without an id come last."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [list(r.vector) for r in rows.select("vector", order.alias("h")).orderBy(F.col("h").asc_nulls_last(), "vector").limit(k).collect()]


def neighbours(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each centroid all centroids by distance from it, itself first, and those squared distances."""
    apart = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
    np.fill_diagonal(apart, -1)  # itself before others at distance 0
    order = np.argsort(apart, axis=1, kind="stable")
    np.fill_diagonal(apart, 0)
    return order, np.take_along_axis(apart, order, axis=1)


def nearest(x: np.ndarray, before: np.ndarray, centroids: np.ndarray, order: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row of x (ties: the smaller number) and its squared distance, scanning from the centroid before."""
    own = ((x - centroids[before]) ** 2).sum(axis=1)
    best, least = before.astype(np.int64), own.copy()
    open_ = np.arange(len(x))
    for step in range(1, len(centroids)):
        # strictly beyond twice the distance ends the scan; distances are squared, hence four times
        open_ = open_[apart[before[open_], step] <= 4 * own[open_]]
        if not len(open_):
            break
        other = order[before[open_], step]
        d = ((x[open_] - centroids[other]) ** 2).sum(axis=1)
        better = (d < least[open_]) | ((d == least[open_]) & (other < best[open_]))
        at = open_[better]
        best[at], least[at] = other[better], d[better]
    return best, least


def _assign(centroids: list[list[int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    points = np.array(centroids, dtype=np.int64)
    order, apart = neighbours(points)

    @tidy
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, STEP_ROWS):
                part = batch.slice(a, STEP_ROWS)
                x = _matrix(part.column(1), points.shape[1])
                best, least = nearest(x.astype(np.int64), np.asarray(part.column(2)), points, order, apart)
                yield _rows(part.column(0), x, best.astype(np.int32), least)

    return assign


def _matrix(vectors: pa.ListArray, dims: int) -> np.ndarray:
    return np.asarray(pc.list_flatten(vectors)).reshape(-1, dims)


def _sums(rows: DataFrame, dims: int) -> dict[int, tuple[int, list[int]]]:
    """Exact count and componentwise sums of each cluster. A task adds up its rows before anything is shuffled."""

    @tidy
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            x, cluster = _matrix(batch.column(0), dims), np.asarray(batch.column(1))
            order = np.argsort(cluster, kind="stable")
            present, starts = np.unique(cluster[order], return_index=True)
            for c, sums, n in zip(present, np.add.reduceat(x[order], starts, axis=0, dtype=np.int64), np.diff([*starts, len(x)]), strict=True):
                total[int(c)] = total.get(int(c), 0) + np.append(sums, n)
        flat = [(c, i, int(s)) for c, sums in total.items() for i, s in enumerate(sums)]
        cluster, at, s = zip(*flat, strict=True) if flat else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(cluster, pa.int32()), pa.array(at, pa.int32()), pa.array(s, pa.int64())], names=["cluster", "at", "s"])

    parts = rows.select("vector", "cluster").mapInArrow(add, "cluster int, at int, s long")
    found: dict[int, dict[int, int]] = {}
    for r in parts.groupBy("cluster", "at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():  # k * (dims + 1) rows at most
        found.setdefault(r.cluster, {})[r.at] = int(r.s)
    return {c: (sums[dims], [sums[i] for i in range(dims)]) for c, sums in found.items()}


def sort_means(vectors: DataFrame, *, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding") -> Clustering:
    """Clusters of the vectors that have exactly `dims` finite components, by `rounds` rounds of exact integer k-means and one more assignment.

    A round assigns each vector to the nearest centroid and moves each non-empty centroid to floor(sum / count) of its
    vectors in every component; empty ones stay. Fewer than k vectors give as many centroids; without any, nothing is assigned.
    Rows that repeat an id are vectors of their own; a null id stays null. Further columns are left out.
    """
    tmp = Scratch(vectors.sparkSession, "sort-means")
    rows = tmp.write(as_integers(vectors, dims, scale, id_col, vector_col), "start")
    centroids = first_centroids(rows, k, seed)
    if not centroids:
        return Clustering(rows.withColumn("distance", F.lit(0).cast("long")), [])
    name = "start"
    for i in range(rounds):
        rows = tmp.write(rows.select("vec_id", "vector", "cluster").mapInArrow(_assign(centroids), ASSIGNED), f"round-{i}")
        tmp.drop(name)
        name = f"round-{i}"
        for c, (n, sums) in _sums(rows, dims).items():
            centroids[c] = [s // n for s in sums]
    last = tmp.write(rows.select("vec_id", "vector", "cluster").mapInArrow(_assign(centroids), ASSIGNED), "last")
    tmp.drop(name)
    return Clustering(last, centroids)


def sql(k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1) -> str:
    """The same rows in plain SQL: all distances, one step for each round."""
    floor = "((s - ((s % n) + n) % n) // n)"
    steps = [
        f"""v AS (SELECT vec_id, i, floor({scale} * embedding[i]::DOUBLE)::BIGINT AS x FROM (SELECT vec_id, embedding, unnest(range(1, {dims + 1})) AS i FROM embeddings
    WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0))""",
        f"f AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c FROM (SELECT DISTINCT vec_id FROM v) QUALIFY c < {k})",
        "c0 AS (SELECT c, i, x FROM f JOIN v USING (vec_id))",
    ]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS (SELECT vec_id, arg_min(c, d * {k} + c) AS c, min(d) AS d
    FROM (SELECT v.vec_id, m.c, sum((v.x - m.x) * (v.x - m.x)) AS d FROM v JOIN c{r} m USING (i) GROUP BY v.vec_id, m.c) GROUP BY vec_id)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS (SELECT m.c, m.i, coalesce({floor}, m.x) AS x FROM c{r} m
    LEFT JOIN (SELECT a.c, v.i, sum(v.x) AS s, count(*) AS n FROM v JOIN a{r} a USING (vec_id) GROUP BY a.c, v.i) USING (c, i))""")
    return f"""WITH {', '.join(steps)},
  h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY c)
SELECT vec_id, c::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, h AS centroid_sha256
FROM a{rounds} JOIN h USING (c)"""
