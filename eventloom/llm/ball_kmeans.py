"""Centroid clustering: ball k-means, exact in whole numbers.

A cluster is a ball: its centroid and the largest distance of a member. When centroids
have moved, only clusters near enough to a ball can take members from it: by the
triangle inequality a member at distance d of its centroid stays if 2 d is less than
the distance to the next centroid. So each ball has a stable core, whose members are
compared with nothing, and annuli around it, whose members are compared exactly with the
neighbours that reach so far, nearest first. A ball that did not move, beside
neighbours that did not, keeps its members and their distances unseen.

Vectors are whole numbers floor(scale * x), so distances, sums and ties are exact and do
not depend on how Spark splits the work. Each round is one pass that writes vector,
cluster and distance, and one aggregation; only the centroids, ``k`` of them, reach the
driver. Where a state table is lost or a task fails, Spark repeats from the last one.

Defined cases:

* vectors of another length, null, or with a null or non-finite component are left out;
* with fewer kept vectors than ``k`` there are as many clusters as vectors; with none,
  the result is empty;
* equal distances go to the smaller cluster number; rows repeating a vec_id or a vector
  are clustered each for itself, and as starts are ordered by their components;
* a null vec_id counts as the empty string in the hash that chooses the starts;
* a component beyond 2^27 after scaling raises an error: squared distances would not fit
  a long; other columns are never looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.llm.common import arrow_rows, discard, keep

#: Up to this size of components all sums of squares are exact in doubles; up to the second, in 64-bit integers.
_EXACT_DOUBLE = 1 << 21
_MOST = 1 << 27


@dataclass(frozen=True)
class Balls:
    """What a task needs of one round: centroids, who moved, and per ball its neighbours, nearest first."""

    centroids: list[list[int]]
    moved: list[bool]
    neighbours: list[list[tuple[int, int]]]

    @staticmethod
    def first(centroids: list[list[int]]) -> Balls:
        return Balls(centroids, [True] * len(centroids), [[] for _ in centroids])

    def after(self, centroids: list[list[int]], radius: dict[int, int]) -> Balls:
        """The balls around new centroids. ``radius``: squared, around the present ones."""
        shift = [_squared(a, b) for a, b in zip(self.centroids, centroids, strict=True)]
        neighbours = []
        for i, c in enumerate(centroids):
            reach = math.isqrt(radius.get(i, 0)) + math.isqrt(shift[i]) + 2
            apart = sorted((_squared(c, other), j) for j, other in enumerate(centroids) if j != i)
            neighbours.append([(j, d) for d, j in apart if d <= 4 * reach * reach] if i in radius else [])
        return Balls(centroids, [s > 0 for s in shift], neighbours)


def _squared(a: list[int], b: list[int]) -> int:
    return sum((x - y) * (x - y) for x, y in zip(a, b, strict=True))


def _distances(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    d = x - centroid
    return np.einsum("ij,ij->i", d, d).astype(np.int64)


def _moved_members(x: np.ndarray, cluster: np.ndarray, distance: np.ndarray, balls: Balls) -> tuple[np.ndarray, np.ndarray]:
    """Clusters and distances under new centroids; ``cluster`` is -1 where there is none yet."""
    centroids = np.array(balls.centroids, x.dtype)
    new, best = cluster.copy(), distance.copy()
    fresh = np.flatnonzero(cluster < 0)
    for j in range(len(centroids)) if fresh.size else ():
        d = _distances(x[fresh], centroids[j])
        nearer = (new[fresh] < 0) | (d < best[fresh])
        new[fresh[nearer]], best[fresh[nearer]] = j, d[nearer]
    for i, near in enumerate(balls.neighbours):
        if not (balls.moved[i] or any(balls.moved[j] for j, _ in near)):
            continue  # the ball and all around it are where they were
        members = np.flatnonzero(cluster == i)
        if not members.size:
            continue
        own = _distances(x[members], centroids[i]) if balls.moved[i] else distance[members]
        best[members] = own
        for j, apart in near:
            annulus = members[own >= (apart + 3) // 4]
            if not annulus.size:
                break  # stable core; neighbours farther off reach no one either
            d = _distances(x[annulus], centroids[j])
            nearer = (d < best[annulus]) | ((d == best[annulus]) & (j < new[annulus]))
            new[annulus[nearer]], best[annulus[nearer]] = j, d[nearer]
    return new, best


def _round(balls: Balls, dims: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            x = np.floor(values.astype(np.float64) * scale).reshape(-1, dims)
            largest = max([np.abs(x).max(initial=0), *(abs(v) for c in balls.centroids for v in c)])
            if largest > _MOST:
                raise ValueError(f"a component of {largest:.0f} after scaling is beyond {_MOST}")
            if largest > _EXACT_DOUBLE:
                x = x.astype(np.int64)
            cluster, distance = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
            new, best = _moved_members(x, cluster, distance, balls)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(new, pa.int32()), pa.array(best, pa.int64())], batch.schema.names)

    return run


def usable(vectors: DataFrame, dims: int) -> DataFrame:
    """(vec_id, embedding) of the vectors that take part."""
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    element = vectors.schema["embedding"].dataType.elementType
    values = F.col("embedding") if isinstance(element, T.FloatType | T.DoubleType) else F.col("embedding").cast("array<double>")
    return vectors.select("vec_id", values.alias("embedding")).filter(F.coalesce((F.size("embedding") == dims) & finite, F.lit(False)))


def _component(i: int, scale: int) -> Column:
    return F.floor(F.col("embedding")[i].cast("double") * scale).cast("long")


def _starts(kept: DataFrame, k: int, dims: int, scale: int, seed: int) -> list[list[int]]:
    """The ``k`` vectors with the smallest hashes of seed and id."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    whole = F.array(*[_component(i, scale) for i in range(dims)])
    return [r["v"] for r in kept.select(drawn.alias("h"), whole.alias("v")).orderBy("h", "v").limit(k).collect()]


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3, batch_rows: int = 2_000) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    ``rounds`` times every vector goes to its nearest centroid and every non-empty
    centroid to the floor of its vectors' mean; then vectors are assigned once more.
    """
    spark = vectors.sparkSession
    state = keep(usable(vectors, dims).select("vec_id", "embedding", F.lit(-1).alias("cluster"), F.lit(0).cast("long").alias("distance")), "ball-vectors")
    centroids = _starts(state, k, dims, scale, seed)
    balls = Balls.first(centroids)
    for r in range(rounds + 1):
        with arrow_rows(spark, batch_rows):
            moved = keep(state.mapInArrow(_round(balls, dims, scale), state.schema), "ball-state")
        discard(state)
        state = moved
        if r < rounds:
            sums = [F.sum(_component(i, scale)).alias(f"s{i}") for i in range(dims)]
            found = {row["cluster"]: row for row in state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("far"), *sums).collect()}
            centroids = [[found[i][f"s{d}"] // found[i]["n"] for d in range(dims)] if i in found else c for i, c in enumerate(balls.centroids)]
            balls = balls.after(centroids, {i: row["far"] for i, row in found.items()})
    inertia = {row["cluster"]: row["d"] for row in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("d")).collect()}
    named = [(i, int(inertia.get(i, 0)), int(sum(inertia.values())), ",".join(map(str, c))) for i, c in enumerate(balls.centroids)]
    of_cluster = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, components string")  # k rows
    return state.join(F.broadcast(of_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2("components", 256).alias("centroid_sha256"))
