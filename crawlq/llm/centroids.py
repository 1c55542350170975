"""Centroid clustering of integer vectors, with centroids filtered by n-simplex bounds.

A few pivots span a simplex. The distances of a vector to all pivots make it the apex of a larger simplex over that base,
and the coordinates of the apex are computed once per vector and stored with it. For any two points, the Euclidean distance of
their apexes bounds their true distance from below; with the last coordinate of one apex mirrored, from above. Each round
computes the apexes of the centroids alone, drops every centroid whose lower bound lies beyond the smallest upper bound, and compares those left
exactly, in whole numbers. The bounds are close while the centroids stay near the span of the pivots; where they have drifted from it, pivots are taken anew from
the centroids and the distances cached again. That changes how many comparisons are made, never a result.

A round is one pass over the stored vectors. Tasks send one row per cluster and component: sums that were combined before they move,
so a cluster with a third of the vectors costs no task more than another. The driver holds the centroids, `k` rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlq.llm.common import stored

DIMENSIONS = 64
SCALE = 256
CLUSTERS = 40
ROUNDS = 5
PIVOTS = 40
#: Mean altitude of the centroids over the pivots, as a share of the mean distance between centroids, at which pivots are taken anew.
DRIFT = 0.15
SEED = "2"
#: Largest component that keeps squared distances of 64 components inside 64 bits.
LARGEST = 1 << 27
#: Rows whose bounds are held at a time, and (vector, centroid) pairs compared at a time.
BLOCK = 4096
PAIRS = 1 << 15
#: What rounding to 32 bits may take from a bound, as a share of the squares that went into it.
SLACK = 1e-5


def quantised(table: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, v (whole numbers): the vectors with exactly `dimensions` finite components; all others are left out."""
    rows = table.select(table[vec_id].alias("vec_id"), table[vector].cast("array<double>").alias("x"))
    whole = f"size(x) = {dimensions} AND forall(x, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('Infinity'))"
    return rows.where(f"coalesce({whole}, false)").select("vec_id", F.expr(f"transform(x, c -> CAST(floor({scale}D * c) AS BIGINT))").alias("v"))


def starts(vectors: DataFrame, k: int = CLUSTERS, seed: str = SEED) -> np.ndarray:
    """The `k` vectors with the smallest hash of `seed:vec_id`; a null id is the text after the colon being empty, equal ids go by components."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = vectors.select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()
    return np.array([r["v"] for r in first], dtype=np.int64)


class Simplex:
    """The base simplex over pivots chosen from `points`, and apex coordinates over it."""

    def __init__(self, points: np.ndarray, most: int = PIVOTS):
        points = points.astype(np.float64)
        chosen, coordinates = [0], np.zeros((0, 0))
        altitude = np.sqrt(((points - points[0]) ** 2).sum(axis=1))
        scale = float(altitude.max())
        # Each further pivot is the point that stands highest over the simplex so far.
        while len(chosen) < min(most, len(points)) and altitude.max() > 1e-6 * max(scale, 1.0):
            following = int(altitude.argmax())
            apex = self._apex(points[chosen], coordinates, points[[following]])[0]
            wider = np.zeros((len(chosen), len(chosen)))
            wider[:-1, :-1] = coordinates
            wider[-1] = apex
            coordinates = wider
            chosen.append(following)
            altitude = self._apex(points[chosen], coordinates, points)[:, -1]
            altitude[chosen] = 0
        self.pivots, self.coordinates = points[chosen], coordinates

    @staticmethod
    def _apex(pivots: np.ndarray, coordinates: np.ndarray, points: np.ndarray) -> np.ndarray:
        """Coordinates of the apex each point makes; the last one is its altitude, never negative."""
        squares = np.stack([((points - p) ** 2).sum(axis=1) for p in pivots], axis=1)
        if len(pivots) == 1:
            return np.sqrt(squares)
        right = ((coordinates**2).sum(axis=1) + squares[:, :1] - squares[:, 1:]) / 2
        inside = np.linalg.solve(coordinates, right.T).T
        height = np.sqrt(np.maximum(squares[:, 0] - (inside**2).sum(axis=1), 0))
        return np.concatenate([inside, height[:, None]], axis=1)

    def apex(self, points: np.ndarray) -> np.ndarray:
        return self._apex(self.pivots, self.coordinates, points.astype(np.float64))

    def drift(self, centroids: np.ndarray) -> float:
        """How far the centroids stand off the span of the pivots, measured by their own distances."""
        points = centroids.astype(np.float64)
        squares = (points**2).sum(axis=1)
        apart = np.sqrt(np.maximum(squares[:, None] + squares[None] - 2 * points @ points.T, 0))
        return float(self.apex(centroids)[:, -1].mean() / apart.mean()) if apart.any() else 0.0


def candidates(apexes: np.ndarray, centroid_apexes: np.ndarray) -> np.ndarray:
    """For every vector and centroid: can the centroid be the nearest, going by the bounds."""
    a, c = apexes[:, :-1], centroid_apexes[:, :-1]
    flat = (a**2).sum(axis=1)[:, None] + (c**2).sum(axis=1)[None] - 2 * a @ c.T
    ha, hc = apexes[:, -1][:, None], centroid_apexes[:, -1][None]
    size = (apexes**2).sum(axis=1)[:, None] + (centroid_apexes**2).sum(axis=1)[None]
    slack = SLACK * (size + 1)
    upper = (flat + (ha + hc) ** 2 + slack).min(axis=1)
    return flat + (ha - hc) ** 2 - slack <= upper[:, None]


def nearest(vectors: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, centroid_apexes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid, ties to the smaller number, and the squared distance, exact."""
    cluster, distance = np.empty(len(vectors), np.int64), np.empty(len(vectors), np.int64)
    for at in range(0, len(vectors), BLOCK):
        block = vectors[at : at + BLOCK]
        row, centroid = np.nonzero(candidates(apexes[at : at + BLOCK], centroid_apexes))
        exact = np.empty(len(row), np.int64)
        for i in range(0, len(row), PAIRS):
            part = slice(i, i + PAIRS)
            exact[part] = ((block[row[part]] - centroids[centroid[part]]) ** 2).sum(axis=1)
        # Pairs come by row and then by centroid, and the sort is stable, so the first of a row is the answer.
        order = np.lexsort((exact, row))
        first = np.flatnonzero(np.diff(row[order], prepend=-1))
        cluster[at : at + BLOCK], distance[at : at + BLOCK] = centroid[order][first], exact[order][first]
    return cluster, distance


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def with_apexes(vectors: DataFrame, simplex: Simplex, dimensions: int = DIMENSIONS) -> DataFrame:
    """Adds `apex`. A component beyond LARGEST raises: its squares would not fit the distance's type."""
    id_type = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column("v"), dimensions)
            if len(v) and (v.max() > LARGEST or v.min() < -LARGEST):
                raise ValueError(f"a component lies beyond {LARGEST}")
            apex = simplex.apex(v)
            offsets = np.arange(len(v) + 1, dtype=np.int32) * apex.shape[1]
            made = pa.ListArray.from_arrays(pa.array(offsets), pa.array(apex.astype(np.float32).reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), made], ["vec_id", "v", "apex"])

    return vectors.mapInArrow(run, f"vec_id {id_type}, v array<bigint>, apex array<float>")


def _assigned(batch: pa.RecordBatch, centroids: np.ndarray, simplex: Simplex) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    v = _matrix(batch.column("v"), centroids.shape[1])
    cluster, distance = nearest(v, _matrix(batch.column("apex"), len(simplex.pivots)).astype(np.float64), centroids, simplex.apex(centroids))
    return v, cluster, distance


def moved(vectors: DataFrame, centroids: np.ndarray, simplex: Simplex) -> np.ndarray:
    """The centroids after one round: floors of the means; a centroid without vectors stays."""
    k, width = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            v, cluster, _ = _assigned(batch, centroids, simplex)
            for c in np.unique(cluster):
                own = v[cluster == c]
                sums[c] += own.sum(axis=0)
                counts[c] += len(own)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(held, width)), pa.array(np.tile(np.arange(width), len(held))), pa.array(sums[held].reshape(-1)), pa.array(np.repeat(counts[held], width))],
            ["cluster", "component", "total", "n"],
        )

    parts = vectors.mapInArrow(run, "cluster bigint, component bigint, total bigint, n bigint")
    whole = parts.groupBy("cluster", "component").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
    after = centroids.copy()
    for r in whole:
        after[r["cluster"], r["component"]] = r["total"] // r["n"]
    return after


def assigned(vectors: DataFrame, centroids: np.ndarray, simplex: Simplex) -> DataFrame:
    """vec_id, cluster, distance."""
    id_type = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, cluster, distance = _assigned(batch, centroids, simplex)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"]
            )

    return vectors.mapInArrow(run, f"vec_id {id_type}, cluster int, distance bigint")


def clusters(
    table: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, pivots: int = PIVOTS, dimensions: int = DIMENSIONS, vec_id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors that are null, have another number of components, or a null, NaN or infinite one are left out. Repeated rows count as often as
    they come. Fewer than `k` vectors start as many clusters as there are; equal vectors may start clusters
    of which all but the first stay empty. An empty table gives no rows. Further columns are not looked at.
    """
    spark = table.sparkSession
    vectors = stored(quantised(table, dimensions, vec_id=vec_id, vector=vector))
    centroids = starts(vectors, k)
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    if not len(centroids):
        return spark.createDataFrame([], f"vec_id {id_type}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    simplex = Simplex(centroids, pivots)
    cached = stored(with_apexes(vectors, simplex, dimensions))
    for _ in range(rounds):
        centroids = moved(cached, centroids, simplex)
        if simplex.drift(centroids) > DRIFT:
            simplex = Simplex(centroids, pivots)
            cached = stored(with_apexes(vectors, simplex, dimensions))
    found = stored(assigned(cached, centroids, simplex))
    # One row per cluster: exact sums, wider than a sum of many long numbers could need.
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()
    summary = [(c, s, sum(sums.values()), digest(c)) for c, s in sums.items()]
    told = spark.createDataFrame(summary, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    # At most k rows.
    return found.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
