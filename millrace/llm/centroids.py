"""Centroid clustering by exponion search, in whole numbers.

Vectors are turned into integers, so that distances, sums and ties are exact and the same on any partitioning.
Each vector carries its centroid, an upper bound on the distance to it and a lower bound on the distance to any
other. A round first compares the bounds; where they meet, it makes the upper bound u tight; where they still
meet, it scans only the centroids inside a ball around the current one, of radius 2 u plus the distance of that
centroid to its nearest other. Centroids near a centroid come from its list of the others in ascending
distance; the list's head that is scanned is rounded up to a power of two, so that vectors of one centroid share
few matrix products. Bounds and radius are inclusive and widened by more than rounding can take, so a tie always
reaches the scan, where the smaller number wins. Bounds are doubles, whatever decides is an integer.

A round is one pass over the vectors that writes them with their bounds to the shared folder (an executor lost
later costs no earlier round) and one aggregation of them, whose sums per centroid reach the driver: k rows.
A task holds k * k distances between centroids, so k is meant to be some thousands at most.

Defined results: vectors that are null, have another number of components, or a null or non-finite one, are left
out. Components saturate at 2 ** 27 in size, so that distances fit in a long, and so does their sum at its
largest value. Seeds are the k vectors of the smallest hashes; rows of a null id come last, rows of one id by
their vectors. With fewer than k vectors there are as many centroids as vectors; without any, no rows. Repeated
rows are clustered each on its own; a centroid that loses its last vector stays where it is. Only the id and
vector columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import dropped, written

DIMENSIONS = 64
LIMIT = 1 << 27
#: Below this size of components all terms of |x|^2 + |c|^2 - 2 x c are exact in doubles.
EXACT = 1 << 22
SLACK = 1e-12
STEP = 4096


def integers(rows: DataFrame, scale: int = 256, dimensions: int = DIMENSIONS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and v (array of long): floor(scale * x) of every vector that is kept."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    cut = lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(float(LIMIT))), F.lit(-float(LIMIT))))
    kept = rows.select(F.col(id_col).alias("vec_id"), x.alias("x")).filter((F.size("x") == dimensions) & F.forall("x", finite))
    return kept.select("vec_id", F.transform("x", cut).alias("v"))


def seeds(vectors: DataFrame, k: int, seed: int = 2) -> np.ndarray:
    """The vectors of the k smallest hex digests of 'seed:id', in that order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(digest.alias("digest"), "v").orderBy(F.asc_nulls_last("digest"), "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row of x to every row of c."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= EXACT:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2.0 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], axis=1)


def own_squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x to the same rows of c."""
    return ((x - c) ** 2).sum(1)


class Balls:
    """Centroids with, for each, the others in ascending distance."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.at = centroids
        between = np.sqrt(squared(centroids, centroids).astype(np.float64))
        self.order = np.argsort(between, axis=1, kind="stable")
        self.far = np.take_along_axis(between, self.order, axis=1)
        np.fill_diagonal(between, np.inf)
        self.nearest = between.min(axis=1)

    def nearest_two(self, x: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the centroids with these ascending numbers: the nearest one's number and squared distance, and the next one's distance (infinite if none)."""
        d = squared(x, self.at[numbers])
        first = d.argmin(axis=1)  # of equal distances the first, so the smaller number
        rows = np.arange(len(x))
        least = d[rows, first]
        d[rows, first] = np.iinfo(np.int64).max
        second = np.sqrt(d.min(axis=1).astype(np.float64)) if len(numbers) > 1 else np.full(len(x), np.inf)
        return numbers[first], least, second

    def assign(self, x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
        """Puts the rows of x to their nearest centroids, and tightens bounds, in place; own is -1 before the first round. Returns the number of distances computed."""
        scans = 0
        everyone = np.arange(len(self.at))
        for i in (g[j : j + STEP] for g in [np.flatnonzero(own < 0)] for j in range(0, len(g), STEP)):
            own[i], least, second = self.nearest_two(x[i], everyone)
            upper[i], lower[i] = np.sqrt(least) * (1 + SLACK), second * (1 - SLACK)
            scans += len(i) * len(everyone)
            own[i] += len(self.at)  # done; taken back below
        met = np.maximum(lower, self.nearest[own % len(self.at)] / 2 * (1 - SLACK))
        i = np.flatnonzero((own < len(self.at)) & (upper >= met))
        own %= len(self.at)
        upper[i] = np.sqrt(own_squared(x[i], self.at[own[i]])) * (1 + SLACK)
        scans += len(i)
        i = i[upper[i] >= met[i]]
        radius = (2 * upper[i] + self.nearest[own[i]]) * (1 + 1e-9)
        for c in np.unique(own[i]):
            mine = own[i] == c
            rows, inside = i[mine], np.searchsorted(self.far[c], radius[mine], side="right")
            width = np.minimum(1 << np.ceil(np.log2(np.maximum(inside, 2))).astype(np.int64), len(self.at))
            for w in np.unique(width):
                numbers = np.sort(self.order[c][:w])
                scanned = rows[width == w]
                for j in (scanned[k : k + STEP] for k in range(0, len(scanned), STEP)):
                    own[j], least, second = self.nearest_two(x[j], numbers)
                    upper[j], lower[j] = np.sqrt(least) * (1 + SLACK), second * (1 - SLACK)
                    scans += len(j) * int(w)
        return scans


def moved(upper: np.ndarray, lower: np.ndarray, own: np.ndarray, drift: np.ndarray) -> None:
    """Loosens bounds, in place, by what the centroids moved."""
    upper += drift[own]
    upper *= 1 + SLACK
    most = np.argmax(drift)
    other = np.delete(drift, most).max(initial=0.0)
    step = np.where(own == most, other, drift[most])
    lower -= step + SLACK * np.where(np.isfinite(lower), np.abs(lower) + step, 0)


def _assigned(table: DataFrame, centroids: np.ndarray, drift: np.ndarray | None) -> DataFrame:
    """vec_id, v, cluster, upper, lower after a round; table has v only where drift is None, in the first round."""
    first = drift is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        balls = Balls(centroids)
        for b in batches:
            x = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
            if first:
                own, upper, lower = np.full(b.num_rows, -1, np.int64), np.zeros(b.num_rows), np.zeros(b.num_rows)
            else:
                own, upper, lower = b.column(2).to_numpy().astype(np.int64), b.column(3).to_numpy().copy(), b.column(4).to_numpy().copy()
                moved(upper, lower, own, drift)
            if b.num_rows:
                balls.assign(x, own, upper, lower)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own, pa.int32()), pa.array(upper), pa.array(lower)], names=["vec_id", "v", "cluster", "upper", "lower"])

    return table.mapInArrow(run, f"vec_id {dict(table.dtypes)['vec_id']}, v array<long>, cluster int, upper double, lower double")


def _means(table: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Componentwise floor of the mean of every centroid's vectors; an empty one stays."""
    sums = [F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(centroids.shape[1])]
    new = centroids.copy()
    for r in table.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():
        new[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(centroids.shape[1])]
    return new


def clustered(rows: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, scale: int = 256, dimensions: int = DIMENSIONS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of every kept vector."""
    spark = rows.sparkSession
    table = integers(rows, scale, dimensions, id_col, vector_col)
    kind = dict(table.dtypes)["vec_id"]
    centroids, drift, old = seeds(table, k, seed), None, None
    if not len(centroids):
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        table = written(_assigned(table, centroids, drift), "assigned")
        if old is not None:
            dropped(old)
        old, new = table, _means(table, centroids)
        drift = np.sqrt(own_squared(new, centroids)) * (1 + SLACK)
        centroids = new

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(2).to_numpy()
            d = own_squared(b.column(1).flatten().to_numpy().reshape(b.num_rows, -1), centroids[own])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(d, pa.int64())], names=["vec_id", "cluster", "distance"])

    final = written(_assigned(table, centroids, drift).mapInArrow(measured, f"vec_id {kind}, cluster int, distance long"), "clustered")
    if old is not None:
        dropped(old)
    inertia = {r.cluster: int(r.total) for r in final.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    most = (1 << 63) - 1
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    known = [(c, min(n, most), min(sum(inertia.values()), most), digest(centroids[c])) for c, n in inertia.items()]
    of = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # One row a centroid, k at most.
    return final.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
