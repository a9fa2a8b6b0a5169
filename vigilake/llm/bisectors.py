"""Centroid clustering with integer arithmetic: a tournament of bisector tests per vector.

Vectors are put on an integer grid. A round assigns every vector to its nearest centroid
and replaces each centroid that has vectors by the componentwise floor of their mean, so
every figure is exact and reruns agree, whatever the order of rows.

Tournament. For centroids `a < b`, `b` is strictly nearer than `a` exactly if
`2 (b - a) . x > b.b - a.a`. The integer normals `2 (b - a)` and thresholds of all pairs
are computed once a round from the few centroids. A vector's current winner meets the
next centroid in one linear sign test, `k - 1` in all; a test of zero keeps the smaller
number. Only the last winner's distance is computed.

Spread. A round is one pass over the stored grid; every task gives one row per centroid
(count and sums), added up by Spark. Only the `k` centroids pass through the driver. A
round that moves nothing ends the search early, since all later ones would repeat it.

Defined cases. Vectors that are null, of another size, or hold null, NaN, infinite parts
take no part, nor do those whose grid parts reach `LIMIT` in size, whose squared distance
would not fit a long. Rows that repeat an id or a vector are vectors of their own; among
first centroids equal hashes go by the vector. Null ids come last there. Fewer vectors
than `k` give fewer centroids; none give an empty result. Inertias beyond a long are null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.llm.common import stored

LIMIT = 1 << 27
RESULT = ("vec_id long, cluster int, distance long, cluster_inertia long, inertia long, "
          "n_vectors long, centroid array<long>, centroid_sha256 string")


def on_grid(table: DataFrame, id_col: str, vector_col: str, size: int, scale: int) -> DataFrame:
    """`vec_id, x`: usable vectors as integers `floor(scale * part)`."""
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    inside = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LIMIT / scale)
    whole = rows.where(F.size("v") == size).where(F.forall("v", inside))
    return whole.select("vec_id", F.transform("v", lambda c: F.floor(c * scale).cast("int")).alias("x"))


def first_centroids(grid: DataFrame, k: int, salt: str) -> np.ndarray:
    """The `k` vectors with the smallest SHA-256 of salt and id."""
    hashed = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    rows = grid.select(hashed.alias("h"), "x").orderBy(F.asc_nulls_last("h"), "x").limit(k).collect()
    return np.array([r["x"] for r in rows], dtype=np.int64)


def bisectors(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normals `[a, b]` and thresholds of all pairs of centroids; only `a < b` are used."""
    normals = 2 * (centroids[None, :, :] - centroids[:, None, :])
    squares = (centroids * centroids).sum(axis=1)
    return normals, squares[None, :] - squares[:, None]


def winners(x: np.ndarray, normals: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """Number of the nearest centroid of every row, by `k - 1` sign tests."""
    best = np.zeros(len(x), dtype=np.int64)
    for b in range(1, len(thresholds)):
        side = np.einsum("ij,ij->i", x, normals[best, b]) - thresholds[best, b]
        best[side > 0] = b
    return best


def _grid_of(batch: pd.DataFrame) -> np.ndarray:
    return np.stack(batch["x"].to_numpy()).astype(np.int64)


def _moved(grid: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Componentwise floor of the mean of each centroid's vectors."""
    k, size = centroids.shape
    tests = bisectors(centroids)

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, sums = np.zeros(k, dtype=np.int64), np.zeros((k, size), dtype=np.int64)
        for batch in batches:
            if len(batch):
                x = _grid_of(batch)
                best = winners(x, *tests)
                counts += np.bincount(best, minlength=k)
                np.add.at(sums, best, x)
        rows = [(c, d, int(counts[c]), int(sums[c, d])) for c in np.flatnonzero(counts) for d in range(size)]
        yield pd.DataFrame(rows, columns=["cluster", "part", "n", "total"])

    # at most k * size rows come back
    rows = (
        grid.select("x").mapInPandas(summed, "cluster int, part int, n long, total long").groupBy("cluster", "part")
        .agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    )
    out = centroids.copy()
    for r in rows:
        out[r["cluster"], r["part"]] = int(r["total"]) // r["n"]
    return out


def cluster_vectors(
    table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 8, rounds: int = 10,
    size: int = 64, scale: int = 1024, salt: str = "3:",
) -> DataFrame:
    """One row per usable vector: its cluster, exact squared distance and the clusters' figures."""
    spark = table.sparkSession
    grid = stored(on_grid(table, id_col, vector_col, size, scale))
    centroids = first_centroids(grid, k, salt)
    if not len(centroids):
        return spark.createDataFrame([], RESULT)
    for _ in range(rounds):
        moved = _moved(grid, centroids)
        settled = (moved == centroids).all()
        centroids = moved
        if settled:
            break
    tests = bisectors(centroids)

    def assigned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = _grid_of(batch)
                best = winners(x, *tests)
                gap = x - centroids[best]
                yield pd.DataFrame({"vec_id": batch["vec_id"].astype("Int64"), "cluster": best, "distance": (gap * gap).sum(axis=1)})

    rows = stored(grid.mapInPandas(assigned, "vec_id long, cluster int, distance long"))
    total = F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")
    sums = rows.groupBy("cluster").agg(F.count("*").alias("n"), total).collect()  # at most k rows
    as_long = lambda n: n if n < 1 << 63 else None
    everything = as_long(sum(int(r["total"]) for r in sums))
    figures = [
        (r["cluster"], as_long(int(r["total"])), everything, r["n"], centroids[r["cluster"]].tolist(),
         hashlib.sha256(",".join(map(str, centroids[r["cluster"]].tolist())).encode()).hexdigest())
        for r in sums
    ]
    known = spark.createDataFrame(
        figures, "cluster int, cluster_inertia long, inertia long, n_vectors long, centroid array<long>, centroid_sha256 string"
    )
    return rows.join(F.broadcast(known), "cluster").select(*[c.split()[0] for c in RESULT.split(", ")])
