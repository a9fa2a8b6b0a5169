"""Embedding whitening: principal components by QDWH spectral divide-and-conquer.

Vectors are put on an integer grid `floor(scale * part) + offset`. Sums are exact. Each
value is centred by the floor of its column's mean before it is multiplied, products are
added as integers, and the rest of the mean is taken off as an exact fraction: the
covariance does not depend on the order of rows or tasks.

Components. For a symmetric matrix `A` and a shift `s`, the unitary polar factor `U` of
`A - s I` is the matrix sign, so `(U + I) / 2` is the projector onto the eigenvectors with
values above `s`. `U` comes from the dynamically weighted Halley iteration in its QR form
(QDWH), whose steps use orthogonal factors only. Bases of the projector's range and of its
complement split the matrix in two, and each half is divided again until it is diagonal.
The matrix has as many rows as a vector has parts, whatever the number of vectors.

Spread. Sums, products, whitened parts and their covariance are one pass each, added per
task; only matrices of the vectors' size meet the driver or are broadcast.

Defined cases. Vectors that are null, empty or hold null, NaN, infinite parts take no part,
nor do those of another size than the most frequent one (ties: the larger) or with parts
beyond `LIMIT` on the grid. Repeated rows count each time; null ids stay. Components whose
eigenvalue is zero up to rounding have no whitened value and are not returned: fewer than
two different vectors give no row. A deviation beyond a long is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.llm.common import stored

LIMIT = 1 << 40
EXACT = 1 << 53
RESULT = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
          "identity_error double, eigenvalue double")


def on_grid(table: DataFrame, id_col: str, vector_col: str, scale: int, offset: int) -> DataFrame:
    """`vec_id, x`: usable vectors of the most frequent size as integers."""
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    inside = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LIMIT / scale)
    whole = rows.where(F.size("v") > 0).where(F.forall("v", inside))
    common = whole.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    grid = F.transform("v", lambda c: F.floor(c * scale).cast("long") + F.lit(offset))
    return whole.where(F.size("v") == (common["size"] if common else 0)).select("vec_id", grid.alias("x"))


def _parts(batch: pd.DataFrame) -> np.ndarray:
    return np.stack(batch["x"].to_numpy()).astype(np.int64)


def column_sums(grid: DataFrame) -> tuple[int, list[int]]:
    """Number of rows and the exact sum of every column."""

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = 0, None
        for batch in batches:
            if len(batch):
                x = _parts(batch)
                n += len(x)
                total = x.sum(axis=0) if total is None else total + x.sum(axis=0)
        if n:
            yield pd.DataFrame({"part": np.arange(len(total)), "n": n, "total": total})

    added = grid.select("x").mapInPandas(summed, "part int, n long, total long").groupBy("part").agg(
        F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")
    ).collect()  # one row per part of a vector
    added.sort(key=lambda r: r["part"])
    return (added[0]["n"] if added else 0), [int(r["total"]) for r in added]


def _products(x: np.ndarray) -> np.ndarray:
    """`x' x` of integers, exact: in floats where no sum can exceed them, else in whole numbers."""
    most = int(np.abs(x).max(initial=0))
    if most * most * len(x) < EXACT:
        wide = x.astype(np.float64)
        return (wide.T @ wide).astype(np.int64).astype(object)
    wide = x.astype(object)
    return wide.T @ wide


def covariance(grid: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Covariance with divisor `n`, centred before multiplying."""
    size = len(sums)
    middle = np.array([s // n for s in sums], dtype=np.int64)
    upper = np.triu_indices(size)

    def multiplied(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, size), dtype=object)
        for batch in batches:
            if len(batch):
                total = total + _products(_parts(batch) - middle)
        yield pd.DataFrame({"i": upper[0], "j": upper[1], "total": [str(v) for v in total[upper]]})

    added = (
        grid.select("x").mapInPandas(multiplied, "i int, j int, total string").groupBy("i", "j")
        .agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    )  # size * (size + 1) / 2 rows
    rest = [s - n * int(m) for s, m in zip(sums, middle)]
    out = np.zeros((size, size))
    for r in added:
        i, j = r["i"], r["j"]
        # an exact whole number over n * n: one rounding
        out[i, j] = out[j, i] = (n * int(r["total"]) - rest[i] * rest[j]) / (n * n)
    return out


def polar_sign(a: np.ndarray, steps: int = 40) -> np.ndarray:
    """Unitary polar factor of a symmetric matrix by the QR form of weighted Halley steps."""
    size = len(a)
    length = np.linalg.norm(a, 2)
    if length == 0:
        return np.eye(size)
    x = a / length
    tiny = np.finfo(float).eps
    low = max(1.0 / (np.sqrt(size) * np.linalg.cond(x, 1)), tiny) if np.linalg.matrix_rank(x) == size else tiny
    for _ in range(steps):
        square = low * low
        d = np.cbrt(4 * (1 - square) / (square * square))
        root = np.sqrt(1 + d)
        wa = root + 0.5 * np.sqrt(max(8 - 4 * d + 8 * (2 - square) / (square * root), 0.0))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack((np.sqrt(wc) * x, np.eye(size))))
        moved = (wb / wc) * x + (wa - wb / wc) / np.sqrt(wc) * (q[:size] @ q[size:].T)
        moved = (moved + moved.T) / 2
        change = np.linalg.norm(moved - x)
        x = moved
        low = min(low * (wa + wb * square) / (1 + wc * square), 1.0)
        if change < 8 * tiny * np.sqrt(size) or (1 - low < tiny and change < np.cbrt(tiny) / 100):
            break
    return x


def _ranges(projector: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of a projector's range and of its complement, by pivoted elimination."""
    size, rank = len(projector), int(round(np.trace(projector)))
    left, picked = projector.copy(), []
    for _ in range(rank):
        norms = (left * left).sum(axis=0)
        best = int(np.argmax(norms))
        picked.append(best)
        unit = left[:, best] / np.sqrt(norms[best])
        left -= np.outer(unit, unit @ left)
    basis, _ = np.linalg.qr(np.hstack((projector[:, picked], np.eye(size))))
    # one step of subspace iteration sharpens the basis
    inside, _ = np.linalg.qr(projector @ basis[:, :rank])
    full, _ = np.linalg.qr(np.hstack((inside, np.eye(size))))
    return inside, full[:, rank:size]


def divide(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and unit eigenvectors (columns) of a symmetric matrix, largest first."""
    size, whole = len(a), np.linalg.norm(a)
    values, vectors = [], []
    waiting = [(a, np.eye(size))]
    while waiting:
        block, basis = waiting.pop()
        diagonal = np.diag(block)
        off = block - np.diag(diagonal)
        halves = None
        if len(block) > 1 and np.abs(off).max() > np.finfo(float).eps * max(np.abs(diagonal).max(), np.finfo(float).tiny):
            halves = _halves(block, diagonal)
        if halves is None:
            values += diagonal.tolist()
            vectors.append(basis)
            continue
        for part in halves:
            inner = part.T @ block @ part
            waiting.append(((inner + inner.T) / 2, basis @ part))
    order = np.argsort(-np.array(values), kind="stable")
    found, _ = np.linalg.qr(np.hstack(vectors)[:, order])
    values = np.einsum("ij,ij->j", found, a @ found)
    if np.linalg.norm(a @ found - found * values) > 1e-10 * max(whole, np.finfo(float).tiny):
        raise ArithmeticError("the division of the spectrum did not settle")
    again = np.argsort(-values, kind="stable")
    return values[again], found[:, again]


def _halves(block: np.ndarray, diagonal: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of the parts of the spectrum above and below a shift that has both."""
    mean, size = diagonal.mean(), len(block)
    spread = np.linalg.norm(block - mean * np.eye(size)) / np.sqrt(size)
    # values lie on both sides of the mean; a shift that meets one has no integer trace, so others follow
    shifts = [np.median(diagonal), mean, *(mean + t * spread for t in (0.05, -0.05, 0.17, -0.17, 0.4, -0.4))]
    for shift in shifts:
        sign = polar_sign(block - shift * np.eye(size))
        projector = (sign + np.eye(size)) / 2
        rank = int(round(np.trace(projector)))
        if 0 < rank < size and abs(np.trace(projector) - rank) < 1e-6:
            return _ranges(projector)
    return None


def whiten(
    table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32,
    scale: int = 64, offset: int = 1_000_000,
) -> DataFrame:
    """One row per usable vector and component, numbered from 1 by falling eigenvalue."""
    spark = table.sparkSession
    grid = stored(on_grid(table, id_col, vector_col, scale, offset))
    n, sums = column_sums(grid)
    if n == 0:
        return spark.createDataFrame([], RESULT)
    spread = covariance(grid, n, sums)
    values, vectors = divide(spread)
    real = values > np.finfo(float).eps * len(values) * max(values[0], 0.0)
    keep = int(min(components, real.sum()))
    if keep == 0:
        return spark.createDataFrame([], RESULT)
    middle = np.array([s // n for s in sums], dtype=np.int64)
    rest = np.array([s - n * int(m) for s, m in zip(sums, middle)], dtype=np.int64)  # below n
    scaled = vectors[:, :keep] / np.sqrt(values[:keep])

    def projected(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            centred = _parts(batch) - middle
            most = int(np.abs(centred).max(initial=0)) + 1
            apart = centred * n - rest if most * n < 1 << 62 else centred.astype(object) * n - rest
            if int(np.abs(apart).max(initial=0)) ** 2 * len(sums) < 1 << 62:
                deviation = (apart * apart).sum(axis=1).astype(object)
            else:
                wide = apart.astype(object)
                deviation = np.array([d if d < 1 << 63 else None for d in (wide * wide).sum(axis=1)], dtype=object)
            white = (apart / n).astype(np.float64) @ scaled
            yield pd.DataFrame({
                "vec_id": batch["vec_id"].astype("Int64"), "deviation": pd.array(deviation, dtype="Int64"), "white": list(white),
            })

    white = stored(grid.mapInPandas(projected, "vec_id long, deviation long, white array<double>"))
    error = _identity_error(white, n, keep)
    share = values / np.trace(spread)
    known = F.array(*[F.struct(F.lit(float(values[c])).alias("e"), F.lit(float(share[c])).alias("share")) for c in range(keep)])
    return white.select("vec_id", "deviation", F.posexplode("white").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        known[F.col("at")]["share"].alias("explained"), F.lit(error).alias("identity_error"),
        known[F.col("at")]["e"].alias("eigenvalue"),
    )


def _identity_error(white: DataFrame, n: int, size: int) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity."""
    upper = np.triu_indices(size)

    def multiplied(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, line = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            if len(batch):
                w = np.stack(batch["white"].to_numpy())
                total += w.T @ w
                line += w.sum(axis=0)
        yield pd.DataFrame({
            "i": np.append(upper[0], np.arange(size)), "j": np.append(upper[1], np.full(size, -1)),
            "total": np.append(total[upper], line),
        })

    added = white.select("white").mapInPandas(multiplied, "i int, j int, total double").groupBy("i", "j").agg(
        F.sum("total").alias("total")
    ).collect()  # size * (size + 3) / 2 rows
    got = {(r["i"], r["j"]): r["total"] / n for r in added}
    return max(
        abs(got[i, j] - got[i, -1] * got[j, -1] - (i == j)) for i, j in got if j >= 0
    )
