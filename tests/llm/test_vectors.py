"""Whitening and clustering of vectors against exact arithmetic, and their border cases."""

import hashlib
from fractions import Fraction

import numpy as np
import pytest

import __spark_entry__ as entry
import oracle
from conftest import SMALL
from vigilake.llm import bisectors, whitening

SCHEMA = "vec_id long, embedding array<float>, cluster int, component int, x string, white string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 7, 7, "x", "w") for i, v in rows], SCHEMA)


def odd_rows(size):
    inf, nan = float("inf"), float("nan")
    return [(901, None), (902, []), (903, [None] * size), (904, [nan] * size), (905, [inf] + [0.0] * (size - 1)),
            (906, [1.0] * (size - 1) + [None]), (907, [3e38] * size), (908, [1.0] * (size + 1))]


# ---- whitening

def plain_components(rows, scale=64, offset=1_000_000):
    x = np.array([[int(np.floor(np.float64(np.float32(c)) * scale)) + offset for c in v] for v in rows], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    apart = x * n - sums
    spread = apart.T @ apart
    v = np.array([[float(Fraction(int(c), n**3)) for c in line] for line in spread])
    values, basis = np.linalg.eigh(v)
    return apart, values[::-1], basis[:, ::-1], v


def check_whitened(found, ids, rows, components):
    apart, values, basis, v = plain_components(rows)
    n = len(rows)
    got = {}
    for r in found:
        got.setdefault(r["component"], {}).setdefault(r["vec_id"], []).append(r)
    assert set(got) == set(range(1, components + 1))
    for c in got:
        want = (apart / n).astype(float) @ basis[:, c - 1] / np.sqrt(values[c - 1])
        have = np.array([got[c][i][0]["whitened"] for i in ids])
        sign = np.sign(want @ have)
        gap = min(abs(values[c - 1] - e) for k, e in enumerate(values) if k != c - 1)
        assert np.abs(have * sign - want).max() < 1e-12 * values[0] / gap * np.abs(want).max() + 1e-9
        first = got[c][ids[0]][0]
        assert first["explained"] == pytest.approx(values[c - 1] / np.trace(v), rel=1e-9)
        assert first["n"] == n and first["identity_error"] < 1e-9
    for i, line in zip(ids, apart):
        assert got[1][i][0]["deviation"] == int((line * line).sum())


def test_whitening_of_the_table(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet").orderBy("vec_id").collect()
    found = entry.queries()["op12_embedding_whitening"](spark, SMALL).collect()
    assert len(found) == 32 * len(table)
    check_whitened(found, [r["vec_id"] for r in table], [r["embedding"] for r in table], 32)


def test_whitening_border_cases(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=5) * [9, 3, 1, 1, 0]).tolist()) for i in range(40)]
    repeated = [*rows, rows[3], rows[3], (None, rows[4][1])]
    found = whitening.whiten(vectors(spark, repeated + odd_rows(5))).collect()
    assert len(found) == 4 * len(repeated)  # the fifth part never varies
    apart = plain_components([v for _, v in repeated])[0]
    assert {r["vec_id"] for r in found} == {*range(40), None}
    assert {r["deviation"] for r in found} == {int((line * line).sum()) for line in apart}
    assert found[0]["identity_error"] < 1e-9
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, odd_rows(5)[:6])).count() == 0
    assert whitening.whiten(vectors(spark, [rows[0], rows[0]])).count() == 0
    two = whitening.whiten(vectors(spark, rows[:2])).collect()
    assert len(two) == 2 and {round(abs(r["whitened"]), 9) for r in two} == {1.0}


def test_whitening_of_many_partitions_is_the_same(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    for found in (whitening.whiten(table.repartition(17)), whitening.whiten(table.orderBy("label").repartition(3))):
        row = found.where("vec_id = 3 and component = 32").first()
        if found is not None:
            assert abs(row["whitened"]) == pytest.approx(
                abs(whitening.whiten(table).where("vec_id = 3 and component = 32").first()["whitened"]), rel=1e-9)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 40])
def test_divided_spectra(size):
    rng = np.random.default_rng(size)
    random = rng.normal(size=(size, size))
    around, _ = np.linalg.qr(random)
    repeated = around @ np.diag([2.0] * (size // 2) + [-1.0] * (size - size // 2)) @ around.T
    level = around @ np.diag(np.linspace(-1, 1, size)) @ around.T
    hollow = np.ones((size, size)) - np.eye(size)
    for a in (random @ random.T, (repeated + repeated.T) / 2, (level + level.T) / 2, hollow, np.zeros((size, size))):
        values, basis = whitening.divide(a)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-12 * max(1, np.abs(a).sum()))
        assert np.allclose(basis.T @ basis, np.eye(size), atol=1e-13)
        assert np.allclose(a @ basis, basis * values, atol=1e-12 * max(1, np.abs(a).sum()))


# ---- clustering

def plain_clusters(rows, k=8, rounds=10, size=64, scale=1024):
    """(id, vector) pairs -> [(id, cluster, distance)], centroids; a full search in whole numbers."""
    kept = [
        (i, [int(np.floor(np.float64(np.float32(c)) * scale)) for c in v]) for i, v in rows
        if v is not None and len(v) == size and all(c is not None and abs(c) < bisectors.LIMIT / scale for c in v)
    ]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((square(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            mine = [v for (_, v), c in zip(kept, of) if c == j]
            if mine:
                centroids[j] = [sum(col) // len(mine) for col in zip(*mine)]
    return [(i, near(v)[1], near(v)[0]) for i, v in kept], centroids


def test_clusters_match_sql(spark):
    found = entry.queries()["op13_centroid_clusters"](spark, SMALL)
    assert oracle.compare(found, oracle.connect(SMALL), entry.oracle_sql()["op13_centroid_clusters"]) is None


def test_clusters_border_cases(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.integers(-3, 4, 4).astype(float).tolist()) for i in range(60)]  # many ties
    rows += [rows[0], (5, rows[9][1]), (None, rows[2][1]), (None, [0.0] * 4)]
    for k, rounds in ((8, 10), (3, 1), (200, 4), (1, 2)):
        want, centroids = plain_clusters(rows, k, rounds, size=4)
        found = bisectors.cluster_vectors(vectors(spark, rows + odd_rows(4)), k=k, rounds=rounds, size=4).collect()
        assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in found), key=str) == sorted(want, key=str)
        for r in found:
            assert r["centroid"] == centroids[r["cluster"]]
            assert r["inertia"] == sum(d for _, _, d in want)
            assert r["cluster_inertia"] == sum(d for _, c, d in want if c == r["cluster"])
            assert r["n_vectors"] == sum(c == r["cluster"] for _, c, _ in want)
            assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, r["centroid"])).encode()).hexdigest()
    assert bisectors.cluster_vectors(vectors(spark, [])).count() == 0
    assert bisectors.cluster_vectors(vectors(spark, odd_rows(4))).count() == 0


def test_a_tournament_is_a_full_search():
    rng = np.random.default_rng(4)
    centroids = rng.integers(-3, 4, (9, 3))
    centroids[5] = centroids[2]
    x = rng.integers(-4, 5, (2000, 3))
    square = ((x[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    assert (bisectors.winners(x, *bisectors.bisectors(centroids)) == square.argmin(axis=1)).all()
