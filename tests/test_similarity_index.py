"""Similarity search and groups over the index against brute force, and their border cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilake.operators import similarity_index

DDL = "id long, embedding array<float>"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows], DDL)


def clustered(seed, centres, each, spread, size=24):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, size))
    rows = (middle[:, None] + spread * rng.normal(size=(centres, each, size))).reshape(-1, size).astype(np.float32)
    return list(enumerate(rows.tolist()))


def unit(rows):
    x = np.array([v for _, v in rows], dtype=np.float64)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def plain_nearest(rows, threshold, limit, every):
    near = unit(rows) @ unit(rows).T
    ids = np.array([i for i, _ in rows])
    out = {}
    for k, probe in enumerate(ids):
        if probe % every == 0:
            hits = [j for j in range(len(ids)) if j != k and near[k, j] > threshold]
            out[int(probe)] = [int(ids[j]) for j in sorted(hits, key=lambda j: (-round(near[k, j], 9), ids[j]))[:limit]]
    return out


def plain_groups(rows, threshold):
    near = unit(rows) @ unit(rows).T >= threshold
    label = np.arange(len(rows))
    while True:
        low = np.array([label[line].min() for line in near])
        if (low == label).all():
            return {i: rows[k][0] for (i, _), k in zip(rows, label)}
        label = low


@pytest.mark.parametrize("blocks", [{}, {"block_rows": 7, "block_probes": 3}])
def test_search_matches_brute_force(spark, blocks):
    rows = clustered(1, 12, 30, 0.35)
    want = plain_nearest(rows, 0.85, 5, 4)
    found = similarity_index.similar_incidents(frame(spark, rows), F.col("id") % 4 == 0, **blocks).orderBy("probe_id", "rank").collect()
    got = {i: [] for i in want}
    for r in found:
        got[r.probe_id].append(r.id)
        assert r.rank == len(got[r.probe_id])
    assert any(want.values())
    hits = sum(len(set(got[i]) & set(want[i])) for i in want)
    assert hits >= 0.99 * sum(len(w) for w in want.values())


def test_copies_give_linear_output(spark):
    one, other = np.eye(6)[0], np.eye(6)[1]
    rows = [(i, one) for i in range(3000)] + [(5000, other), (5001, one + 0.3 * other)]
    found = similarity_index.similar_incidents(frame(spark, rows), F.col("id") % 20 == 0)
    got = {}
    for r in found.collect():
        got.setdefault(r.probe_id, []).append(r.id)
    assert got[0] == [1, 2, 3, 4, 5] and got[2980] == [0, 1, 2, 3, 4]
    assert len(got) == 150 and all(len(ids) == 5 for ids in got.values())
    links, member = similarity_index.similarity_links(frame(spark, rows))
    assert links.count() == 1 and member.count() == 3002
    groups = {r.id: r.group_id for r in similarity_index.similar_groups(frame(spark, rows)).collect()}
    assert groups == {**{i: 0 for i in range(3000)}, 5000: 5000, 5001: 0}


@pytest.mark.parametrize("block_rows", [1024, 16])
def test_groups_match_brute_force(spark, block_rows):
    rows = clustered(2, 10, 40, 0.3) + [(1000 + i, v) for i, v in clustered(3, 30, 1, 0.0)]
    want = plain_groups(rows, 0.85)
    links, member = similarity_index.similarity_links(frame(spark, rows), recall=0.999, block_rows=block_rows)
    found = similarity_index.similar_groups(frame(spark, rows), recall=0.999, block_rows=block_rows)
    got = {r.id: r.group_id for r in found.collect()}
    assert got == want and len(set(want.values())) < len(rows) / 2
    near = unit(rows) @ unit(rows).T
    at = {i: k for k, (i, _) in enumerate(rows)}
    for r in links.collect():
        assert r.similarity == pytest.approx(near[at[r.a], at[r.b]], abs=1e-9) and r.similarity >= 0.85
    assert links.count() < 40 * len(rows) and member.count() == len(rows)


def test_unusable_vectors(spark):
    odd = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0, float("inf")]), (6, [1.0]),
           (7, [1.0, 0.1]), (8, [1.0, 0.0]), (8, [1.0, 0.0])]
    found = similarity_index.similar_incidents(frame(spark, odd), F.lit(True)).collect()
    assert sorted((r.probe_id, r.id) for r in found if r.probe_id == 7) == [(7, 8), (7, 8)]
    groups = similarity_index.similar_groups(frame(spark, odd)).collect()
    assert {(r.id, r.group_id) for r in groups} == {(7, 7), (8, 7)}
    for rows in ([], odd[:5]):
        assert similarity_index.similar_incidents(frame(spark, rows), F.lit(True)).count() == 0
        assert similarity_index.similar_groups(frame(spark, rows)).count() == 0


def test_index_grows_with_the_table():
    for rows in (10, 1_000, 10**6, 10**9):
        for probing in (False, True):
            planes, tables = similarity_index.index_shape(rows, 0.85, 0.99, probing)
            same = 1 - np.arccos(0.85) / np.pi
            met = same**planes + (planes * same ** (planes - 1) * (1 - same) if probing else 0)
            assert 1 - (1 - met) ** tables >= 0.99
            assert rows / 2**planes <= similarity_index.BUCKET_ROWS


def test_tables_of_groups_do_not_grow_with_the_vectors():
    few, many = (similarity_index.group_shape(rows, 0.85, 0.999) for rows in (30_768, 1_850_000))
    assert few == many == similarity_index.index_shape(30_768, 0.85, 0.999, False)
    for rows in (10, 30_768, 10**7, 10**9):
        planes, tables = similarity_index.group_shape(rows, 0.85, 0.999)
        met = (1 - np.arccos(0.85) / np.pi) ** planes
        assert 1 - (1 - met) ** tables >= 0.999 and rows / 2**planes <= similarity_index.GROUP_ROWS


def test_pairs_within_rounding_of_the_threshold_are_decided_exactly(spark):
    """Pairs so near the threshold that rounded vectors cannot tell; each pair has two components of its own."""
    rows = []
    for k in range(40):
        near = 0.85 + (1 if k % 2 else -1) * 2e-6 * (1 + k // 2)
        for n, (x, y) in enumerate(((1.0, 0.0), (near, np.sqrt(1 - near * near)))):
            v = np.zeros(80)
            v[2 * k:2 * k + 2] = x, y
            rows.append((2 * k + n, v))
    want = plain_groups(rows, 0.85)
    assert len(set(want.values())) == 60 and 40e-6 < similarity_index.short_error(80)
    for block_rows in (8192, 5):
        found = similarity_index.similar_groups(frame(spark, rows), recall=0.999999, block_rows=block_rows).collect()
        assert {r.id: r.group_id for r in found} == want
    links, _ = similarity_index.similarity_links(frame(spark, rows), recall=0.999999)
    assert links.count() == 20 and links.where("similarity < 0.85").count() == 0
