"""Interval joins over cells against a plain comparison of times."""

import random

import pytest
from pyspark.sql import functions as F

from vigilake.functions import intervals


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    at = lambda: rng.choice([rng.randrange(-10**12, 10**13), rng.randrange(40) * 1_000_000, rng.randrange(5 * 10**6)])
    points = [(n, rng.choice("ab"), at()) for n in range(400)] + [(500 + n, "a", 86_400_000_000) for n in range(300)]
    windows = []
    for n in range(120):
        start = at()
        windows.append((n, rng.choice("ab"), start, start + rng.choice([0, 1, 999_999, 10**6, 3 * 10**6 + 5, 10**9, 10**12, -5])))
    windows += [(200, "a", 86_400_000_000, 86_400_000_000), (201, "b", None, 5), (202, "a", 0, 10**14)]
    return points, windows


def test_sums_over_windows(spark, rows):
    points, windows = rows
    given = spark.createDataFrame([(k, t, 1.0 + n) for n, k, t in points], "k STRING, us BIGINT, v DOUBLE")
    asked = spark.createDataFrame(windows, "id INT, k STRING, first BIGINT, last BIGINT")
    found = intervals.meet(
        intervals.cover(asked.select("id", "k", "first", "last"), F.col("first"), F.col("last")).drop("first", "last"),
        intervals.sums_per_cell(given, "us", ["k"], "v"), "us", ["k"]).groupBy("id").agg(F.sum("v").alias("v"))
    got = {r.id: r.v for r in found.collect()}
    want = {}
    for i, k, a, b in windows:
        if a is not None:
            hits = [1.0 + n for n, p, t in points if p == k and a <= t <= b]
            if hits:
                want[i] = sum(hits)
    assert got == pytest.approx(want) and want[202] > 0 and want[200] >= 300


def test_cover_is_exact_and_small(spark, rows):
    _, windows = rows
    asked = spark.createDataFrame(windows, "id INT, k STRING, first BIGINT, last BIGINT")
    cells = intervals.cover(asked, F.col("first"), F.col("last")).collect()
    parts = {}
    for r in cells:
        if r.level == intervals.INSTANTS:
            a, b = max(r.first, r.cell * 10**6), min(r.last, r.cell * 10**6 + 10**6 - 1)
        else:
            size = intervals.SIZES[r.level] * 10**6
            a, b = r.cell * size, r.cell * size + size - 1
        parts.setdefault(r.id, []).append((a, b))
    for i, _, first, last in windows:
        if first is None or first > last:
            assert i not in parts
            continue
        spans = sorted(parts[i])
        assert spans[0][0] == first and spans[-1][1] == last
        assert all(x[1] + 1 == y[0] for x, y in zip(spans, spans[1:]))
        assert len(spans) <= 2 + 30 * 4 + (last - first) // (intervals.SIZES[-1] * 10**6) + 1


def test_one_instant_is_few_rows_to_a_window(spark):
    given = spark.range(5000).select(F.lit(0).cast("bigint").alias("us"), F.col("id").alias("n"))
    kept = intervals.newest_per_cell(given, "us", [], [F.desc("n")], 2)
    assert kept.count() == 2 * (1 + len(intervals.SIZES)) and {r.n for r in kept.collect()} == {4998, 4999}
    assert intervals.sums_per_cell(given, "us", [], "n").count() == 1 + len(intervals.SIZES)


def run_span(r):
    unit = 1 if r.level == intervals.INSTANTS else intervals.RUN_SIZES[r.level] * 10**6
    cell = r.cell * (10**6 if r.level == intervals.INSTANTS else unit * intervals.RUN)
    assert 0 <= r.lo <= r.hi < (10**6 if r.level == intervals.INSTANTS else intervals.RUN)
    return cell + r.lo * unit, cell + (r.hi + 1) * unit - 1


def test_runs_are_exact_and_few(spark, rows):
    """Where cells are up to some hundred rows of a window, runs are two of each size."""
    _, windows = rows
    edges = [-64, -63, -1, 0, 1, 63, 64, 65, 4095, 4096, 4097, 8192, 262_144, 16_777_216, 40_000_000]
    windows = windows + [
        (1000 + 100 * i + 10 * j + k, "a", a * 10**6 + (k - 1), b * 10**6 - 1 + (k - 1) * 2)
        for i, a in enumerate(edges) for j, b in enumerate(edges[:10]) for k in range(3)
    ] + [(9000 + i, "a", 7, b * 10**6) for i, b in enumerate(edges)]
    asked = spark.createDataFrame(windows, "id INT, k STRING, first BIGINT, last BIGINT")
    parts = {}
    for r in intervals.cover_runs(asked, F.col("first"), F.col("last")).collect():
        parts.setdefault(r.id, []).append(run_span(r))
    for i, _, first, last in windows:
        if first is None or first > last:
            assert i not in parts
            continue
        spans = sorted(parts[i])
        assert spans[0][0] == first and spans[-1][1] == last
        assert all(x[1] + 1 == y[0] for x, y in zip(spans, spans[1:]))
        largest = intervals.RUN_SIZES[-1] * intervals.RUN * 10**6
        assert len(spans) <= 2 + 2 * (len(intervals.RUN_SIZES) - 1) + (last - first) // largest + 2


def test_sums_over_runs(spark, rows):
    points, windows = rows
    given = spark.createDataFrame([(k, t, 1.0 + n) for n, k, t in points], "k STRING, us BIGINT, v DOUBLE")
    asked = spark.createDataFrame(windows, "id INT, k STRING, first BIGINT, last BIGINT")
    runs = intervals.cover_runs(asked, F.col("first"), F.col("last")).drop("first", "last")
    found = intervals.meet_runs(runs, intervals.sums_per_run(given, "us", ["k"], "v"), ["k"])
    got = {r.id: r.v for r in found.groupBy("id").agg(F.sum("v").alias("v")).collect()}
    want = {}
    for i, k, a, b in windows:
        hits = [1.0 + n for n, p, t in points if a is not None and p == k and a <= t <= b]
        if hits:
            want[i] = sum(hits)
    assert got == pytest.approx(want) and want[202] > 0 and want[200] >= 300
    one = spark.range(5000).select(F.lit(0).cast("bigint").alias("us"), F.col("id").alias("n"))
    assert intervals.sums_per_run(one, "us", [], "n").count() == 1 + len(intervals.RUN_SIZES)


def test_impact_sends_few_rows_of_a_window(spark):
    """Plan of the impact report: windows of an hour are covered by runs, a tenth of the cells."""
    asked = spark.range(200).select("id", (F.col("id") * 7_654_321_987 + 3).alias("first"))
    covered = lambda f: f(asked, F.col("first"), F.col("first") + 3_599_999_990).count()
    assert covered(intervals.cover_runs) * 6 < covered(intervals.cover)
