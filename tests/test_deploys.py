"""Deploys around incidents against a plain comparison of times."""

import random
from datetime import datetime, timedelta

from vigilake.operators import deploys

START = datetime(2024, 1, 1)


def plain(incidents, shipped, newest):
    found = {}
    for i, service, detected, resolved in incidents:
        if detected is None:
            continue
        first = detected - timedelta(hours=6)
        last = resolved + timedelta(minutes=30) if resolved else detected + timedelta(hours=6)
        found.setdefault(i, []).extend(
            (-(at - START).total_seconds(), sha) for sha, owner, at in shipped
            if at is not None and service in (None, owner) and first <= at <= last)
    return {(i, rank, sha) for i, rows in found.items() for rank, (_, sha) in enumerate(sorted(rows)[:newest], 1)}


def test_newest_deploys_of_windows(spark):
    rng = random.Random(3)
    hours = lambda n: START + timedelta(hours=n)
    at = lambda: hours(rng.choice([rng.uniform(0, 300), rng.randrange(12) * 24, 48]))
    shipped = [(f"s{n:03}", rng.choice(["a", "b", None]), at()) for n in range(400)] + [("x1", "a", None)]
    shipped += [("far", "b", datetime(9000, 1, 1)), ("old", "a", datetime(1900, 1, 1))]
    incidents = [(n, rng.choice(["a", "b", "c", None]), at(), rng.choice([None, at(), hours(500)])) for n in range(80)]
    incidents += [(1, "b", hours(50), None), (2, "a", None, hours(9)), (None, "a", hours(48), None), (90, "a", hours(-10), None),
                  (91, "b", hours(2), datetime(9500, 1, 1))]
    asked = spark.createDataFrame(incidents, "id INT, service STRING, detected_at TIMESTAMP, resolved_at TIMESTAMP")
    given = spark.createDataFrame(shipped, "sha STRING, service STRING, deployed_at TIMESTAMP")
    for newest in (1, 4, 20):
        near = deploys.deploys_near(asked, given, newest)
        assert near.columns == ["incident_id", "sha", "service", "deployed_at", "rank"]
        got = [(r.incident_id, r.rank, r.sha) for r in near.collect()]
        assert len(got) == len(set(got)) and set(got) == plain(incidents, shipped, newest)
    assert deploys.deploys_near(asked, given.limit(0)).count() == 0


def test_a_window_is_one_row(spark):
    """However long a window is, it is not spread over cells."""
    asked = spark.createDataFrame([(1, "a", START, START + timedelta(days=900))], "id INT, service STRING, detected_at TIMESTAMP, resolved_at TIMESTAMP")
    given = spark.createDataFrame([("s", "a", START)], "sha STRING, service STRING, deployed_at TIMESTAMP")
    near = deploys.deploys_near(asked, given)
    assert [r.sha for r in near.collect()] == ["s"]
    assert "level" not in near._jdf.queryExecution().optimizedPlan().toString()
