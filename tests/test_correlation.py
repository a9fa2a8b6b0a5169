"""Correlation against a plain loop over all alerts, and its hand-worked cases."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from vigilake.operators import correlation, graph
from vigilake.operators.graph import components, depths, hops_between

T0 = dt.datetime(2024, 5, 1)
ALERT_DDL = (
    "id BIGINT, dedup_key STRING, service STRING, severity_rank INT, "
    "labels MAP<STRING,STRING>, starts_at TIMESTAMP"
)
EDGES = [("web", "api"), ("api", "db"), ("api", "cache"), ("jobs", "db"), ("mail", "queue")]


def edges_df(spark, rows=EDGES):
    return spark.createDataFrame(rows, "service STRING, depends_on STRING")


def alert(i, second, service, key=None, rank=4, name=None):
    labels = {"alertname": name or "Down", "severity": "critical"}
    if service:
        labels["service"] = service
    return (i, key or f"{service}/{name or 'Down'}", service, rank, labels,
            T0 + dt.timedelta(seconds=second))


def plain_loop(alerts, edges, window=300, threshold=0.62, close_after=86400, closures=()):
    """Direct statement of the rule, one alert at a time over every open incident."""
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def hops(a, b):
        if a not in near or b not in near:
            return None
        return 0 if a == b else 1 if b in near[a] else 2 if near[a] & near[b] else None

    incidents, holder, result = [], {}, {}
    ends = [(None, key, None, None, None, at) for key, at in closures]
    for i, key, service, rank, labels, at in sorted([*alerts, *ends], key=lambda r: (r[5], r[0] is None, r[0] or 0)):
        if i is None:
            if key in holder:
                holder[key]["closed"] = True
            continue
        dead = lambda inc: "closed" in inc or (at - inc["hi"]).total_seconds() > close_after
        inc = holder.get(key)
        if inc is None or dead(inc):
            best, top = None, 0.0
            for other in incidents:
                if other["rank"] < rank or dead(other):
                    continue
                away = 0 if other["lo"] <= at <= other["hi"] else min(
                    abs((at - other["lo"]).total_seconds()), abs((at - other["hi"]).total_seconds())
                )
                score = 0.4 * (1 - away / window) if away <= window else 0.0
                reach = [h for h in (hops(service, s) for s in other["services"]) if h is not None]
                if reach:
                    score += 0.4 * (1 - min(reach) / 3)
                mine, theirs = set(labels.items()), set(other["labels"].items())
                score += 0.2 * len(mine & theirs) / len(mine | theirs)
                if score >= threshold and score > top:
                    best, top = other, score
            inc = best
            if inc is None:
                inc = {"id": i, "lo": at, "hi": at, "rank": rank, "services": set(), "labels": {}}
                incidents.append(inc)
            holder[key] = inc
        inc["lo"], inc["hi"] = min(inc["lo"], at), max(inc["hi"], at)
        inc["rank"] = max(inc["rank"], rank)
        if service:
            inc["services"].add(service)
        for k, v in labels.items():
            inc["labels"].setdefault(k, v)
        result[i] = inc["id"]
    return result


def run(spark, alerts, edges=EDGES, **options):
    df = spark.createDataFrame(alerts, ALERT_DDL)
    out = correlation.correlate(df, edges_df(spark, edges), **options).collect()
    return {r.alert_id: r for r in out}


def test_random_history_matches_plain_loop(spark):
    rng = random.Random(7)
    services = ["web", "api", "db", "cache", "jobs", "mail", "queue", "stranger", None]
    alerts, second = [], 0
    for i in range(900):
        second += rng.choice([0, 5, 40, 200, 400, 3000, 40_000]) if i % 60 else 100_000
        service = rng.choice(services)
        alerts.append(
            alert(i, second, service, rank=rng.choice([2, 3, 4]), name=rng.choice("ABC"),
                  key=rng.choice([None, f"group-{rng.randrange(6)}"]))
        )
    got = {k: r.incident_id for k, r in run(spark, alerts).items()}
    assert got == plain_loop(alerts, EDGES)


def test_driver_alerts_match_plain_loop(spark, views):
    alerts = [
        (r.id, r.dedup_key, r.service, r.severity_rank, r.labels, r.starts_at)
        for r in views.alerts().select(
            "id", "dedup_key", "service", "severity_rank", "labels", "starts_at").collect()
    ]
    edges = [tuple(r) for r in views.edges().collect()]
    got = correlation.correlate(views.alerts(), views.edges()).collect()
    assert {r.alert_id: r.incident_id for r in got} == plain_loop(alerts, edges)


def test_result_does_not_depend_on_partitioning(spark):
    alerts = [alert(i, i * 37 % 2000, s) for i, s in enumerate(["web", "api", "db", "mail"] * 25)]
    one = spark.createDataFrame(alerts, ALERT_DDL).coalesce(1)
    many = spark.createDataFrame(alerts, ALERT_DDL).repartition(13)
    edges = edges_df(spark)
    a = {(r.alert_id, r.incident_id) for r in correlation.correlate(one, edges).collect()}
    b = {(r.alert_id, r.incident_id) for r in correlation.correlate(many, edges).collect()}
    assert a == b


@pytest.mark.parametrize("size", [5, 12, 40])
def test_cascade_becomes_one_incident(spark, size):
    chain = ["db", "api", "web"]
    alerts = [alert(i, i * 6, chain[i % 3], name=f"A{i}") for i in range(size)]
    got = run(spark, alerts)
    assert {r.incident_id for r in got.values()} == {0}
    assert sum(r.kind == "merged" for r in got.values()) == size - 1


def test_time_bound_is_285_seconds(spark):
    edge = [alert(1, 0, "db", name="A"), alert(2, 285, "db", name="A", key="other")]
    late = [alert(1, 0, "db", name="A"), alert(2, 286, "db", name="A", key="other")]
    assert run(spark, edge)[2].kind == "merged"
    assert run(spark, late)[2].kind == "new"


def test_more_severe_alert_does_not_join(spark):
    got = run(spark, [alert(1, 0, "db", rank=3), alert(2, 10, "db", key="other", rank=4)])
    assert got[2].kind == "new"


def test_reasons_and_epochs(spark):
    day = 86_400
    got = run(spark, [alert(1, 0, "db"), alert(2, 60, "api"), alert(3, 3 * day, "db")])
    assert got[2].reasons[:2] == ["60s from the incident window", "1 hop(s) from db"]
    assert (got[3].kind, got[3].epoch) == ("new", 1)


def test_explicit_closure_opens_next_epoch(spark):
    alerts = [alert(1, 0, "db"), alert(2, 30, "api"), alert(3, 500, "api"), alert(4, 2000, "db")]
    closed = spark.createDataFrame(
        [("db/Down", T0 + dt.timedelta(seconds=400))], "dedup_key STRING, closed_at TIMESTAMP"
    )
    got = run(spark, alerts, closures=closed)
    assert got[2].incident_id == 1 and got[3].incident_id == 3 and got[4].kind == "new"


def test_closures_equal_the_plain_loop(spark):
    """Repeats are reduced between closings too; a closing may end the incident of another key."""
    rng = random.Random(21)
    rows = [alert(i, rng.choice([rng.randrange(30_000), 600 * rng.randrange(50)]), rng.choice(["web", "api", "db", "mail", None]),
                  rank=rng.choice([3, 4]), name=rng.choice("AB")) for i in range(400)]
    ends = [(rng.choice(rows)[1], T0 + dt.timedelta(seconds=rng.choice([rng.randrange(30_000), 600 * rng.randrange(50)])))
            for _ in range(25)] + [("never seen", T0)]
    closed = spark.createDataFrame(ends, "dedup_key STRING, closed_at TIMESTAMP")
    got = run(spark, rows, closures=closed)
    want = plain_loop(rows, EDGES, closures=ends)
    assert {i: r.incident_id for i, r in got.items()} == want
    assert len(set(want.values())) > len(set(plain_loop(rows, EDGES).values()))


def test_a_hot_key_between_closings_is_few_steps(spark):
    rows = [alert(i, i, "db") for i in range(3000)]
    ends = [("db/Down", T0 + dt.timedelta(seconds=s)) for s in (1000, 2000)]
    closed = spark.createDataFrame(ends, "dedup_key STRING, closed_at TIMESTAMP")
    scoped = correlation._scoped(spark.createDataFrame(rows, ALERT_DDL), closed, None, None)
    placed = correlation._with_component(scoped, edges_df(spark), None, 0.62)
    assert correlation._reduced(placed, 86_400, True)[2].count() == 5  # three runs and two closings
    got = run(spark, rows, closures=closed)
    assert len(got) == 3000 and {r.incident_id for r in got.values()} == {0, 1001, 2001}


def test_arrival_order_scores_by_absolute_distance(spark):
    rows = [(*alert(1, 200, "db"), 0), (*alert(2, 100, "api"), 1)]
    df = spark.createDataFrame(rows, ALERT_DDL + ", seen INT")
    got = {r.alert_id: r for r in correlation.correlate(
        df, edges_df(spark), order="seen").collect()}
    assert got[2].incident_id == 1 and got[2].reasons[0] == "100s from the incident window"


def test_empty_graph_still_correlates_by_key(spark):
    got = run(spark, [alert(1, 0, "db"), alert(2, 5, "db"), alert(3, 6, "api")], edges=[("x", "y")])
    assert got[2].incident_id == 1 and got[3].kind == "new"


def test_storm_root_and_sweep(spark):
    alerts = [alert(i, i * 6, ["web", "api", "db"][i % 3], name=f"A{i}") for i in range(12)]
    df = spark.createDataFrame(alerts, ALERT_DDL).withColumns(
        {"alertname": F.col("labels")["alertname"], "fingerprint": F.col("dedup_key")})
    edges = edges_df(spark)
    assigned = correlation.correlate(df, edges)
    flags = {r.running: r for r in correlation.storm_flags(assigned, df).collect()}
    assert not flags[5].is_storm and flags[6].is_storm and flags[12].banner == 2
    assert correlation.root_signals(assigned, df, edges).first().service == "db"
    swept = {r.threshold: r for r in correlation.sweep(df, edges, [(300, 0.62), (300, 0.99)]).collect()}
    assert swept[0.62].incidents == 1 and swept[0.99].incidents > 1
    assert correlation.island_sizes(df, edges).agg(F.sum("alerts")).first()[0] == 12


def test_low_threshold_warns_and_still_merges(spark):
    with pytest.warns(UserWarning):
        got = run(spark, [alert(1, 0, None, key="a"), alert(2, 1, None, key="b")], threshold=0.5)
    assert got[2].incident_id == 1


def test_depth_and_components(spark):
    depth = {r.service: r.depth for r in depths(edges_df(spark)).collect()}
    assert depth == {"web": 0, "api": 1, "db": 2, "cache": 2, "jobs": 0, "mail": 0, "queue": 1}
    found = {r.service: r.component for r in components(edges_df(spark)).collect()}
    assert found["web"] == found["jobs"] == "api" and found["mail"] == found["queue"] == "mail"


def test_depth_in_cycles_counts_the_reentering_edge(spark):
    # a -> b -> c -> a, d above a, e below c
    rows = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("c", "e")]
    depth = {r.service: r.depth for r in depths(edges_df(spark, rows)).collect()}

    def walk(node, seen):
        up = [s for s, t in rows if t == node]
        if node in seen or not up:
            return 0
        return 1 + max(walk(s, seen | {node}) for s in up)

    assert depth == {n: walk(n, frozenset()) for n in "abcde"}


def plain_depths(rows):
    up = {n: [s for s, t in rows if t == n] for edge in rows for n in edge}

    def walk(node, seen):
        if node in seen or not up[node]:
            return 0
        return 1 + max(walk(s, seen | {node}) for s in up[node])

    return {n: walk(n, frozenset()) for n in up}


def test_depths_of_tangled_graphs(spark):
    rng = random.Random(2)
    for size, count in ((6, 9), (8, 16), (9, 14)):
        names = [f"n{i}" for i in range(size)]
        rows = sorted({(rng.choice(names), rng.choice(names)) for _ in range(count)})
        got = {r.service: r.depth for r in depths(edges_df(spark, rows)).collect()}
        assert got == plain_depths(rows), rows


def test_strong_components(spark):
    rows = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "c"), ("e", "f"), ("x", "a"), ("y", "y")]
    got = {r.service: r.scc for r in graph.strong_components(edges_df(spark, rows)).collect()}
    assert got == {"a": "b", "b": "b", "c": "e", "d": "e", "e": "e", "f": "f", "x": "x", "y": "y"}


def test_dense_and_long_cycles(spark):
    names = [f"n{i:02}" for i in range(20)]
    dense = [(a, b) for a in names for b in names if a != b]
    rows = [*dense, ("top", "n00"), ("n03", "below")]
    got = {r.service: r.depth for r in depths(edges_df(spark, rows)).collect()}
    assert got == {**{n: got[n] for n in names}, "top": 0, "below": 21}
    assert all(got[n] == 20 for n in names)
    ring = [(f"r{i}", f"r{(i + 1) % 200}") for i in range(200)]
    near = [[(i - 1) % 200] for i in range(200)]
    assert graph.longest_by_search(near, [None] * 200) == [200] * 200 and len(ring) == 200
    rng = random.Random(8)
    for _ in range(40):
        m = rng.randint(1, 7)
        near = [sorted(rng.sample(range(m), rng.randint(0, m))) for _ in range(m)]
        exits = [rng.choice([None, None, 0, 3]) for _ in range(m)]
        assert graph.longest_by_subsets(near, exits) == graph.longest_by_search(near, exits)


def test_a_cycle_beyond_search_is_an_error():
    rng = random.Random(1)
    m = 60
    near = [sorted({(i + 1) % m, *rng.sample(range(m // 2), 2)}) if i < m // 2 else [(i + 1) % m] for i in range(m)]
    with pytest.raises(ValueError, match="too entangled"):
        graph._longest_from(m - 1, near, [None] * m, m + 1)


def test_hops(spark):
    pairs = spark.createDataFrame(
        [("web", "web"), ("web", "api"), ("web", "db"), ("web", "jobs"), ("web", "mail"),
         ("zz", "zz")], "a STRING, b STRING")
    got = {(r.a, r.b): r.hops for r in hops_between(pairs, edges_df(spark)).collect()}
    assert got == {("web", "web"): 0, ("web", "api"): 1, ("web", "db"): 2, ("web", "jobs"): None,
                   ("web", "mail"): None, ("zz", "zz"): None}


def test_a_sweep_equals_one_run_per_setting(spark):
    rng = random.Random(11)
    rows = [alert(i, rng.randrange(40_000), rng.choice(["web", "api", "db", "mail", None]), rank=rng.choice([3, 4]),
                  name=rng.choice("ABC")) for i in range(160)]
    alerts, edges = spark.createDataFrame(rows, ALERT_DDL), edges_df(spark)
    settings = [(60, 0.62), (300, 0.62), (900, 0.7), (3600, 0.62), (900, 0.9), (900, 0.5)]
    ends = spark.createDataFrame([(rows[3][1], T0 + dt.timedelta(seconds=20_000))], "dedup_key STRING, closed_at TIMESTAMP")
    for options in ({}, {"closures": ends}, {"order": "id"}):
        got = {(r.window_s, r.threshold): (r.alerts, r.incidents, r.merges)
               for r in correlation.sweep(alerts, edges, settings, **options).collect()}
        assert set(got) == set(settings)
        for window_s, threshold in (settings[0], settings[2], settings[5]):
            kinds = [r.kind for r in correlation.correlate(
                alerts, edges, window_s=window_s, threshold=threshold, **options).select("kind").collect()]
            assert got[window_s, threshold] == (160, kinds.count("new"), kinds.count("merged"))
