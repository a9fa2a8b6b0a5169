"""On-call, severity, runbook, store and percentile cases worked by hand."""

import datetime as dt
import random
import re

import pytest

from pyspark.sql import functions as F

from vigilake.functions.skew import exact_percentile, nearest_rank
from vigilake.operators import audit, oncall, reports, rollups, runbooks, severity, similarity, store

T0 = dt.datetime(2024, 5, 1, 12)


def test_fatigue_hours_streaks_and_unclipped_minutes(spark):
    hours = lambda h: T0 - dt.timedelta(hours=h)
    pages = [
        ("ann", T0, 1, "sev1", "UTC"), ("ann", hours(8), 1, "sev3", "UTC"),  # 04:00 is night; the 8 h edge is open
        ("ann", hours(13.5), 2, "sev3", "UTC"),  # 22:30 still counts as day
        ("ann", hours(12.5), None, "sev3", "UTC"),  # 23:30 is night
        ("bob", hours(30), None, "sev1", "Asia/Kolkata"), ("cid", hours(24 * 8), None, "sev1", "UTC"),
        ("ann", T0 + dt.timedelta(hours=1), 1, "sev1", "UTC"),  # after the instant
    ]
    df = spark.createDataFrame(pages, "responder STRING, time TIMESTAMP, incident_id INT, severity STRING, tz STRING")
    incidents = spark.createDataFrame([(1, hours(50), None), (2, hours(14), hours(13))],
                                      "id INT, detected_at TIMESTAMP, resolved_at TIMESTAMP")
    got = {r.responder: r for r in oncall.fatigue_windows(df, incidents, T0).collect()}
    assert set(got) == {"ann", "bob"}
    ann = got["ann"]
    assert (ann.pages_8h, ann.night_pages_24h, ann.sev1_count_7d) == (1, 2, 1)
    assert ann.incident_minutes_24h == 50 * 60 + 60 and ann.consecutive_oncall_days == 2
    ask = spark.createDataFrame([("zoe",)], "responder STRING")
    empty = oncall.window_for(oncall.fatigue_windows(df, incidents, T0), ask).first()
    assert oncall.fatigue_scores(spark.createDataFrame([empty])).first().score == 0.0


def test_routing_targets_and_reasons(spark):
    rows = [("a", 4, 4, 3, 500, 6), ("b", 2, 1, 0, 130, 0), ("c", 0, 0, 0, 0, 0)]
    windows = spark.createDataFrame(rows, "responder STRING, pages_8h INT, night_pages_24h INT, sev1_count_7d INT, "
                                          "incident_minutes_24h INT, consecutive_oncall_days INT")
    scores = oncall.fatigue_scores(windows)
    assert scores.where("responder = 'a'").first().reasons == [
        "4 pages in 8h", "4 outside 08:00-22:00 local", "500 min in incidents in 24h"]
    rota = spark.createDataFrame([("s1", "a", "x"), ("s2", "b", "y"), ("s3", "c", None), ("s4", None, None), ("s5", "a", None)],
                                 "schedule STRING, primary STRING, secondary STRING").withColumns(
        {"source": F.lit("static_schedule"), "reason": F.lit("down"), "team_channel": F.lit("#team")})
    got = {r.schedule: (r.page, r.notify, r.invite, r.broadcast_channel) for r in oncall.routing_plan(rota, scores).collect()}
    assert got == {"s1": (["x"], ["a"], ["a", "x"], None), "s2": (["b"], ["y"], ["b", "y"], None),
                   "s3": (["c"], [], ["c"], None), "s4": ([], [], [], "#team"), "s5": (["a"], [], ["a"], None)}


def test_oncall_ladder(spark):
    people = "schedule STRING, primary STRING, secondary STRING"
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "schedule STRING")
    cache = spark.createDataFrame([("a", "c1", None)], people)
    provider = spark.createDataFrame([("a", "p1", None, None), ("b", "p2", "p3", None), ("c", None, None, "503")],
                                     people + ", error STRING")
    rota = spark.createDataFrame([("c", "r1", "r2", "#t")], people + ", team_channel STRING")
    got = {r.schedule: (r.source, r.primary, r.reason) for r in oncall.resolve_oncall(asked, cache, provider, rota).collect()}
    assert got == {"a": ("cache", "c1", None), "b": ("provider", "p2", None),
                   "c": ("static_schedule", "r1", "paging provider unavailable: 503"),
                   "d": ("team_broadcast", None, "paging provider returned no on-call")}


def test_rota_default_and_floor_before_epoch(spark):
    rota = spark.createDataFrame([("default", ["x", "y", "z"], 7, "#d")],
                                 "schedule STRING, members ARRAY<STRING>, period_days INT, team_channel STRING")
    asked = spark.createDataFrame([("any", dt.datetime(2026, 1, 12)), ("any", dt.datetime(2026, 1, 4))],
                                  "schedule STRING, at TIMESTAMP")
    got = {r.at.day: (r.primary, r.secondary) for r in oncall.resolve_rota(asked, rota).collect()}
    assert got == {12: ("y", "z"), 4: ("z", "x")}


def test_severity_words_and_refusal(spark):
    facts = spark.createDataFrame([("sev4", 1, 1, 0, 14.4), ("odd", None, 3, 1, None), ("sev2", 3, 5, 2, 3.0)],
                                  "alert_severity STRING, service_tier INT, affected_services INT, tier_one_services INT, burn DOUBLE")
    assert [r.reason for r in severity.assess_severity(facts).collect()] == [
        "sev1: alert label sev4 + tier-1 service + error budget burn 14.4x",
        "sev2: alert label odd + 3 services affected", "sev1: alert label sev2 + 2 tier-1 services affected"]
    asked = spark.createDataFrame([("sev2", "sev3", "ann", ""), ("sev3", "sev1", "ann", "why")],
                                  "current STRING, target STRING, actor STRING, note STRING")
    assert [r.reason for r in severity.escalate(asked).collect()] == [
        "sev2: de-escalation to sev3 requested by ann — refused", "sev1: escalated from sev3 by ann (why)"]


def test_runbook_choice(spark):
    books = spark.createDataFrame([(1, "a.md", "Disk.*", None, None), (2, "b.md", "disk", "sev1", None),
                                   (3, "c.md", "disk", None, "^pay"), (4, "d.md", "Other", None, None)],
                                  "id INT, position STRING, alert_pattern STRING, severity_filter STRING, service_filter STRING")
    seen = spark.createDataFrame([(1, "DiskFull", None, "sev2", "db"), (2, "DiskFull", None, "sev1", "db"),
                                  (3, "DiskFull", None, "sev1", "Pay-api"), (4, "Nope", "AnotherThing", None, None),
                                  (5, None, "none", None, None)],
                                 "id INT, root_signal STRING, alertname STRING, severity STRING, service STRING")
    got = {r.id: (r.runbook_id, r.score, r.source) for r in runbooks.match_runbooks(seen, books).collect()}
    assert got == {1: (1, 1, "root_signal"), 2: (2, 2, "root_signal"), 3: (3, 3, "root_signal"), 4: (4, 1, "alertname")}


def test_step_signals(spark):
    ddl = "incident_id INT, runbook_id INT, step_id STRING, source_message_ts STRING, observed_at TIMESTAMP"
    books = spark.createDataFrame([(1, ["a", "b"])], "id INT, step_ids ARRAY<STRING>")
    said = spark.createDataFrame([(7, 1, "a", "1", T0)], ddl)
    reacted = spark.createDataFrame([(7, 1, "a", "0", T0 - dt.timedelta(minutes=1)), (7, 1, "zz", None, T0)], ddl)
    typed = spark.createDataFrame([(7, 1, "b", None, T0)], ddl)
    got = {(r.step_id, r.detected_by) for r in runbooks.step_signals(said, reacted, typed, books).collect()}
    assert got == {("a", "reaction"), ("b", "slash_command")}


def test_percentiles_match_sorting(spark):
    rng = random.Random(5)
    groups = {"big": [rng.random() * 100 for _ in range(60_000)], "tiny": [3.0], "few": [1.0, 2.0, 10.0, 4.0]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k STRING, v DOUBLE")
    for p in (0.5, 0.95):
        got = {r.k: r.q for r in exact_percentile(df, ["k"], "v", p, "q").collect()}
        want = {r.k: r.q for r in df.groupBy("k").agg(F.percentile("v", p).alias("q")).collect()}
        assert all(abs(got[k] - want[k]) < 1e-12 for k in groups)
    near = {r.k: r.q for r in nearest_rank(df, ["k"], "v", 0.95, "q").collect()}
    for k, vs in groups.items():
        assert near[k] == sorted(vs)[max(0, min(len(vs) - 1, round(0.95 * len(vs)) - 1))]


def test_model_ledger_rules(spark):
    rows = [(1, "r", "default", 100, None, None), (2, "r", "default", 100, "e", None), (3, "q", "shadow", 5, None, None)]
    df = spark.createDataFrame(rows, "id INT, role STRING, state STRING, traffic_pct INT, eval_run_id STRING, ended_at TIMESTAMP")
    got = {(r.id, r.rule) for r in audit.violations(df, "model_deployments", "id").collect()}
    assert got == {(1, "default_without_evidence"), (3, "shadow_with_traffic")}
    assert audit.rival_defaults(df).first().role == "r"


def test_revisions_continue_after_stored_ones(spark):
    ddl = "channel_id STRING, ts STRING, kind STRING, text STRING, observed_at TIMESTAMP"
    at = lambda m: T0 + dt.timedelta(minutes=m)
    known = spark.createDataFrame([("C", "1")], "channel_id STRING, ts STRING")
    old = spark.createDataFrame([("C", "1", "edited", "a", at(0), 1)], ddl + ", revision INT")
    new = spark.createDataFrame([("C", "1", "edited", "a", at(1)), ("C", "1", "deleted", None, at(2)),
                                 ("C", "1", "deleted", None, at(3)), ("C", "9", "edited", "x", at(3))], ddl)
    got = [(r.kind, r.revision) for r in store.append_revisions(new, known, old).collect()]
    assert got == [("deleted", 2)]


def test_no_embedding_gives_no_neighbours(spark):
    rows = [(1, "a", "t", T0, None), (2, "b", "t", T0, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "id INT, public_key STRING, title STRING, detected_at TIMESTAMP, embedding ARRAY<FLOAT>")
    items = spark.createDataFrame([], "incident_id INT, status STRING")
    assert similarity.repeat_incidents(df, items, 1).count() == 0
    assert similarity.repeat_incidents(df, items, 99).count() == 0


def test_empty_ratio_is_null(spark):
    df = spark.createDataFrame([(T0, 5, 3)], "detected_at TIMESTAMP, parent_incident_id INT, correlated_alert_count INT")
    assert reports.storm_compression(df, T0 + dt.timedelta(days=1)).first().ratio is None


def test_rollup_refresh_replaces_only_its_days(spark, tmp_path):
    ddl = "time TIMESTAMP, responder STRING, severity STRING"
    rows = [(T0 - dt.timedelta(days=d), "a", "sev1") for d in range(6)]
    target = str(tmp_path / "r")
    df = spark.createDataFrame(rows, ddl)
    rollups.refresh(rollups.page_load_daily, df, target, T0, 10)
    rollups.refresh(rollups.page_load_daily, df.union(df), target, T0, 3)
    got = {str(r.day): r.pages for r in spark.read.parquet(target).collect()}
    assert got == {"2024-04-26": 1, "2024-04-27": 1, "2024-04-28": 1, "2024-04-29": 2, "2024-04-30": 2}


def test_runbook_patterns_in_both_spellings(spark):
    books = spark.createDataFrame(
        [(1, "a", "(?P<what_it>Disk)(?P=what_it)?Full", None, None), (2, "b", "état", None, None), (3, "c", "(?(1)a|b)", None, None),
         (4, "d", "Queue", None, "(unclosed")],
        "id INT, position STRING, alert_pattern STRING, severity_filter STRING, service_filter STRING")
    seen = spark.createDataFrame(
        [(1, "diskfull", None), (2, "ÉTATDisque", None), (3, "b", None), (4, "Queue", "db")],
        "id INT, root_signal STRING, service STRING").selectExpr("*", "root_signal AS alertname", "CAST(NULL AS STRING) AS severity")
    got = {r.id: r.runbook_id for r in runbooks.match_runbooks(seen, books).collect() if r.runbook_id is not None}
    assert got == {1: 1, 2: 2}
    problems = {r.id: r.problem for r in runbooks.pattern_problems(books).collect()}
    assert problems == {3: "alert_pattern is not valid regex", 4: "service_filter is not valid regex"}


@pytest.mark.parametrize("pattern,words", [
    ("Disk.*Full", ["disk"]), ("(?:lag|queue) depth", [" depth"]), ("a|bcd", []), ("(cpu|memory)", ["cpu", "memory"]),
    ("x*", []), ("(abc)?", []), ("(abc)+d", ["abc"]), ("[abc]def", ["def"]), ("(unclosed", []), ("état", ["tat"]), ("ab", []),
    ("(?i:KAFKA)[0-9]", ["kafka"]), ("(?=lookahead)", []), ("^pay-(api|web)$", ["pay-"]),
])
def test_required_words(pattern, words):
    assert runbooks.required_words(pattern) == words


def test_patterns_meet_only_where_they_may_match(spark):
    rng = random.Random(7)
    parts = ["Disk", "Full", "K", "s", "lag", "Queue", "ı", "é", "-", "x1"]
    names = ["".join(rng.choices(parts, k=rng.randint(1, 5))) for _ in range(60)] + ["Kafka", "Diſk"]
    patterns = ["disk", "(full|queue)", ".", "lag+", "^k", "q.eue.*lag", "(", "ka(f)ka", "x[0-9]", "é-", "dıs", "full(?!K)", "(?:lag){2}"]
    ddl = "id INT, position INT, alert_pattern STRING, severity_filter STRING, service_filter STRING"
    books = spark.createDataFrame(
        [(i, -i, p, rng.choice([None, "sev1"]), rng.choice([None, "a|b"])) for i, p in enumerate(patterns)], ddl)
    rows = [(i, n, None, rng.choice(["sev1", "sev2", None]), rng.choice(["ab", "c", None])) for i, n in enumerate(names)]
    seen = spark.createDataFrame(rows, "id INT, root_signal STRING, alertname STRING, severity STRING, service STRING")
    got = {r.id: (r.runbook_id, r.score) for r in runbooks.match_runbooks(seen, books).collect()}
    want = {}
    for i, name, _, severity, service in rows:
        options = []
        for b in books.collect():
            try:
                hit = re.search(b.alert_pattern, name, re.I)
            except re.error:
                continue
            fits = b.severity_filter in (None, severity) and (
                b.service_filter is None or service is not None and re.search(b.service_filter, service, re.I))
            if hit and fits:
                options.append((-(1 + (b.severity_filter is not None) + 2 * (b.service_filter is not None)), b.position, b.id))
        if options:
            want[i] = (min(options)[2], -min(options)[0])
    assert got == want and len(set(b for b, _ in want.values())) > 4


def test_steps_by_automaton_and_by_words(spark, monkeypatch):
    rng = random.Random(3)
    words = ["restart", "start", "art", "db-primary", "rollout", "undo", "scale", "replicas", "--now", "pods"]
    steps = [(n % 3, n, f"s{n}", "```\n" + " ".join(rng.sample(words, rng.randint(1, 6))) + "\n```") for n in range(12)]
    steps.append((1, 99, "none", "no command"))
    books = spark.createDataFrame(steps, "runbook_id INT, position INT, step_id STRING, body STRING")
    said = [(i, rng.choice([0, 1, 2, 7, None]), rng.choice([None, "x " + "".join(rng.choices([*words, " "], k=5)).upper()])) for i in range(120)]
    messages = spark.createDataFrame(said, "id INT, runbook_id INT, text STRING")
    found = lambda: {r.id: (r.step_id, r.hits) for r in runbooks.detect_steps(messages, books).collect()}
    by_automaton = found()
    monkeypatch.setattr(runbooks, "AUTOMATON_WORDS", 0)
    assert found() == by_automaton and len(by_automaton) > 20
