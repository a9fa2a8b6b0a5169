"""Grounding, review text, impact and a recorded incident scored end to end."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from test_correlation import edges_df
from vigilake.operators import evaluation, grounding, metrics, replay, review
from vigilake.schemas import DRAFT_DDL
from vigilake.sources.files import read_recordings

T0 = dt.datetime(2024, 5, 1)


def cite(*refs):
    return [{"kind": "message", "ref": r} for r in refs]


DRAFT = {
    "summary": [{"text": "postgres primary lost its lease", "citations": cite("msg:1.0")},
                {"text": "unrelated words entirely different", "citations": cite("msg:2.0")},
                {"text": "1843 requests failed", "citations": cite("msg:9.9", "not a ref")}],
    "root_cause_hypothesis": {"text": "the Down alert fired", "citations": []},
    "action_items": [{"description": "add an alert for lease loss", "owner": "U9", "priority": "P1",
                      "category": "monitoring", "citations": cite("msg:1.0")}],
}


@pytest.fixture()
def draft(spark):
    df = spark.createDataFrame([(1, json.dumps(DRAFT))], "incident_id INT, body STRING")
    return df.select("incident_id", F.from_json("body", DRAFT_DDL).alias("draft"))


def test_walk_and_judge(spark, draft):
    claims = grounding.walk_claims(draft)
    assert [r.path for r in claims.orderBy("field", "position").collect()] == [
        "summary[0]", "summary[1]", "summary[2]", "root_cause_hypothesis", "action_items[0]"]
    rows = [(1, "message", "msg:1.0", "the postgres primary lost its lease, alert soon"), (1, "message", "msg:2.0", "pager lunch")]
    stored = spark.createDataFrame(rows, "incident_id INT, kind STRING, ref STRING, text STRING")
    nothing = spark.createDataFrame([], "incident_id INT, term STRING")
    judged = grounding.judge_citations(claims, stored, nothing)
    verdicts = {(r.path, r.ref): r.verdict for r in judged.collect()}
    assert verdicts == {
        ("summary[0]", "msg:1.0"): "ok", ("summary[1]", "msg:2.0"): "unsupported",
        ("summary[2]", "msg:9.9"): "fabricated", ("summary[2]", "not a ref"): "malformed_reference",
        ("action_items[0]", "msg:1.0"): "ok"}
    people = spark.createDataFrame([(1, "U1")], "incident_id INT, user STRING")
    numbers = spark.createDataFrame([(1, "42")], "incident_id INT, number STRING")
    found = {(r.path, r.reason) for r in grounding.findings(claims, judged, people, numbers).collect()}
    assert found == {
        ("summary[1]", "unsupported"), ("summary[2]", "fabricated"), ("summary[2]", "malformed_reference"),
        ("summary[2]", "ungrounded_number"), ("root_cause_hypothesis", "uncited"), ("action_items[0]", "non_participant")}
    covered = grounding.coverage(claims, judged).first()
    assert (covered.checked_claims, covered.checked_citations, covered.coverage) == (5, 5, 0.4)
    strong = spark.createDataFrame([(1, "pager")], "incident_id INT, term STRING")
    weak = claims.where("path = 'summary[1]'").withColumn("text", F.lit("one two three four five six seven pager"))
    assert grounding.judge_citations(weak, stored, strong).first().verdict == "ok"


def test_trim_keeps_both_ends(spark):
    rows = [(1, i, f"{i:04}") for i in range(450)] + [(2, i, f"{i:04}") for i in range(400)]
    df = spark.createDataFrame(rows, "incident_id INT, id INT, ts STRING")
    kept = grounding.trim_transcript(df)
    got = {r.incident_id: r.n for r in kept.groupBy("incident_id").agg(F.count("*").alias("n")).collect()}
    assert got == {1: 400, 2: 400}
    assert kept.where("incident_id = 1 AND id BETWEEN 200 AND 249").count() == 0


def test_impact_report(spark):
    ddl = "time TIMESTAMP, name STRING, labels MAP<STRING,STRING>, value DOUBLE"
    rows = []
    for minute in range(0, 240):
        at = T0 + dt.timedelta(minutes=minute)
        for status, step in (("200", 90.0), ("503", 10.0)):
            rows.append((at, "http_requests_total", {"service": "db", "status": status}, step * minute))
        for le, share in (("0.1", 50.0), ("0.5", 98.0), ("+Inf", 100.0)):
            rows.append((at, "http_request_duration_seconds_bucket", {"service": "db", "le": le}, share * minute))
        rows.append((at, "kube_pod_status_ready", {"namespace": "default", "condition": "false", "pod": "p1"}, 1.0))
    incidents = spark.createDataFrame(
        [(1, "db", None, T0 + dt.timedelta(minutes=10), T0 + dt.timedelta(minutes=190, seconds=30)), (2, "none", "x", T0, None)],
        "id INT, service STRING, namespace STRING, detected_at TIMESTAMP, resolved_at TIMESTAMP")
    samples = spark.createDataFrame(rows, ddl)
    report = metrics.impact(incidents, samples, "2024-05-01 03:00:00")
    got = {r.incident_id: r for r in report.collect()}
    assert got[1].minutes == 181 and got[1].failed_requests == 1810.0 and got[1].total_requests == 18100.0
    assert got[1].error_rate_pct == 10.0 and got[1].pods_unready == 1 and got[1].p99_latency_ms == 500.0
    assert got[2].total_requests is None and got[2].status == "computed"
    failed = spark.createDataFrame([(1, "query timed out")], "incident_id INT, reason STRING")
    gone = {r.incident_id: r for r in metrics.impact(incidents, samples, "2024-05-01 03:00:00", failed).collect()}
    assert gone[1].status == "unavailable" and gone[1].failed_requests is None and gone[2].status == "computed"
    windows = metrics.impact_windows(report).where("incident_id = 1 AND key = 'failed_requests'").first()
    assert windows.query == 'sum(increase(http_requests_total{service="db",status=~"5.."}[181m]))'


def test_counter_reset_and_holding(spark):
    rows = [(T0 + dt.timedelta(minutes=i), "s", v) for i, v in enumerate([5.0, 8.0, 2.0, 2.0, 6.0])]
    grown = metrics.increments(spark.createDataFrame(rows, "time TIMESTAMP, series STRING, value DOUBLE"))
    assert [r.increase for r in grown.orderBy("time").collect()] == [0.0, 3.0, 2.0, 0.0, 4.0]
    flags = [True, True, True, None, True, False, True]
    rows = [("a", T0 + dt.timedelta(minutes=i), f) for i, f in enumerate(flags)]
    held = metrics.held_for(spark.createDataFrame(rows, "k STRING, at TIMESTAMP, hit BOOLEAN"), ["k"], "hit", 2, "fires")
    assert [r.fires for r in held.orderBy("at").collect()] == [False, False, True, False, False, False, False]


@pytest.mark.parametrize("cell_s", [60, 120, 600, 86_400])
def test_holding_across_cells(spark, cell_s):
    rng = random.Random(cell_s)
    rows = []
    for k in ("a", "b", None):
        state = True
        for i in sorted(rng.sample(range(400), 150)):
            state = state if rng.random() < 0.93 else not state
            rows.append((k, T0 + dt.timedelta(seconds=20 * i), state if rng.random() < 0.97 else None, rng.randrange(9)))
    df = spark.createDataFrame(rows, "k STRING, at TIMESTAMP, hit BOOLEAN, other INT").repartition(5)
    held = metrics.held_for(df, ["k"], "hit", 3, "fires", cell_s=cell_s)
    assert held.columns == ["k", "at", "hit", "other", "fires"]
    want, since = {}, {}
    for k, at, hit, _ in rows:
        since[k] = (since.get(k) or at) if hit else None
        want[k, at] = bool(hit) and (at - since[k]).total_seconds() >= 180
    got = {(r.k, r.at): r.fires for r in held.collect()}
    assert got == want and any(want.values()) and not all(want.values())


def test_holding_has_no_window_over_a_whole_series(spark):
    rows = spark.range(20_000).select(F.lit("one").alias("k"), F.timestamp_seconds(F.col("id") * 60).alias("at"),
                                   (F.col("id") % 7000 != 6999).alias("hit"))
    held = metrics.held_for(rows, ["k"], "hit", 2, "fires", cell_s=3600)
    assert held.where("not fires").count() == 2 + 2 * 3  # the first two steps of each run, and each break
    plan = held._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    # rows are ordered inside a cell; only the cells' own summaries are ordered per series
    assert len(windows) >= 4 and all("_cell" in line for line in windows)


def test_draft_document(spark, draft):
    claims = grounding.walk_claims(draft)
    incidents = spark.createDataFrame([(1, "inc-1", "lease lost", "sev1", "db")],
                                      "incident_id INT, public_key STRING, title STRING, severity STRING, service STRING")
    report = spark.createDataFrame([(1, "computed", None, 2.02, 1843.0, 4120.0, 3, 91200.0)],
                                   "incident_id INT, status STRING, reason STRING, error_rate_pct DOUBLE, failed_requests DOUBLE, "
                                   "p99_latency_ms DOUBLE, pods_unready INT, total_requests DOUBLE")
    text = review.assemble(review.draft_lines(incidents, claims, report)).first().text
    lines = text.split("\n")
    assert lines[:3] == ["# inc-1 — lease lost", "", "**Severity** SEV1  ·  **Service** db"]
    assert "| `failed_requests` | 1843 |" in lines and "| `error_rate_pct` | 2.02 |" in lines
    assert "- postgres primary lost its lease  `msg:1.0`" in lines
    assert "| P1 | <@U9> | add an alert for lease loss | `msg:1.0` |" in lines
    assert lines.index("## Summary") < lines.index("## Root cause") < lines.index("## Action items")
    assert "## Timeline" not in lines
    assert review.assemble(review.draft_lines(incidents, claims, report)).count() == 1


def recording(number, expects=True, draft=None, extra=()):
    ts = f"{int((T0 + dt.timedelta(seconds=60)).replace(tzinfo=dt.timezone.utc).timestamp())}.000100"
    content = draft or {"summary": [{"text": "looking at the lease dashboard", "citations": cite(f"msg:{ts}")}],
                        "action_items": [{"description": "alert on lease loss", "owner": "U1", "priority": "P1",
                                          "category": "monitoring", "citations": cite(f"msg:{ts}")}]}
    alert = {"status": "firing", "startsAt": "2024-05-01T00:00:00Z", "labels": {"alertname": "Down", "service": "db", "severity": "critical"}}
    lines = [{"format": 1, "incident": number, "bucket": "real" if expects else "flapping", "title": "t", "start": "2024-05-01T00:00:00Z"},
             {"t": 0, "kind": "alert", "payload": alert}, {"t": 30, "kind": "alert", "payload": alert},
             {"t": 60, "kind": "chat.event.message", "payload": {"user": "U1", "text": "looking at the lease dashboard, alert loss"}},
             *extra,
             {"t": 90, "kind": "llm", "role": "synthesize", "response": {
                 "content": json.dumps(content), "input_tokens": 1000, "output_tokens": 100, "latency_ms": 900}},
             {"t": 99, "kind": "ground_truth", "labels": {
                 "expects_pir": expects, "expected_incidents": 1, "timeline": [{"t": 65, "intent": "investigation"}],
                 "action_items": ["alert on lease loss", "buy a pony farm"]}}]
    return "\n".join(json.dumps(x) for x in lines)


def test_replay_scores(spark, tmp_path):
    fake = {"summary": [{"text": "looking at it", "citations": cite("msg:1.5")}]}
    (tmp_path / "1.jsonl").write_text(recording(1))
    (tmp_path / "2.jsonl").write_text(recording(2, expects=False))
    (tmp_path / "3.jsonl").write_text(recording(3, draft=fake))
    parsed = replay.Recordings(*read_recordings(spark, str(tmp_path / "*.jsonl")))
    scores = replay.replay(parsed, edges_df(spark), input_rate=1.0, output_rate=10.0)
    got = {r.recording: r for r in scores.collect()}
    assert (got[1].layer, got[1].timeline_f1, got[1].action_item_recall, got[1].citation_precision) == ("primary", 1.0, 0.5, 1.0)
    assert got[1].cost_usd == 0.002 and got[1].storm_compression == 1.0
    assert (got[2].layer, got[2].timeline_f1) == ("none", 1.0)
    assert (got[3].layer, got[3].unexpected_skeleton, got[3].action_item_recall) == ("skeleton", 1, 0.0)
    rows = spark.createDataFrame(list(got.values()), scores.schema)
    checks = evaluation.gate(evaluation.metric_rows(evaluation.corpus_metrics(rows)),
                             spark.createDataFrame([("timeline_f1", 0.9)], "metric STRING, value DOUBLE"))
    failed = {r.metric for r in checks.where("NOT passed").collect()}
    assert failed == {"unexpected_skeleton"}
    assert not evaluation.gate_summary(checks).first().passed


def test_agreement_of_constant_raters(spark):
    pairs = spark.createDataFrame([(i, "a", 2, 2) for i in range(4)], "item INT, dimension STRING, human INT, judge INT")
    assert {r.kappa for r in evaluation.agreement(pairs).collect()} == {1.0}
