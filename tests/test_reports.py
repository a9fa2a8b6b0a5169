"""Smaller operators: feedback, epochs, completeness, review skeletons, delivery burn, tenants."""

import datetime as dt

from pyspark.sql import functions as F

from test_correlation import ALERT_DDL, T0, alert, edges_df
from vigilake.operators import correlation, metrics, review, rollups, store, sweeps


def test_feedback_epochs_and_tenants(spark):
    alerts = [alert(1, 0, "db"), alert(2, 60, "api"), alert(3, 3 * 86_400, "db"), alert(4, 10, "db", key="other")]
    df = spark.createDataFrame(alerts, ALERT_DDL).withColumn("team", F.when(F.col("id") == 4, "b").otherwise("a"))
    assigned = correlation.correlate(df, edges_df(spark), tenant="team")
    got = {r.alert_id: (r.kind, r.epoch) for r in assigned.collect()}
    assert got == {1: ("new", 0), 2: ("merged", 0), 3: ("new", 1), 4: ("new", 0)}
    closed = spark.createDataFrame([("db/Down", T0 + dt.timedelta(seconds=30), "a")],
                                   "dedup_key STRING, closed_at TIMESTAMP, team STRING")
    again = {r.alert_id: r.kind for r in correlation.correlate(
        df, edges_df(spark), tenant="team", closures=closed).collect()}
    assert again == {1: "new", 2: "new", 3: "new", 4: "new"}
    facts = {r.incident_id: (r.correlated_alert_count, r.services) for r in correlation.incidents_of(assigned, df).collect()}
    assert facts[1] == (2, 2)
    splits = spark.createDataFrame([(1, 2, None, "ann")], "incident_id INT, alert_id LONG, action STRING, actor STRING")
    feedback = correlation.correlation_feedback(splits, assigned)
    row = feedback.first()
    assert row.action == "split" and row.original_score > 0.62 and len(row.original_reasons) == 3
    assert {r.reason for r in correlation.feedback_by_reason(feedback).collect()} == {"time", "topology", "labels"}


def test_keys_and_epochs(spark):
    rows = [(1, "k", T0), (2, "k", T0 + dt.timedelta(days=2)), (3, "j", T0)]
    df = spark.createDataFrame(rows, "id INT, dedup_key STRING, detected_at TIMESTAMP")
    assert {r.id: r.dedup_epoch for r in store.dedup_epochs(df).collect()} == {1: 0, 2: 1, 3: 0}
    key = store.idempotency_key(F.col("id"), F.lit("page"), F.lit(None).cast("string"))
    assert df.select(key.alias("k")).distinct().count() == 3


def test_completeness_compares_sets_and_empty_is_whole(spark):
    ddl = "channel_id STRING, ts STRING"
    history = spark.createDataFrame([("C", f"{i:02}") for i in range(20)], ddl)
    stored = spark.createDataFrame([("C", f"{i:02}") for i in range(0, 19)], ddl)
    channels = spark.createDataFrame([("C",), ("D",)], "channel_id STRING")
    got = {r.channel_id: (r.sampled, r.held, r.ratio) for r in sweeps.completeness_of_channels(channels, history, stored).collect()}
    assert got == {"C": (15, 14, 14 / 15), "D": (0, 0, 1.0)}
    assert sweeps.held_messages(history, stored).count() == 19


def test_skeleton_document(spark):
    incidents = spark.createDataFrame(
        [(1, "inc-1", "t", "sev2", T0, T0 + dt.timedelta(minutes=125), "Disk Full", "Down", None, "f1"),
         (2, "inc-2", "u", "sev3", T0, None, None, None, None, None)],
        "incident_id INT, public_key STRING, title STRING, severity STRING, detected_at TIMESTAMP, resolved_at TIMESTAMP, "
        "runbook_name STRING, root_alertname STRING, root_service STRING, root_fingerprint STRING")
    report = spark.createDataFrame([(1, "computed", None, None, 3.0, 0.25, 2, 1234567.0)],
                                   "incident_id INT, status STRING, reason STRING, error_rate_pct DOUBLE, failed_requests DOUBLE, "
                                   "p99_latency_ms DOUBLE, pods_unready INT, total_requests DOUBLE")
    timeline = spark.createDataFrame([(1, T0 + dt.timedelta(minutes=i), "investigation", None, f"entry {i}", f"{i}-x") for i in range(3)],
                                     "incident_id INT, time TIMESTAMP, intent STRING, author_user_id STRING, description STRING, timeline_id STRING")
    deploys = spark.createDataFrame([(1, "abc", "db", T0, 1)], "incident_id INT, sha STRING, service STRING, deployed_at TIMESTAMP, rank INT")
    counts = spark.createDataFrame([(1, 9, 3, 4, 2, 5), (2, 0, 0, 0, 0, 0)],
                                   "incident_id INT, messages INT, events INT, alerts INT, steps INT, participants INT")
    docs = {r.incident_id: r.text.split("\n") for r in review.assemble(
        review.skeleton_lines(incidents, report, timeline, deploys, counts)).collect()}
    first, second = docs[1], docs[2]
    assert first[2] == "# inc-1 — t" and first[4].endswith("**Duration** 2h 5m") and second[4].endswith("ongoing")
    assert "| `p99_latency_ms` | 0.25 |" in first and "| `total_requests` | 1.23457e+06 |" in first
    assert not any("error_rate_pct" in line for line in first)
    assert "- `12:01:00` **investigation** — entry 1  `tl:1-x`" in [x.replace("00:01:00", "12:01:00") for x in first]
    assert "- **Root signal** `Down` on `unknown` `alert:f1`" in first
    assert "- **Runbook** Disk Full (2 steps recorded)" in first
    assert "_No classified events were recorded for this incident._" in second
    assert "_Reason: no metrics adapter configured_" in second
    assert first[-1].startswith("_Generated from 9 stored messages, 3 timeline events and 4 alerts.")


def test_delivery_burn_and_latency_sketch(spark):
    rows = [("s", T0 + dt.timedelta(minutes=i), 0.2, 0.1) for i in range(12)]
    df = spark.createDataFrame(rows, "slo STRING, at TIMESTAMP, ratio_1h DOUBLE, ratio_6h DOUBLE")
    fired = metrics.delivery_fast_burn(df, ["slo"]).where("firing").count()
    assert fired == 2
    calls = spark.range(1000).select(F.lit(T0).alias("time"), F.lit("r").alias("role"), F.lit("m").alias("model"),
                                     F.col("id").cast("int").alias("latency_ms"))
    near = rollups.latency_quantile(rollups.llm_latency_daily(calls), ["role"], 0.5).first().latency_ms
    assert abs(near - 500) < 30
