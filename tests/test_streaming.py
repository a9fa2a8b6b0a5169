"""Streams give what the batch operators give, and redelivery changes nothing."""

import datetime as dt
import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from test_correlation import ALERT_DDL, EDGES, T0, alert, edges_df
from vigilake.operators.correlation import Loop, correlate
from vigilake.operators import metrics
from vigilake.operators.rollups import (
    incident_daily,
    latency_quantile,
    llm_cost_daily,
    llm_latency_daily,
    page_load_daily,
)
from vigilake.streaming import correlate as streaming_correlation
from vigilake.streaming import ingest, rollups


def drain(stream, path, checkpoint):
    query = (
        stream.writeStream.format("parquet").option("path", str(path))
        .option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def test_stream_correlation_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = [
        alert(i, i * rng.choice([20, 25]), rng.choice(["web", "api", "db", "mail"]), rank=rng.choice([3, 4]),
              name=rng.choice("AB"))
        for i in range(80)
    ]
    rows.sort(key=lambda r: (r[5], r[0]))
    for part in range(4):
        spark.createDataFrame(rows[part * 20:part * 20 + 20], ALERT_DDL).coalesce(1).write.parquet(
            str(tmp_path / f"in/{part}"))
    stream = spark.readStream.schema(ALERT_DDL).option("maxFilesPerTrigger", 1).option(
        "recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    edges = edges_df(spark)
    out = streaming_correlation.correlate_stream(stream, edges)
    drain(out, tmp_path / "out", tmp_path / "ck")
    got = {r.alert_id: r.incident_id for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = correlate(spark.createDataFrame(rows, ALERT_DDL), edges)
    assert got == {r.alert_id: r.incident_id for r in batch.collect()} and len(got) == 80
    assert EDGES


def envelope(name, second, **extra):
    at = (T0 + dt.timedelta(seconds=second)).strftime("%Y-%m-%dT%H:%M:%SZ")
    labels = {"alertname": name, "service": "db", "severity": "critical"}
    return {"status": "firing", "alerts": [
        {"labels": labels, "annotations": {}, "startsAt": at, "endsAt": "0001-01-01T00:00:00Z", **extra}]}


def write_lines(path, payloads):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(json.dumps(p) for p in payloads) + "\n")


def test_alerts_are_stored_once_and_rejects_kept(spark, tmp_path):
    source = tmp_path / "in"
    write_lines(source / "a.json", [envelope("Down", 0), envelope("Down", 0), envelope("Slow", 5)])
    sink = ingest.alert_sink(*[str(tmp_path / n) for n in ("alerts", "bad", "resolved", "seen")])
    ingest.run_once(ingest.payload_stream(spark, str(source)), sink, str(tmp_path / "ck"))
    broken = envelope("Down", 0)
    broken["alerts"][0]["startsAt"] = "soon"
    write_lines(source / "b.json", [envelope("Down", 0), broken, envelope("Late", 9, status="resolved")])
    (source / "c.json").write_text("{not json\n")
    ingest.run_once(ingest.payload_stream(spark, str(source)), sink, str(tmp_path / "ck"))
    stored = spark.read.parquet(str(tmp_path / "alerts"))
    assert sorted(r.alertname for r in stored.collect()) == ["Down", "Slow"]
    bad = spark.read.parquet(str(tmp_path / "bad")).collect()
    assert sorted(r.reject for r in bad) == ["alert has no parseable startsAt", "malformed json"]
    done = spark.read.parquet(str(tmp_path / "resolved")).collect()
    assert [(r.alertname, r.status) for r in done] == [("Late", "resolved")]
    seen = ingest.with_sightings(stored, spark.read.parquet(str(tmp_path / "seen"))).collect()
    assert {r.alertname: r.seen_count for r in seen} == {"Down": 3, "Slow": 1} and seen[0].last_seen_at


def test_a_second_stream_keeps_what_the_first_one_saw(spark, tmp_path):
    """A fresh checkpoint numbers its batches from 0 again; rejects and sightings add up, replays do not."""
    sink = ingest.alert_sink(*[str(tmp_path / n) for n in ("alerts", "bad", "resolved", "seen")])
    broken = envelope("Down", 0)
    broken["alerts"][0]["startsAt"] = "soon"
    for n in range(2):
        write_lines(tmp_path / f"in{n}/a.json", [envelope("Down", 0), broken])
        ingest.run_once(ingest.payload_stream(spark, str(tmp_path / f"in{n}")), sink, str(tmp_path / f"ck{n}"))
    seen = lambda: ingest.with_sightings(
        spark.read.parquet(str(tmp_path / "alerts")), spark.read.parquet(str(tmp_path / "seen"))).first().seen_count
    assert seen() == 2 and spark.read.parquet(str(tmp_path / "bad")).count() == 2
    # the last batch again, as after a crash before its commit
    (tmp_path / "ck1/commits/0").unlink()
    (tmp_path / "ck1/commits/.0.crc").unlink(missing_ok=True)
    ingest.run_once(ingest.payload_stream(spark, str(tmp_path / "in1")), sink, str(tmp_path / "ck1"))
    assert seen() == 2 and spark.read.parquet(str(tmp_path / "bad")).count() == 2


def test_revisions_are_stored_by_the_message_day(spark, tmp_path):
    incidents = spark.createDataFrame([(7, "C1")], "id BIGINT, chat_channel_id STRING")
    sink = ingest.transcript_sink(incidents, *[str(tmp_path / n) for n in ("m", "t", "s", "r", "bad")])
    said = [{"type": "message", "channel": "C1", "ts": f"{1700000000 + 86400 * d}.000001", "user": "U1", "text": "rolled back",
             "event_time": "2023-11-20T22:13:20Z"} for d in range(3)]
    edits = [{"subtype": "message_changed", "channel": "C1", "event_time": f"2023-12-0{n + 1}T00:00:00Z",
              "message": {"ts": said[n % 2]["ts"], "text": f"edit {n}"}} for n in range(4)]
    frame = lambda rows: spark.createDataFrame([(json.dumps(r),) for r in rows], "value STRING")
    sink(frame(said), 0)
    for n in range(4):
        sink(frame(edits[n:n + 1]), n + 1)
    sink(frame(edits[3:]), 5)
    log = spark.read.parquet(str(tmp_path / "r"))
    assert sorted((str(r.day), r.revision) for r in log.collect()) == [
        ("2023-11-14", 1), ("2023-11-14", 2), ("2023-11-15", 1), ("2023-11-15", 2)]


def test_transcript_survives_redelivery_and_logs_edits(spark, tmp_path):
    said = ["looking at the dashboard", "rolled back", "ok", "restarting db", "all green"]
    events = [
        {"type": "message", "channel": "C1", "ts": f"{1700000000 + i}.000{i:03}", "user": "U1",
         "text": said[i % 5], "event_time": "2023-11-14T22:13:20Z"}
        for i in range(200)
    ]
    edit = {"subtype": "message_changed", "channel": "C1", "event_time": "2023-11-14T23:00:00Z",
            "message": {"ts": events[0]["ts"], "text": "edited"}}
    gone = {"subtype": "message_deleted", "channel": "C1", "event_time": "2023-11-14T23:01:00Z",
            "deleted_ts": events[0]["ts"]}
    stray = {"type": "message", "channel": "C9", "ts": "1700000000.1", "text": "why"}
    incidents = spark.createDataFrame([(7, "C1")], "id BIGINT, chat_channel_id STRING")
    names = ["messages", "timeline", "snapshots", "revisions", "bad"]
    sink = ingest.transcript_sink(incidents, *[str(tmp_path / n) for n in names])
    source = tmp_path / "in"
    write_lines(source / "a.json", [*events, edit, edit, gone, stray])
    ingest.run_once(ingest.payload_stream(spark, str(source)), sink, str(tmp_path / "ck"))
    write_lines(source / "b.json", [*events, edit, gone])
    ingest.run_once(ingest.payload_stream(spark, str(source)), sink, str(tmp_path / "ck"))
    table = lambda n: spark.read.parquet(str(tmp_path / n))
    assert table("messages").count() == 200
    assert table("timeline").groupBy("intent").count().count() == 4
    assert table("timeline").count() == 160 and table("snapshots").count() == 80
    kinds = [r.kind for r in table("revisions").orderBy("revision").collect()]
    assert kinds[:2] == ["edited", "deleted"]


def test_edit_before_any_message_is_no_failure(spark, tmp_path):
    incidents = spark.createDataFrame([(7, "C1")], "id BIGINT, chat_channel_id STRING")
    sink = ingest.transcript_sink(incidents, *[str(tmp_path / n) for n in ("m", "t", "s", "r", "bad")])
    edit = {"subtype": "message_changed", "channel": "C1", "event_time": "2023-11-14T23:00:00Z",
            "message": {"ts": "1700000000.000001", "text": "edited"}}
    said = {"type": "message", "channel": "C1", "ts": "1700000000.000001", "user": "U1", "text": "rolled back",
            "event_time": "2023-11-14T22:13:20Z"}
    frame = lambda *rows: spark.createDataFrame([(json.dumps(r),) for r in rows], "value STRING")
    sink(frame(edit), 0)
    sink(frame(said), 1)
    sink(frame(edit), 2)
    assert [r.kind for r in spark.read.parquet(str(tmp_path / "r")).collect()] == ["edited"]
    sink(spark.createDataFrame([("nonsense{",)], "value STRING"), 3)
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 1


def test_late_alert_gets_its_decision(spark, tmp_path):
    parts = [[alert(1, 7200, "db")], [alert(2, 7230, "api")], [alert(3, 3600, "db", name="Slow"), alert(4, 7240, "db")]]
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, ALERT_DDL).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(ALERT_DDL).option("maxFilesPerTrigger", 1).option(
        "recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    drain(streaming_correlation.correlate_stream(stream, edges_df(spark)), tmp_path / "out", tmp_path / "ck")
    got = {r.alert_id: r.incident_id for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert set(got) == {1, 2, 3, 4} and got[3] == 3 and got[1] == got[2] == got[4]


@pytest.mark.parametrize("name", ["incident", "cost", "pages"])
def test_rollup_streams_match_batch(spark, tmp_path, views, name):
    if name == "incident":
        rows = views.events().select(
            F.col("ts").alias("time"), F.col("event_type").alias("intent"), F.col("user_id").alias("incident_id"))
        batch, stream = incident_daily, rollups.incident_daily_stream
    elif name == "cost":
        rows, batch, stream = views.llm_calls(), llm_cost_daily, rollups.llm_cost_daily_stream
    else:
        rows, batch, stream = views.pages(), page_load_daily, rollups.page_load_daily_stream
    rows.orderBy("time").coalesce(1).write.parquet(str(tmp_path / "in"))
    last = rows.agg(F.max("time")).first()[0]
    flush = rows.limit(1).withColumn("time", F.lit(last + dt.timedelta(days=3)))
    flush.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    drain(stream(source), tmp_path / "out", tmp_path / "ck")
    got = spark.read.parquet(str(tmp_path / "out"))
    want = batch(rows).select(*got.columns)
    key = lambda df: {tuple(str(v) for v in r) for r in df.collect()}
    assert key(got) == key(want)


def test_once_keeps_one_copy(spark, tmp_path):
    rows = [("k1", T0), ("k1", T0 + dt.timedelta(minutes=1)), ("k2", T0)]
    spark.createDataFrame(rows, "k STRING, time TIMESTAMP").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("k STRING, time TIMESTAMP").parquet(str(tmp_path / "in"))
    drain(ingest.once(source, ["k"], "time"), tmp_path / "out", tmp_path / "ck")
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["k1", "k2"]


def test_burn_alerts_of_a_stream_equal_the_batch(spark, tmp_path):
    """All four ratios and both alerts from one pass over panes, in several micro-batches."""
    rng = random.Random(4)
    rows, at = [], T0
    for i in range(900):
        at += dt.timedelta(seconds=rng.choice([1, 7, 20, 30, 90]))
        bad = 300 < i < 600 and rng.random() < 0.5 or rng.random() < 0.01
        rows.append((at, rng.choice(["a", "b"]), float(rng.randint(0, 4)), bad))
    ddl = "time TIMESTAMP, slo STRING, increase DOUBLE, bad BOOLEAN"
    for part in range(6):
        spark.createDataFrame(rows[part * 150:part * 150 + 150], ddl).coalesce(1).write.parquet(str(tmp_path / f"in/{part}"))
    flush = [(at + dt.timedelta(days=1), slo, 1.0, False) for slo in "ab"]
    spark.createDataFrame(flush, ddl).coalesce(1).write.parquet(str(tmp_path / "in/9"))
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).option(
        "recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    found = rollups.burn_alert_stream(stream, ["slo"], F.col("bad"), objective=0.01)
    drain(found, tmp_path / "out", tmp_path / "ck")
    batch = metrics.burn_alerts(
        metrics.error_ratios(spark.createDataFrame(rows, ddl), ["slo"], F.col("bad")), ["slo"], objective=0.01)
    names = ["slo", "at", "fast_burn_firing", "slow_burn_firing"]
    ratios = ["ratio_5m", "ratio_30m", "ratio_1h", "ratio_6h"]
    by_step = lambda df: {tuple(r[n] for n in names[:2]): r for r in df.collect()}
    got, want = by_step(spark.read.parquet(str(tmp_path / "out"))), by_step(batch)
    assert set(got) == set(want) and len(want) > 300
    for key, row in want.items():
        assert [got[key][n] for n in names] == [row[n] for n in names]
        assert [got[key][n] for n in ratios] == pytest.approx([row[n] for n in ratios], rel=1e-9)
    assert any(r.fast_burn_firing for r in want.values()) and any(r.slow_burn_firing for r in want.values())


def test_latency_sketches_of_a_stream_merge(spark, tmp_path):
    rng = random.Random(6)
    rows = [(T0 + dt.timedelta(minutes=7 * i), rng.choice("xy"), "m", rng.randrange(100_000)) for i in range(2_000)]
    ddl = "time TIMESTAMP, role STRING, model STRING, latency_ms INT"
    for part in range(4):
        spark.createDataFrame(rows[part::4], ddl).coalesce(1).write.parquet(str(tmp_path / f"in/{part}"))
    last = rows[-1][0] + dt.timedelta(days=4)
    spark.createDataFrame([(last, "x", "m", 0)], ddl).coalesce(1).write.parquet(str(tmp_path / "in/9"))
    for shards in (1, 5):
        stream = spark.readStream.schema(ddl).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        found = rollups.llm_latency_daily_stream(stream, shards=shards)
        drain(found, tmp_path / f"out{shards}", tmp_path / f"ck{shards}")
        kept = spark.read.parquet(str(tmp_path / f"out{shards}"))
        daily = llm_latency_daily(spark.createDataFrame(rows, ddl))
        count = lambda df: {(r.day, r.role): r.n for r in df.groupBy("day", "role").agg(F.sum("calls").alias("n")).collect()}
        assert count(kept) == count(daily)
        for q in (0.5, 0.95):
            merged = {r.role: r.latency_ms for r in latency_quantile(kept, ["role"], q).collect()}
            for role in "xy":
                values = sorted(r[3] for r in rows if r[1] == role)
                rank = sum(v <= merged[role] for v in values) / len(values)
                assert abs(rank - q) < 0.03


class Entries:
    """A map or value state in memory that counts the entries it reads."""

    def __init__(self):
        self.kept, self.reads = {}, 0

    def containsKey(self, key):
        return key in self.kept

    def getValue(self, key):
        self.reads += 1
        return self.kept[key]

    def updateValue(self, key, value):
        self.kept[key] = value

    def removeKey(self, key):
        self.kept.pop(key, None)

    def iterator(self):
        for item in list(self.kept.items()):
            self.reads += 1
            yield item

    def exists(self):
        return bool(self.kept)

    def get(self):
        return self.kept[()]

    def update(self, value):
        self.kept[()] = value

    def clear(self):
        self.kept.clear()


class Handle:
    def __init__(self):
        self.states, self.timers = {}, []

    def getMapState(self, name, *schemas):
        return self.states.setdefault(name, Entries())

    getValueState = getMapState

    def registerTimer(self, at_ms):
        self.timers.append(at_ms)


class Expired:
    def __init__(self, at_ms):
        self.at_ms = at_ms

    def getExpiryTimeInMs(self):
        return self.at_ms


def alert_rows(keys, minute, arrived, first=0):
    at = pd.Timestamp(T0) + pd.Timedelta(minutes=minute)
    return pd.DataFrame({
        "first_id": [first + n for n in range(len(keys))], "dedup_key": keys, "service": [f"s-{k}" for k in keys],
        "near": [[] for _ in keys], "severity_rank": 3, "labels": [{"alertname": k} for k in keys], "first_at": at,
        "last_at": at, "taken_at": at, "closing": False, "arrived_at": pd.Timestamp(arrived, unit="s")})


def test_state_read_grows_with_the_batch_and_leaves_by_timer():
    loop = Loop(900, 0.62, 3600, False)
    handle, processor = Handle(), streaming_correlation.OpenIncidents(loop, 3600)
    processor.init(handle)
    take = lambda rows: pd.concat(list(processor.handleInputRows(("c",), iter([rows]), None)))
    keys = [f"k{n}" for n in range(500)]
    opened = take(alert_rows(keys, 0, 1000))
    assert set(opened["kind"]) == {"new"} and len(handle.states["incidents"].kept) == 500
    for state in handle.states.values():
        state.reads = 0
    again = take(alert_rows(["k3", "k7", "k3"], 30, 2000, 1000))
    assert list(again["kind"]) == ["attached"] * 3 and list(again["incident_id"]) == [3, 7, 3]
    assert handle.states["incidents"].reads + handle.states["holders"].reads <= 6
    # the first timer finds the component busy: only what nothing can join any more goes
    assert handle.timers == [(1000 + 3600) * 1000]
    take(alert_rows(["k7"], 65, 3000, 2000))
    list(processor.handleExpiredTimer(("c",), None, Expired(handle.timers[-1])))
    assert sorted(k for k, in handle.states["incidents"].kept) == [3, 7]
    assert sorted(k for k, in handle.states["holders"].kept) == ["k3", "k7"]
    assert take(alert_rows(["k1"], 66, 3010, 3000))["kind"].tolist() == ["new"]
    list(processor.handleExpiredTimer(("c",), None, Expired((3010 + 3600) * 1000)))
    assert not any(state.kept for state in handle.states.values())
