"""Readers, the wire format, runbook files and the partitioned sink."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from vigilake.functions.labels import fingerprint, jaccard, public_key, severity_level, stable_labels
from vigilake.functions.times import chat_timestamp, parse_timestamp, window_minutes
from vigilake.operators.reports import jsonable
from vigilake.sources import files, tables, webhooks
from vigilake.sources.front_matter import read_front_matter


def payloads(spark, *objects):
    return spark.createDataFrame([(json.dumps(o),) for o in objects], "value STRING")


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_alert_webhook(spark):
    labels = {"alertname": "Down", "service": "db", "severity": "Critical ", "pod": "x-1", "n": 3}
    good = {"labels": labels, "startsAt": "2024-05-01T10:00:00+05:30", "endsAt": "0001-01-01T00:00:00Z"}
    body = {"status": "resolved", "groupKey": "g1", "alerts": [
        good, {**good, "status": "firing"}, {"labels": {"service": "db"}, "startsAt": "2024-05-01T10:00:00Z"},
        {"labels": labels, "startsAt": "yesterday"}]}
    entries = webhooks.alert_entries(payloads(spark, body, {"status": "firing", "alerts": []}))
    kept = webhooks.accepted(entries).collect()
    assert [r.status for r in kept] == ["resolved", "firing"]
    assert kept[0].starts_at == dt.datetime(2024, 5, 1, 4, 30) and kept[0].ends_at is None
    assert (kept[0].severity, kept[0].severity_rank, kept[0].dedup_key) == ("sev1", 4, "g1")
    assert kept[0].labels["n"] == "3" and len(kept[0].fingerprint) == 32
    assert sorted(r.reject for r in webhooks.rejected(entries).collect()) == [
        "alert has no alertname label", "alert has no parseable startsAt"]
    back = webhooks.from_wire(webhooks.to_wire(webhooks.accepted(entries)))
    assert back.select("fingerprint", "starts_at", "ends_at", "labels", "service").collect() == \
        webhooks.accepted(entries).select("fingerprint", "starts_at", "ends_at", "labels", "service").collect()


def test_unusable_payloads_are_rejected_rows(spark):
    good = {"alerts": [{"labels": {"alertname": "Down"}, "startsAt": "2024-05-01T10:00:00Z"}]}
    texts = ["{broken", "[1, 2]", json.dumps({"status": "firing"}), json.dumps({"alerts": {"a": 1}}), None, json.dumps(good),
             json.dumps({"alerts": [None]})]
    rows = spark.createDataFrame([(t,) for t in texts], "value STRING")
    entries = webhooks.alert_entries(rows)
    assert webhooks.accepted(entries).count() == 1
    bad = sorted((str(r.raw), r.reject) for r in webhooks.rejected(entries).collect())
    assert sorted(reason for _, reason in bad) == [
        "alert entry is not an object", "malformed json", "malformed json", "payload has no alerts array",
        "payload has no alerts array", "payload is not an object"]
    assert sorted(r.reject for r in webhooks.chat_rejects(rows).collect()) == [
        "malformed json", "malformed json", "payload is not an object"]


def test_paging_shapes(spark):
    nested = {"event": "incident.triggered", "data": {"incident": {
        "id": "P1", "title": "Down", "service": {"summary": "db"}, "created_at": "2024-05-01T10:00:00Z",
        "urgency": "high", "status": "Resolved", "html_url": "http://x"}}}
    flat = {"title": "Slow", "service": "api", "createdAt": "2024-05-01T10:00:00Z"}
    untitled = {"created_at": "2024-05-01T10:00:00Z"}
    timeless = {"event": "ping", "occurred_at": ""}
    rows = webhooks.paging_entries(payloads(spark, nested, flat, untitled, timeless)).collect()
    assert (rows[0].dedup_key, rows[0].service, rows[0].severity, rows[0].status) == ("P1", "db", "sev2", "resolved")
    assert rows[0].annotations == {"html_url": "http://x"}
    assert rows[1].service == "api" and rows[1].dedup_key == rows[1].fingerprint
    assert [r.reject for r in rows[2:]] == ["paging event has no title", "paging event has no parseable timestamp"]


def test_deploys(spark):
    now = F.lit("2024-05-02 00:00:00").cast("timestamp")
    sent = payloads(spark, {"commit": "ABCDEF0123456789", "service": "db", "repository": "r1"},
                    {"sha": "abc", "service": "db", "repository": "evil"}, {"sha": "abc"})
    rows = webhooks.deploy_entries(sent, now, ["r1"]).collect()
    assert (rows[0].sha, rows[0].environment, rows[0].reject) == ("abcdef012345", "production", None)
    assert [r.reject for r in rows[1:]] == ["repository not in the allowlist", "sha and service are required"]


def test_scalars(spark):
    text = lambda v: F.lit(v)
    row = one(
        spark, parse_timestamp(text("2024-05-01T10:00:00")).alias("naive"), parse_timestamp(text("12:30")).alias("junk"),
        chat_timestamp(text("1700000000.000100")).alias("ts"), chat_timestamp(text("12x")).alias("bad"),
        severity_level(text("Informational")).alias("info"), severity_level(text("whatever")).alias("unknown"),
        window_minutes(F.lit("2024-05-01 00:00:00").cast("timestamp"),
                       F.lit("2024-05-01 00:02:00").cast("timestamp")).alias("m"),
    )
    assert row.naive == dt.datetime(2024, 5, 1, 10) and row.junk is None and row.bad is None
    assert row.ts == dt.datetime(2023, 11, 14, 22, 13, 20, 100)
    assert (row.info, row.unknown, row.m) == ("sev4", "sev3", 3)


def test_labels(spark):
    make = lambda d: F.create_map(*[F.lit(x) for p in d.items() for x in p])
    a = {"alertname": "Down", "service": "db", "pod": "p1"}
    row = one(
        spark, fingerprint(make(a)).alias("fa"), fingerprint(make({**a, "pod": "p2"})).alias("fb"),
        fingerprint(make({**a, "cluster": "c"})).alias("fc"), stable_labels(make(a)).alias("s"),
        jaccard(make({"a": "1", "b": "2"}), make({"a": "1"})).alias("j"),
        jaccard(F.create_map().cast("map<string,string>"), F.create_map().cast("map<string,string>")).alias("none"),
        public_key(F.lit("High Latency!"), F.lit("Pay_Api"), F.lit("2024-05-01").cast("timestamp"), F.lit(0)).alias("k"),
    )
    assert row.fa == row.fb != row.fc and row.s == {"alertname": "Down", "service": "db"}
    assert (row.j, row.none, row.k) == (0.5, 0.0, "inc-2024-05-01-pay-api-high-latency")


RUNBOOK = '''---
name: Disk Full
alert_pattern: "DiskFull|NodePressure"
severity_filter: sev2
service_filter: null
version: 1.2.0
---
Intro.

<!-- step:check-usage -->
### Check usage

```bash
df -h /var/lib/data
```

<!-- step:rotate-logs -->
Rotate logs now.
'''


def test_runbook_files(spark, tmp_path):
    (tmp_path / "a.md").write_text(RUNBOOK)
    (tmp_path / "b.md").write_text(RUNBOOK.replace("rotate-logs", "check-usage"))
    (tmp_path / "c.md").write_text("no front matter")
    (tmp_path / "d.md").write_text(RUNBOOK.replace("DiskFull|NodePressure", "Disk(Full"))
    books, steps, problems = files.read_runbooks(spark, str(tmp_path / "*.md"))
    book = books.collect()
    assert len(book) == 1 and book[0].service_filter is None and book[0].severity_filter == "sev2"
    assert [(r.step_id, r.title) for r in steps.orderBy("position").collect()] == [
        ("check-usage", "Check usage"), ("rotate-logs", "Rotate logs now.")]
    assert {r.file: r.problem for r in problems.collect()} == {
        "b.md": "duplicate step id", "c.md": "no YAML front matter", "d.md": "alert_pattern is not valid regex"}


def test_front_matter_scalars(spark, tmp_path):
    for name, line, want in [("a", "sev1  # only pages", "sev1"), ("b", '"sev#1" # note', "sev#1"), ("c", "'a b'", "a b"),
                             ("d", "# nothing", None), ("e", "null", None), ("f", "x y", "x y")]:
        (tmp_path / f"{name}.md").write_text(RUNBOOK.replace("severity_filter: sev2", f"severity_filter: {line}"))
        book = files.read_runbooks(spark, str(tmp_path / f"{name}.md"))[0].first()
        assert book.severity_filter == want, line


HEADS = [
    "a: 1\nb: two words # note\nc: 'it''s'\nd: \"q\\t\\u00e9 # no\"\n",
    "a: |\n  x\n    y\n\n  z\n\nb: |-\n  x\n\n\nc: |+\n  x\n\nd: >\n  one\n  two\n\n  three\n    deep\n  four\n",
    "a:\n  - x\n  - 'y z'\nb:\n- x # n\n- 2\nc: [p, \"q, r\", 's']\nd:\n  - ~\n  - true\n",
    "a: first\n  second\n\n  third\nb: \"one\n  two\"\nc:\nd: ~\ne: null\nf: yes\ng: 1.10\nh: 1.0.0\ni: -3\n",
    "# only\n\na: x:y\nb: http://h/p#z\nc: a#b\n'k l': v\nd: >-\n  folded\n  text\ne: Disk.*|Node[A-Z]+\nf: ^pay-(api|web)$\n",
]


@pytest.mark.parametrize("head", HEADS)
def test_front_matter_reads_like_yaml(head):
    yaml = pytest.importorskip("yaml")
    want = {str(k): None if v is None else str(v) for k, v in yaml.safe_load(head).items()}
    assert read_front_matter(head) == want


def test_front_matter_blocks_and_lists_in_files(spark, tmp_path):
    text = RUNBOOK.replace('"DiskFull|NodePressure"', "|-\n  Disk\n  Full").replace("severity_filter: sev2", "severity_filter:\n  - sev1\n  - sev2")
    (tmp_path / "a.md").write_text(text)
    (tmp_path / "b.md").write_text("---\n- a\n- b\n---\n" + RUNBOOK.split("---", 2)[2])
    books, _, problems = files.read_runbooks(spark, str(tmp_path / "*.md"))
    book = books.first()
    assert (book.alert_pattern, book.severity_filter) == ("Disk\nFull", "['sev1', 'sev2']")
    assert [tuple(r) for r in problems.collect()] == [("b.md", "front matter is not a mapping")]


def test_recording_checks(spark, tmp_path):
    header = {"format": 1, "incident": 5, "bucket": "real", "start": "2024-05-01T00:00:00Z"}
    lines = [header, {"t": 9, "kind": "b"}, {"t": 1, "kind": "a"}, {"kind": "ground_truth", "labels": {"x": 1}}]
    (tmp_path / "ok.jsonl").write_text("\n".join(json.dumps(x) for x in lines))
    headers, entries, labels = files.read_recordings(spark, str(tmp_path / "ok.jsonl"))
    assert headers.first().recording == 5 and labels.first().labels == '{"x":1}'
    assert [r.kind for r in entries.orderBy("t").collect()] == ["a", "b"]
    (tmp_path / "old.jsonl").write_text(json.dumps({**header, "format": 2}) + '\n{"kind":"a"}')
    with pytest.raises(Exception, match="unsupported recording format"):
        files.read_recordings(spark, str(tmp_path / "old.jsonl"))[0].collect()
    (tmp_path / "bad.jsonl").write_text(json.dumps(header) + '\n{"t":1}')
    with pytest.raises(Exception, match="entry has no kind"):
        files.read_recordings(spark, str(tmp_path / "bad.jsonl"))[1].collect()


def test_ratings_and_graph_files(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"labels": {"1": {"human": {"a": 2, "b": 1}, "judge": {"a": 1}}}}, indent=1))
    assert [tuple(r) for r in files.read_ratings(spark, str(tmp_path / "r.json")).collect()] == [("1", "a", 2, 1)]
    (tmp_path / "g.json").write_text(json.dumps({"services": {"web": ["api"], "db": []}}, indent=1))
    assert [tuple(r) for r in files.read_graph(spark, str(tmp_path / "g.json")).collect()] == [("web", "api")]


def test_partitioned_table(spark, tmp_path):
    rows = spark.range(1000).select(
        F.timestamp_seconds(F.lit(1714521600) + F.col("id") * 600).alias("time"), F.lit(None).cast("bigint").alias("incident_id"),
        F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("series"), F.lit("db").alias("service"),
        F.col("id").cast("double").alias("value"), F.create_map(F.lit("k"), F.col("id")).alias("labels"))
    path = str(tmp_path / "t")
    tables.write_by_day(rows, path, "time", ["series"], rows_per_task=100)
    part = tables.read_range(spark, path, "signal_samples", "time", "2024-05-02 00:00:00", "2024-05-02 01:00:00")
    assert part.count() == 7
    assert "PartitionFilters: [isnotnull(day" in part._jdf.queryExecution().toString()
    tables.rewrite_retained(spark, path, str(tmp_path / "kept"), "2024-05-08 00:00:00", 2)
    days = spark.read.parquet(str(tmp_path / "kept")).select("day").distinct().count()
    assert days == 2
    shown = jsonable(rows.limit(1).withColumn("d", F.lit(1.5).cast("decimal(4,2)"))).first()
    assert shown.d == 1.5 and shown.time.startswith("2024-05-01T00:00:00")
