"""Checks of the payload readers and the small column functions, over payloads made from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilake.functions.evidence import metric_ref
from vigilake.functions.labels import jaccard
from vigilake.functions.times import window_minutes
from vigilake.operators import evaluation, metrics, oncall
from vigilake.plans.registry import query, rounded
from vigilake.plans.report_checks import TIRED_SQL, fatigue
from vigilake.sources import webhooks

ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def _json(**fields):
    return F.to_json(F.struct(*[value.alias(name) for name, value in fields.items()]))


@query("webhook_alerts", """
    WITH e AS (SELECT event_id, user_id, ts, event_id % 13 = 0 AS torn, event_id % 17 = 0 AS bare, event_id % 7 = 0 AS nameless,
                      event_id % 19 = 0 AS timeless, event_type FROM events),
    r AS (SELECT *, CASE WHEN torn THEN 'malformed json' WHEN bare THEN 'payload has no alerts array'
                         WHEN nameless THEN 'alert has no alertname label'
                         WHEN timeless THEN 'alert has no parseable startsAt' END AS reject FROM e),
    v AS (SELECT *, NOT (torn OR bare) AS read, CASE event_type WHEN 'error' THEN 'sev1' WHEN 'click' THEN 'sev4' ELSE 'sev3' END AS sev FROM r)
    SELECT event_id, reject, CASE WHEN NOT torn AND user_id % 2 = 0 THEN 'resolved' ELSE 'firing' END AS status,
           CASE WHEN read THEN 'svc-' || user_id END AS service, CASE WHEN read THEN sev ELSE 'sev3' END AS severity,
           CASE WHEN NOT read THEN 2 ELSE CASE sev WHEN 'sev1' THEN 4 WHEN 'sev4' THEN 1 ELSE 2 END END AS severity_rank,
           CASE WHEN read AND NOT timeless THEN date_trunc('second', ts) END AS starts_at,
           coalesce(read AND user_id % 3 = 0, false) AS grouped FROM v""")
def _(v):
    e = v.events()
    spelled = F.when(F.col("event_type") == "error", " Critical").when(F.col("event_type") == "click", "INFO").otherwise("odd")
    labels = F.map_filter(F.create_map(
        F.lit("alertname"), F.when(F.col("event_id") % 7 != 0, F.col("event_type")),
        F.lit("service"), F.concat(F.lit("svc-"), F.col("user_id").cast("string")), F.lit("severity"), spelled,
    ), lambda _, value: value.isNotNull())
    entry = F.struct(
        labels.alias("labels"),
        F.when(F.col("event_id") % 19 == 0, "soon").otherwise(F.date_format("ts", ISO)).alias("startsAt"),
        F.lit("0001-01-01T00:00:00Z").alias("endsAt"),
    )
    status = F.when(F.col("user_id") % 2 == 0, "resolved").otherwise("firing")
    group = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("group-"), F.col("user_id").cast("string")))
    full = _json(status=status, groupKey=group, alerts=F.array(entry))
    text = F.when(F.col("event_id") % 13 == 0, F.substring(full, 1, 12)).when(
        F.col("event_id") % 17 == 0, _json(status=status)).otherwise(full)
    read = webhooks.alert_entries(e.select("event_id", text.alias("value")), ("event_id",))
    return read.select(
        "event_id", "reject", "status", "service", "severity", "severity_rank", "starts_at",
        F.coalesce(F.col("dedup_key").startswith("group-"), F.lit(False)).alias("grouped"),
    )


@query("paging_payloads", """
    SELECT CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'P' || event_id END AS id, 'svc-' || user_id AS service,
           CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS alertname, date_trunc('second', ts) AS starts_at,
           CASE WHEN user_id % 2 = 0 THEN 'resolved' ELSE 'firing' END AS status,
           CASE WHEN event_type = 'error' THEN 'sev2' ELSE 'sev3' END AS severity,
           CASE WHEN event_id % 11 = 0 THEN 'paging event has no title' END AS reject FROM events""")
def _(v):
    name = F.concat(F.lit("svc-"), F.col("user_id").cast("string"))
    fields = {
        "id": F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("P"), F.col("event_id").cast("string"))),
        "title": F.when(F.col("event_id") % 11 != 0, F.col("event_type")),
        "created_at": F.date_format("ts", ISO), "urgency": F.when(F.col("event_type") == "error", "HIGH").otherwise("low"),
        "status": F.when(F.col("user_id") % 2 == 0, "Resolved").otherwise("triggered"),
    }
    inner = F.struct(*[c.alias(n) for n, c in fields.items()], F.struct(name.alias("summary")).alias("service"))
    nested = F.to_json(F.struct(F.struct(inner.alias("incident")).alias("data")))
    flat = F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()], name.alias("service")))
    text = F.when(F.col("event_id") % 2 == 0, nested).otherwise(flat)
    read = webhooks.paging_entries(v.events().select(text.alias("value")))
    return read.select(
        F.when(F.col("dedup_key").startswith("P"), F.col("dedup_key")).alias("id"), "service", "alertname", "starts_at",
        "status", "severity", "reject",
    )


@query("deploy_payloads", """
    SELECT CASE WHEN p_partkey % 9 <> 0 THEN substr(md5(p_name), 1, 12) END AS sha, p_brand AS service, CASE WHEN p_size % 2 = 0 THEN 'staging' ELSE 'production' END AS environment,
           p_type AS repository, TIMESTAMP '2024-01-05' AS deployed_at,
           CASE WHEN p_partkey % 9 = 0 THEN 'sha and service are required'
                WHEN p_type NOT IN (SELECT min(p_type) FROM part) THEN 'repository not in the allowlist' END AS reject, p_partkey
      FROM part""")
def _(v):
    parts = v.table("part")
    allowed = [parts.agg(F.min("p_type")).first()[0]]
    text = _json(
        commit=F.when(F.col("p_partkey") % 9 != 0, F.md5(F.col("p_name").cast("binary"))),
        service=F.concat(F.lit(" "), "p_brand"), environment=F.when(F.col("p_size") % 2 == 0, "staging"),
        repository=F.col("p_type"), actor=F.col("p_partkey").cast("string"),
    )
    received = F.lit("2024-01-05").cast("timestamp")
    read = webhooks.deploy_entries(parts.select(text.alias("value"), F.md5(F.col("p_name").cast("binary")).alias("whole")), received, allowed)
    key = F.get_json_object("raw", "$.actor").cast("bigint").alias("p_partkey")
    return read.select(
        F.nullif("sha", F.lit("")).alias("sha"), "service", "environment", "repository", "deployed_at", "reject", key)


@query("chat_payloads", """
    SELECT 'C' || conv_id AS channel_id, (1700000000 + conv_id * 3600 + turn * 60) || '.5' AS ts,
           CASE turn % 3 WHEN 0 THEN 'message' WHEN 1 THEN 'edited' ELSE 'deleted' END AS kind,
           CASE WHEN turn % 3 < 2 THEN text END AS text FROM conversations""")
def _(v):
    talk = v.table("conversations").select(
        F.concat(F.lit("C"), F.col("conv_id").cast("string")).alias("channel"), "text", (F.col("turn") % 3).alias("form"),
        F.concat((F.lit(1700000000) + F.col("conv_id") * 3600 + F.col("turn") * 60).cast("string"), F.lit(".5")).alias("ts"),
    )
    said = _json(channel=F.col("channel"), ts=F.col("ts"), text=F.col("text"), user=F.lit("U1"))
    edit = _json(subtype=F.lit("message_changed"), channel=F.col("channel"), message=F.struct("ts", "text"))
    gone = _json(subtype=F.lit("message_deleted"), channel=F.col("channel"), deleted_ts=F.col("ts"))
    text = F.when(F.col("form") == 0, said).when(F.col("form") == 1, edit).otherwise(gone)
    messages, edits, deletes = webhooks.split_chat(webhooks.chat_events(talk.select(text.alias("value"))))
    columns = ["channel_id", "ts", "kind", "text"]
    return messages.select(
        F.col("channel").alias("channel_id"), "ts", F.lit("message").alias("kind"), "text"
    ).unionByName(edits.select(*columns)).unionByName(deletes.select(*columns))


@query("responder_windows", TIRED_SQL + """,
    asked AS (SELECT DISTINCT 'U' || (user_id * 2) AS responder FROM events)
    SELECT responder, CAST(coalesce(short, 0) AS BIGINT) AS pages_8h, CAST(coalesce(night, 0) AS BIGINT) AS night_pages_24h,
           CAST(coalesce(worst, 0) AS BIGINT) AS sev1_count_7d, CAST(coalesce(minutes, 0) AS BIGINT) AS incident_minutes_24h,
           CAST(coalesce(streak, 0) AS BIGINT) AS consecutive_oncall_days
      FROM asked LEFT JOIN (SELECT * FROM tired WHERE present = 1) USING (responder)""")
def _(v):
    asked = v.events().select(F.concat(F.lit("U"), (F.col("user_id") * 2).cast("string")).alias("responder"))
    found = oncall.window_for(fatigue(v), asked)
    return found.select("responder", *[F.col(c).cast("bigint") for c in found.columns if c != "responder"])


@query("label_overlap", """
    SELECT l_orderkey, l_linenumber,
           round((CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END + CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END)::DOUBLE
                 / (4 - (CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END + CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END)), 6) AS overlap
      FROM lineitem""")
def _(v):
    own = F.create_map(F.lit("flag"), F.col("l_returnflag"), F.lit("status"), F.col("l_linestatus"))
    usual = F.create_map(F.lit("flag"), F.lit("N"), F.lit("status"), F.lit("O"))
    return rounded(v.table("lineitem").select("l_orderkey", "l_linenumber", jaccard(own, usual).alias("overlap")))


@query("metric_windows", """
    WITH w AS (SELECT user_id, event_type, min(ts) AS a, max(ts) AS b FROM events GROUP BY 1, 2)
    SELECT user_id, event_type, 'metric:' || substr(sha256('rate(' || event_type || ')'), 1, 8) || '@'
             || CAST(floor(epoch(a)) AS BIGINT) || '-' || CAST(floor(epoch(b)) AS BIGINT) AS ref,
           CAST(greatest(1, floor((epoch_us(b) - epoch_us(a)) / 60000000.0) + 1) AS INTEGER) AS minutes FROM w""")
def _(v):
    spans = v.events().groupBy("user_id", "event_type").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    asked = F.concat(F.lit("rate("), "event_type", F.lit(")"))
    return spans.select(
        "user_id", "event_type", metric_ref(asked, F.col("a"), F.col("b")).alias("ref"),
        window_minutes(F.col("a"), F.col("b")).alias("minutes"),
    )


@query("storm_scores", """
    SELECT l_orderkey, round(greatest(0.0, 1.0 - abs(count(*) - max(l_linenumber % 4)) / greatest(max(l_linenumber % 4), 1)::DOUBLE), 6) AS score
      FROM lineitem GROUP BY 1""")
def _(v):
    per = v.table("lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("made"), F.max(F.col("l_linenumber") % 4).alias("wanted")
    )
    return rounded(per.select("l_orderkey", evaluation.storm_score(F.col("made"), F.col("wanted")).alias("score")))


@query("samples_in_range", """
    SELECT series, time, value FROM v_samples
     WHERE time BETWEEN TIMESTAMP '2024-01-10 06:00:00' AND TIMESTAMP '2024-01-12 18:00:00'""")
def _(v):
    found = metrics.range_values(v.samples(), "2024-01-10 06:00:00", "2024-01-12 18:00:00")
    return found.select("series", "time", "value")


@query("wire_records", """
    SELECT service, fingerprint, starts_at, 'ErrorRate' AS alertname, 'sev1' AS severity, 4 AS severity_rank,
           4 AS labels FROM v_alerts""")
def _(v):
    alerts = v.alerts()
    missing = [c for c in webhooks.ALERT_COLUMNS if c not in alerts.columns]
    nothing = F.create_map().cast("map<string,string>")
    full = alerts.select("*", *[
        (nothing if c == "annotations" else F.lit(None).cast("timestamp" if c == "ends_at" else "string")).alias(c)
        for c in missing
    ])
    back = webhooks.from_wire(webhooks.to_wire(full))
    return back.select(
        "service", "fingerprint", "starts_at", "alertname", "severity", "severity_rank", F.size("labels").alias("labels")
    )
