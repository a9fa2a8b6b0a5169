"""Checks of operators' further arguments and reports: one responder, batches, impact, ladder, signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilake.operators import metrics, oncall, privacy, runbooks, store, sweeps
from vigilake.plans.driver_views import EVENTS_AS_OF, ORDERS_AS_OF
from vigilake.plans.registry import query
from vigilake.plans.report_checks import TIRED_SQL


@query("fatigue_of_one_responder", TIRED_SQL + """
    SELECT responder, CAST(short AS BIGINT) AS pages_8h, CAST(night AS BIGINT) AS night_pages_24h,
           CAST(worst AS BIGINT) AS sev1_count_7d, CAST(minutes AS INTEGER) AS incident_minutes_24h,
           CAST(streak AS INTEGER) AS consecutive_oncall_days FROM tired WHERE present = 1 AND responder = 'U7'""")
def _(v):
    return oncall.fatigue_windows(v.pages(), v.page_incidents(), EVENTS_AS_OF, responder="U7")


@query("nudge_batch", """
    SELECT id, public_key, detected_at,
           CAST(epoch(TIMESTAMP '2001-08-02' - detected_at) AS BIGINT) AS age_s,
           'nudge:' || CAST(floor(epoch(TIMESTAMP '2001-08-02' - detected_at) / 300) AS BIGINT) AS discriminator
      FROM v_incidents WHERE state = 'engaged' ORDER BY detected_at, id LIMIT 25""")
def _(v):
    unseen = v.incidents().withColumn("acknowledged_at", F.lit(None).cast("timestamp"))
    return sweeps.nudges(unseen, ORDERS_AS_OF, limit=25)


@query("awaiting_document_batch", """
    SELECT id, resolved_at FROM v_incidents WHERE state = 'closed' AND id NOT IN (SELECT incident_id FROM v_documents)
     ORDER BY resolved_at, id LIMIT 40""")
def _(v):
    return sweeps.awaiting_document(v.incidents(), v.documents(), limit=40, state="closed")


@query("held_messages", """
    WITH asked AS (SELECT DISTINCT 'C' || (user_id % 400) AS channel_id,
                          CAST(1700000000 + user_id % 400 * 3600 + event_id % 9 * 60 AS VARCHAR) AS ts FROM events)
    SELECT channel_id, ts FROM asked WHERE (channel_id, ts) IN (SELECT channel_id, ts FROM v_messages)""")
def _(v):
    channel = F.col("user_id") % 400
    asked = v.events().select(
        F.concat(F.lit("C"), channel.cast("string")).alias("channel_id"),
        (F.lit(1_700_000_000) + channel * 3600 + F.col("event_id") % 9 * 60).cast("string").alias("ts"),
    ).distinct()
    return sweeps.held_messages(asked, v.messages())


@query("idempotency_keys", """
    SELECT event_id, sha256(user_id || ':' || event_type || ':' || CASE WHEN event_id % 3 = 0 THEN '' ELSE CAST(event_id AS VARCHAR) END)
           AS key FROM events""")
def _(v):
    mark = F.when(F.col("event_id") % 3 != 0, F.col("event_id").cast("string"))
    return v.events().select("event_id", store.idempotency_key(F.col("user_id"), F.col("event_type"), mark).alias("key"))


@query("impact_report", """
    WITH seen AS (SELECT user_id, CASE event_type WHEN 'error' THEN '503' ELSE '200' END AS status, ts, count(*) AS n
                    FROM events GROUP BY ALL),
    s AS (SELECT *, sum(n) OVER (PARTITION BY user_id, status, CAST(ts AS DATE) ORDER BY ts)::DOUBLE AS value FROM seen),
    p AS (SELECT *, lag(value) OVER (PARTITION BY user_id, status ORDER BY ts) AS prev FROM s),
    g AS (SELECT 'svc-' || (user_id % 12) AS service, status, ts,
                 CASE WHEN prev IS NULL THEN 0 WHEN value < prev THEN value ELSE value - prev END AS inc FROM p),
    i AS (SELECT e.event_id AS id, 'svc-' || (user_id % 12) AS service, detected_at,
                 CASE WHEN e.event_id % 5 = 0 THEN TIMESTAMP '2024-01-31' ELSE resolved_at END AS stop
            FROM v_page_incidents JOIN events e ON e.event_id = id),
    w AS (SELECT *, greatest(1, CAST(floor(epoch(stop - detected_at) / 60) AS INTEGER) + 1) AS minutes FROM i),
    t AS (SELECT w.id, any_value(minutes) AS minutes, sum(inc) FILTER (status = '503') AS failed, sum(inc) AS total
            FROM w LEFT JOIN g ON g.service = w.service AND g.ts > stop - to_seconds(minutes * 60) AND g.ts <= stop GROUP BY w.id)
    SELECT id AS incident_id, minutes, failed AS failed_requests, total AS total_requests,
           CASE WHEN total > 0 THEN round_even(failed / total * 100, 2) END AS error_rate_pct, 'computed' AS status FROM t""")
def _(v):
    events = v.events()
    status = F.when(F.col("event_type") == "error", "503").otherwise("200")
    service = F.concat(F.lit("svc-"), (F.col("user_id") % 12).cast("string"))
    seen = events.groupBy("user_id", status.alias("status"), "ts").agg(F.count("*").alias("n"))
    samples = seen.select(
        F.col("ts").alias("time"), F.lit("http_requests_total").alias("name"),
        F.create_map(F.lit("service"), service, F.lit("status"), F.col("status"),
                     F.lit("user"), F.col("user_id").cast("string")).alias("labels"),
        F.expr("CAST(sum(n) OVER (PARTITION BY user_id, status, to_date(ts) ORDER BY ts) AS DOUBLE)").alias("value"),
    )
    owner = events.select(F.col("event_id").alias("id"), service.alias("service"))
    incidents = v.page_incidents().join(owner, "id").select(
        "id", "service", F.lit("prod").alias("namespace"), "detected_at",
        F.when(F.col("id") % 5 != 0, F.col("resolved_at")).alias("resolved_at"),
    )
    return metrics.impact(incidents, samples, EVENTS_AS_OF).select(
        "incident_id", "minutes", "failed_requests", "total_requests", "error_rate_pct", "status")


@query("oncall_ladder", """
    WITH n AS (SELECT n_nationkey AS k, n_name AS schedule FROM nation),
    c AS (SELECT schedule, CASE WHEN k % 10 = 0 THEN '' ELSE 'c' || k END AS p, 'd' || k AS s FROM n WHERE k % 5 = 0),
    o AS (SELECT schedule, CASE WHEN k % 6 <> 0 THEN 'p' || k END AS p, 's' || k AS s,
                 CASE WHEN k % 4 = 0 THEN 'timeout' END AS e FROM n WHERE k % 2 = 0),
    r AS (SELECT schedule, 'r' || k AS p, 't' || k AS s, '#team' || k AS team FROM n WHERE k % 3 = 0),
    j AS (SELECT n.schedule, c.p AS cp, c.s AS cs, o.p AS op, o.s AS os, e, r.p AS rp, r.s AS rs, team,
                 CASE WHEN coalesce(c.p, '') <> '' THEN 'cache' WHEN o.p IS NOT NULL AND e IS NULL THEN 'provider'
                      WHEN r.p IS NOT NULL THEN 'static_schedule' ELSE 'team_broadcast' END AS source
            FROM n LEFT JOIN c USING (schedule) LEFT JOIN o USING (schedule) LEFT JOIN r USING (schedule))
    SELECT schedule, CASE source WHEN 'cache' THEN cp WHEN 'provider' THEN op WHEN 'static_schedule' THEN rp END AS primary_,
           CASE source WHEN 'cache' THEN cs WHEN 'provider' THEN os WHEN 'static_schedule' THEN rs END AS secondary, source,
           team AS team_channel, CASE WHEN source IN ('cache', 'provider') THEN NULL
               WHEN e IS NOT NULL THEN 'paging provider unavailable: ' || e ELSE 'paging provider returned no on-call' END AS reason
      FROM j""")
def _(v):
    key = F.col("n_nationkey")
    known = v.table("nation").withColumn("schedule", F.col("n_name"))
    named = lambda letter: F.concat(F.lit(letter), key.cast("string"))
    cache = known.where(key % 5 == 0).select(
        "schedule", F.when(key % 10 == 0, "").otherwise(named("c")).alias("primary"), named("d").alias("secondary"))
    provider = known.where(key % 2 == 0).select(
        "schedule", F.when(key % 6 != 0, named("p")).alias("primary"), named("s").alias("secondary"),
        F.when(key % 4 == 0, "timeout").alias("error"))
    rota = known.where(key % 3 == 0).select(
        "schedule", named("r").alias("primary"), named("t").alias("secondary"), named("#team").alias("team_channel"))
    return oncall.resolve_oncall(known, cache, provider, rota).withColumnRenamed("primary", "primary_")


@query("step_signals", """
    WITH u AS (SELECT l_orderkey AS incident_id, i.runbook_id, 'step-' || (l_linenumber % 4 + l_partkey % 2 * 5) AS step_id,
                      CAST(l_suppkey AS VARCHAR) AS source_message_ts, l_shipdate + to_seconds(l_linenumber) AS observed_at,
                      CASE l_returnflag WHEN 'A' THEN 'command_match' WHEN 'R' THEN 'reaction' ELSE 'slash_command' END AS detected_by
                 FROM lineitem JOIN v_incidents i ON i.id = l_orderkey)
    SELECT incident_id, step_id, arg_min(runbook_id, (observed_at, detected_by)) AS runbook_id,
           arg_min(detected_by, (observed_at, detected_by)) AS detected_by,
           arg_min(source_message_ts, (observed_at, detected_by)) AS source_message_ts, min(observed_at) AS observed_at
      FROM u JOIN v_steps USING (runbook_id, step_id) GROUP BY incident_id, step_id""")
def _(v):
    line = F.col("l_linenumber")
    owner = v.incidents().select(F.col("id").alias("l_orderkey"), "runbook_id")
    rows = v.table("lineitem").join(owner, "l_orderkey").select(
        F.col("l_orderkey").alias("incident_id"), "runbook_id", "l_returnflag",
        F.concat(F.lit("step-"), (line % 4 + F.col("l_partkey") % 2 * 5).cast("string")).alias("step_id"),
        F.col("l_suppkey").cast("string").alias("source_message_ts"),
        F.timestamp_micros(F.unix_micros(F.col("l_shipdate").cast("timestamp")) + line * 1_000_000).alias("observed_at"),
    )
    of = lambda flag: rows.where(F.col("l_returnflag") == flag).drop("l_returnflag")
    return runbooks.step_signals(of("A"), of("R"), of("N"), v.runbooks())


@query("restored_documents", "SELECT doc_id, text AS restored FROM documents")
def _(v):
    texts = v.table("documents").select("doc_id", F.floor(F.col("doc_id") / 2).alias("incident_id"), "text")
    redacted, mapping = privacy.redact(texts, ["doc_id"], "incident_id", ["doc_id"])
    return privacy.restore(redacted.drop("text"), ["doc_id"], "incident_id", mapping).select("doc_id", "restored")
