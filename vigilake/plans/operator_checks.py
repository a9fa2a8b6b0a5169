"""Checks of the graph, correlation, store, sweep, deploy, severity and rollup operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilake.functions.labels import public_key
from vigilake.operators import (
    audit,
    correlation,
    deploys,
    graph,
    rollups,
    severity,
    similarity_index,
    spend,
    store,
    sweeps,
)
from vigilake.plans.driver_views import EVENTS_AS_OF, ORDERS_AS_OF
from vigilake.plans.registry import query, rounded


@query("service_edges", """
    WITH s AS (SELECT n_nationkey AS id, n_name AS name FROM nation),
    d AS (SELECT DISTINCT c_nationkey AS id, s_nationkey AS dep FROM orders
            JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
            JOIN supplier ON l_suppkey = s_suppkey)
    SELECT DISTINCT s.name AS service, t.name AS depends_on FROM d
      JOIN s ON s.id = d.id JOIN s t ON t.id = d.dep""")
def _(v):
    pairs = (
        v.table("orders").join(v.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(v.table("lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(v.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .select(F.col("c_nationkey").alias("id"), "s_nationkey").distinct()
        .groupBy("id").agg(F.collect_list("s_nationkey").alias("depends_on"))
    )
    return graph.service_edges(v.services().join(pairs, "id"))


# Chains of services whose ends meet: three cycles of four, one of them reached from outside.
LOOPED_SQL = """
    links AS (SELECT service, depends_on FROM v_edges UNION
              SELECT 'svc-' || (user_id % 12), 'svc-' || (user_id % 12 - 9) FROM events
               WHERE event_type = 'error' AND user_id % 12 BETWEEN 9 AND 11 UNION
              SELECT 'svc-' || (user_id % 12), 'svc-' || (user_id % 12 + 4) FROM events
               WHERE event_type = 'error' AND user_id % 12 IN (1, 4))"""


def _looped(v):
    number = F.col("user_id") % 12
    name = lambda n: F.concat(F.lit("svc-"), n.cast("string"))
    seen = v.events().where(F.col("event_type") == "error").select(number.alias("n")).distinct()
    pair = lambda kept, step: seen.where(kept).select(name(F.col("n")).alias("service"), name(F.col("n") + step).alias("depends_on"))
    return v.edges().unionByName(pair(F.col("n") >= 9, -9)).unionByName(pair(F.col("n").isin(1, 4), 4))


@query("graph_depth_of_cycles", f"""
    WITH RECURSIVE {LOOPED_SQL},
    n AS (SELECT service FROM links UNION SELECT depends_on FROM links),
    walk(service, spot, seen, depth) AS (
        SELECT service, service, [service], 0 FROM n UNION ALL
        SELECT w.service, l.service, list_append(seen, l.service), depth + 1 FROM walk w JOIN links l ON l.depends_on = w.spot
         WHERE depth < len(seen) AND len(list_distinct(seen)) = len(seen))
    SELECT service, max(depth) AS depth FROM walk GROUP BY service""")
def _(v):
    return graph.depths(_looped(v))


@query("strong_components", f"""
    WITH RECURSIVE {LOOPED_SQL},
    n AS (SELECT service FROM links UNION SELECT depends_on FROM links),
    reach(a, b) AS (SELECT service, service FROM n UNION SELECT a, depends_on FROM reach JOIN links ON service = b)
    SELECT x.a AS service, max(x.b) AS scc FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a""")
def _(v):
    return graph.strong_components(_looped(v))


@query("graph_depth", """
    WITH RECURSIVE n AS (SELECT service FROM v_edges UNION SELECT depends_on FROM v_edges),
    walk(service, depth) AS (SELECT service, 0 FROM n UNION
        SELECT e.depends_on, depth + 1 FROM walk JOIN v_edges e ON e.service = walk.service)
    SELECT service, max(depth) AS depth FROM walk GROUP BY service""")
def _(v):
    return graph.depths(v.edges())


@query("graph_components", """
    WITH RECURSIVE near AS (SELECT service a, depends_on b FROM v_edges UNION
                            SELECT depends_on, service FROM v_edges),
    reach(a, b) AS (SELECT a, a FROM near UNION
        SELECT reach.a, near.b FROM reach JOIN near ON near.a = reach.b)
    SELECT a AS service, min(b) AS component FROM reach GROUP BY a""")
def _(v):
    return graph.components(v.edges())


@query("graph_hops", """
    WITH near AS (SELECT service a, depends_on b FROM v_edges UNION SELECT depends_on, service FROM v_edges),
    n AS (SELECT DISTINCT a FROM near),
    pairs AS (SELECT DISTINCT 'svc-' || (user_id % 12) AS a, 'svc-' || (user_id * 7 % 15) AS b FROM events)
    SELECT a, b, CAST(CASE WHEN a NOT IN (SELECT a FROM n) OR b NOT IN (SELECT a FROM n) THEN NULL
        WHEN a = b THEN 0 WHEN EXISTS (SELECT 1 FROM near x WHERE x.a = pairs.a AND x.b = pairs.b) THEN 1
        WHEN EXISTS (SELECT 1 FROM near x JOIN near y ON x.b = y.a
                      WHERE x.a = pairs.a AND y.b = pairs.b) THEN 2 END AS INTEGER) AS hops FROM pairs""")
def _(v):
    name = lambda n: F.concat(F.lit("svc-"), n.cast("string"))
    pairs = v.table("events").select(
        name(F.col("user_id") % 12).alias("a"), name(F.col("user_id") * 7 % 15).alias("b")
    )
    return graph.hops_between(pairs, v.edges())


@query("service_sync", """
    WITH RECURSIVE n AS (SELECT service FROM v_edges UNION SELECT depends_on FROM v_edges),
    walk(service, depth) AS (SELECT service, 0 FROM n UNION
        SELECT e.depends_on, depth + 1 FROM walk JOIN v_edges e ON e.service = walk.service),
    d AS (SELECT service AS name, max(depth) AS graph_depth FROM walk GROUP BY service)
    SELECT name, 'unassigned' AS team, CASE WHEN graph_depth = 0 THEN 1 ELSE 2 END AS tier, graph_depth
      FROM d UNION ALL SELECT n_name, 'team', 3, 9 FROM nation""")
def _(v):
    stored = v.table("nation").select(
        F.col("n_name").alias("name"), F.lit("team").alias("team"), F.lit(3).alias("tier"),
        F.lit(9).alias("graph_depth"),
    )
    return graph.sync_services(stored, v.edges(), stored.select("name", "team"))


@query("fingerprints", "SELECT service, fingerprint, count(*) AS alerts FROM v_alerts GROUP BY 1, 2")
def _(v):
    return v.alerts().groupBy("service", "fingerprint").agg(F.count("*").alias("alerts"))


@query("public_keys", """
    SELECT 'inc-' || strftime(o_orderdate, '%Y-%m-%d') || '-' || replace(lower(n_name), '_', '-') || '-'
           || trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]', '-', 'g'), '-')
           || CASE WHEN o_orderkey % 3 > 0 THEN '-' || (o_orderkey % 3) ELSE '' END AS public_key,
           count(*) AS n
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1""")
def _(v):
    joined = v.table("orders").join(
        v.table("customer"), F.col("o_custkey") == F.col("c_custkey")
    ).join(v.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    key = public_key(
        F.col("o_orderpriority"), F.col("n_name"), F.col("o_orderdate"), F.col("o_orderkey") % 3
    )
    return joined.groupBy(key.alias("public_key")).agg(F.count("*").alias("n"))


# Errors forty times as dense, so that incidents meet.
_SPED = "TIMESTAMP '2024-01-01'"


def _busy_alerts(v):
    start = F.unix_micros(F.lit("2024-01-01").cast("timestamp"))
    return v.alerts().withColumn(
        "starts_at", F.timestamp_micros(start + F.floor((F.unix_micros("starts_at") - start) / 40).cast("bigint"))
    )


def _correlated_sql(window_s: int, threshold: float) -> str:
    """The rule one alert at a time: a recursion that carries the open incidents as a list."""
    return f"""
    WITH RECURSIVE near AS (SELECT service a, depends_on b FROM v_edges UNION SELECT depends_on, service FROM v_edges),
    hop AS (SELECT a, b, min(h) AS h FROM (SELECT a, a AS b, 0 AS h FROM near UNION ALL SELECT a, b, 1 FROM near
             UNION ALL SELECT x.a, y.b, 2 FROM near x JOIN near y ON x.b = y.a) GROUP BY a, b),
    reach AS (SELECT a, map(list(b), list(h)) AS hops FROM hop GROUP BY a),
    walk(service, depth) AS (SELECT a, 0 FROM near UNION
        SELECT e.depends_on, depth + 1 FROM walk JOIN v_edges e ON e.service = walk.service),
    busy AS (SELECT id, service, fingerprint, fingerprint || strftime(starts_at, '%Y%m%d') AS key,
                    make_timestamp(epoch_us({_SPED}) + (epoch_us(starts_at) - epoch_us({_SPED})) // 40) AS starts_at,
                    ['alertname=ErrorRate', 'service=' || service, 'severity=critical',
                     'namespace=ns-' || (CAST(substr(service, 5) AS INTEGER) % 3)] AS labels FROM v_alerts),
    queue AS (SELECT row_number() OVER (ORDER BY starts_at, id) AS n, *, epoch_us(starts_at) / 1e6 AS tm, 4 AS rank FROM busy),
    step(n, live, incident_id, kind, score) AS (
        SELECT 0::BIGINT, []::STRUCT(id BIGINT, born BIGINT, lo DOUBLE, hi DOUBLE, rank INTEGER, services VARCHAR[],
               labels VARCHAR[], keys VARCHAR[])[], NULL::BIGINT, NULL::VARCHAR, NULL::DOUBLE
        UNION ALL
        SELECT n, list_append(list_filter(live, lambda i: i.id <> coalesce(got, -1)),
                 CASE WHEN got IS NULL THEN {{'id': id, 'born': n, 'lo': tm, 'hi': tm, 'rank': rank, 'services': [service],
                                             'labels': labels, 'keys': [key]}}
                 ELSE list_transform(list_filter(live, lambda i: i.id = got), lambda i: {{'id': i.id, 'born': i.born,
                      'lo': least(i.lo, tm), 'hi': greatest(i.hi, tm), 'rank': greatest(i.rank, rank),
                      'services': list_distinct(list_append(i.services, service)),
                      'labels': list_concat(i.labels, list_filter(labels, lambda l: NOT list_contains(
                          list_transform(i.labels, lambda m: split_part(m, '=', 1)), split_part(l, '=', 1)))),
                      'keys': list_distinct(list_append(i.keys, key))}})[1] END),
               coalesce(got, id), CASE WHEN got IS NULL THEN 'new' WHEN held THEN 'attached' ELSE 'merged' END,
               CASE WHEN NOT held THEN score END
          FROM (SELECT n, live, id, service, key, labels, rank, tm, len(holder) > 0 AS held, -scored[1].cost AS score,
                       CASE WHEN len(holder) > 0 THEN holder[1].id ELSE scored[1].id END AS got
                  FROM (SELECT q.*, list_filter(live, lambda i: list_contains(i.keys, q.key)) AS holder,
                          list_sort(list_filter(list_transform(list_filter(live, lambda i: i.rank >= q.rank), lambda i: {{
                            'cost': -round(CASE WHEN greatest(i.lo - q.tm, q.tm - i.hi, 0) <= {window_s}
                                               THEN 0.4 * (1 - greatest(i.lo - q.tm, q.tm - i.hi, 0) / {window_s}) ELSE 0 END
                                + coalesce(0.4 * (1 - list_min(list_transform(i.services, lambda s: hops[s])) / 3.0), 0)
                                + 0.2 * len(list_intersect(i.labels, q.labels))
                                  / len(list_distinct(list_concat(i.labels, q.labels))), 9),
                            'born': i.born, 'id': i.id}}), lambda x: -x.cost >= {threshold})) AS scored
                      FROM (SELECT q.*, reach.hops, list_filter(step.live, lambda i: q.tm - i.hi <= 86400) AS live
                              FROM step JOIN queue q ON q.n = step.n + 1 LEFT JOIN reach ON reach.a = q.service) q))),
    decided AS (SELECT q.id AS alert_id, incident_id, kind, score, service, fingerprint, starts_at
                  FROM step JOIN queue q USING (n))"""


@query("correlate_alerts", _correlated_sql(300, 0.62) + """
    SELECT alert_id, incident_id, kind, round(score, 4) AS score FROM decided""")
def correlated(v):
    return correlation.correlate(_busy_alerts(v), v.edges()).select(
        "alert_id", "incident_id", "kind", F.round("score", 4).alias("score")
    )


@query("root_signals", _correlated_sql(300, 0.62) + """,
    deep AS (SELECT service, max(depth) AS depth FROM walk GROUP BY service),
    ranked AS (SELECT d.*, row_number() OVER (PARTITION BY incident_id
                      ORDER BY coalesce(depth, 0) DESC, starts_at, alert_id) AS k
                 FROM decided d LEFT JOIN deep USING (service))
    SELECT incident_id, alert_id, 'ErrorRate' AS alertname, service, fingerprint, starts_at FROM ranked WHERE k = 1""")
def _(v):
    alerts, edges = _busy_alerts(v), v.edges()
    return correlation.root_signals(correlation.correlate(alerts, edges), alerts, edges)


@query("storm_flags", """
    WITH t AS (SELECT id AS alert_id, fingerprint || strftime(starts_at, '%Y%m%d') AS incident_id, starts_at,
                      row_number() OVER (PARTITION BY fingerprint, strftime(starts_at, '%Y%m%d')
                                         ORDER BY starts_at, id) AS running FROM v_alerts)
    SELECT alert_id, incident_id, starts_at, CAST(running AS BIGINT) AS running, running > 5 AS is_storm,
           CASE WHEN running > 5 THEN running // 5 END AS banner FROM t""")
def _(v):
    alerts = v.alerts()
    grouped = alerts.select(
        F.col("id").alias("alert_id"),
        F.concat("fingerprint", F.date_format("starts_at", "yyyyMMdd")).alias("incident_id"),
    )
    return correlation.storm_flags(grouped, alerts).select(
        "alert_id", "incident_id", "starts_at", "running", "is_storm", "banner"
    )


@query("island_sizes")
def _(v):
    return correlation.island_sizes(v.alerts(), v.edges())


def _swept(window_s: int) -> str:
    return f"""({_correlated_sql(window_s, 0.62)}
        SELECT {window_s} AS window_s, 0.62::DOUBLE AS threshold, count(*) AS alerts,
               count(*) FILTER (WHERE kind = 'new') AS incidents, count(*) FILTER (WHERE kind = 'merged') AS merges FROM decided)"""


@query("correlation_sweep", f"SELECT * FROM {_swept(60)} UNION ALL SELECT * FROM {_swept(900)}")
def _(v):
    return correlation.sweep(_busy_alerts(v), v.edges(), [(60, 0.62), (900, 0.62)])


@query("severity_assessment", """
    WITH f AS (SELECT i.id, severity, tier, correlated_alert_count AS k,
                      CASE WHEN i.id % 11 = 0 THEN 20.0 WHEN i.id % 2 = 0 THEN 1.0 END AS burn, i.id % 4 AS ones
                 FROM v_incidents i LEFT JOIN v_services s ON s.id = i.primary_service_id),
    r AS (SELECT *, CASE severity WHEN 'sev1' THEN 4 WHEN 'sev2' THEN 3 WHEN 'sev3' THEN 2 ELSE 1 END AS own,
                 CASE tier WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 0 END AS low FROM f)
    SELECT id, greatest(own, low, CASE WHEN burn >= 14.4 OR ones >= 2 THEN 4 ELSE 0 END,
                        CASE WHEN ones < 2 AND k >= 3 THEN 3 ELSE 0 END) AS rank,
           'alert label ' || severity
           || CASE WHEN low > own OR tier = 1 THEN ' + tier-' || tier || ' service' ELSE '' END
           || CASE WHEN burn >= 14.4 THEN ' + error budget burn ' || printf('%.1f', burn) || 'x' ELSE '' END
           || CASE WHEN ones >= 2 THEN ' + ' || ones || ' tier-1 services affected'
                   WHEN k >= 3 THEN ' + ' || k || ' services affected' ELSE '' END AS said FROM r""")
def _(v):
    tiers = v.services().select(F.col("id").alias("primary_service_id"), F.col("tier").alias("service_tier"))
    key = F.col("id")
    facts = v.incidents().join(tiers, "primary_service_id", "left").select(
        "id", F.col("severity").alias("alert_severity"), "service_tier",
        F.col("correlated_alert_count").alias("affected_services"),
        F.when(key % 11 == 0, 20.0).when(key % 2 == 0, 1.0).alias("burn"),
        (key % 4).alias("tier_one_services"),
    )
    return severity.assess_severity(facts).select(
        "id", "rank", F.substring_index("reason", ": ", -1).alias("said")
    )


@query("escalations", """
    SELECT id, CASE WHEN severity = 'sev1' THEN 'sev1'
                    WHEN correlated_alert_count > 4 THEN CASE WHEN severity = 'sev2' THEN 'sev2' ELSE 'sev3' END
                    ELSE 'sev1' END AS level FROM v_incidents""")
def _(v):
    asked = v.incidents().select(
        "id", F.col("severity").alias("current"),
        F.when(F.col("correlated_alert_count") > 4, "sev3").otherwise("sev1").alias("target"),
        F.lit("U1").alias("actor"), F.lit("").alias("note"),
    )
    return severity.escalate(asked).select("id", "level")


DEPLOY_SQL = """
    WITH w AS (SELECT id, primary_service_id AS service, detected_at - INTERVAL 6 HOUR AS lo,
                      coalesce(resolved_at + INTERVAL 30 MINUTE, detected_at + INTERVAL 6 HOUR) AS hi
                 FROM v_incidents),
    f AS (SELECT w.id AS incident_id, d.sha, d.deployed_at FROM w JOIN v_deploys d
             ON d.service_id = w.service AND d.deployed_at BETWEEN lo AND hi
          UNION ALL
          SELECT w.id, d.sha, d.deployed_at FROM w JOIN v_deploys d
             ON w.service IS NULL AND d.deployed_at BETWEEN lo AND hi),
    r AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY deployed_at DESC, sha) AS rank FROM f)
    SELECT incident_id, sha, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 20"""


def _deploys(v):
    return v.deploys().withColumn("service", F.col("service_id").cast("string"))


def _owned(v):
    return v.incidents().withColumn("service", F.col("primary_service_id").cast("string"))


@query("deploys_near_incidents", DEPLOY_SQL)
def _(v):
    return deploys.deploys_near(_owned(v), _deploys(v)).select("incident_id", "sha", "rank")


@query("last_deploy_before", """
    WITH w AS (SELECT id, primary_service_id AS service, detected_at AS hi,
                      detected_at - INTERVAL 6 HOUR AS lo FROM v_incidents),
    f AS (SELECT w.id AS incident_id, d.sha, d.deployed_at FROM w JOIN v_deploys d
             ON (d.service_id = w.service OR w.service IS NULL) AND d.deployed_at BETWEEN lo AND hi)
    SELECT incident_id, sha, deployed_at FROM (SELECT *, row_number() OVER (
        PARTITION BY incident_id ORDER BY deployed_at DESC, sha) AS k FROM f) WHERE k = 1""")
def _(v):
    return deploys.last_deploy_before(_owned(v), _deploys(v)).select("incident_id", "sha", "deployed_at")


def _edits(v):
    """Events as edits of a message per user and type; about one in three repeats the last."""
    gone = F.col("value") > 60
    return v.events().select(
        F.col("user_id").cast("string").alias("channel_id"), F.col("event_type").alias("ts"),
        F.when(gone, "deleted").otherwise("edited").alias("kind"),
        F.when(~gone, F.floor(F.col("value") / 15).cast("string")).alias("text"),
        F.col("ts").alias("observed_at"),
    )


@query("message_revisions", """
    WITH e AS (SELECT user_id AS c, event_type AS m, CASE WHEN value > 60 THEN 'deleted' ELSE 'edited' END AS kind,
                      CASE WHEN value <= 60 THEN CAST(CAST(floor(value / 15) AS BIGINT) AS VARCHAR) END AS text,
                      ts AS seen FROM events WHERE event_type <> 'view'),
    p AS (SELECT *, lag(kind) OVER w AS pk, lag(text) OVER w AS pt, row_number() OVER w AS n
            FROM e WINDOW w AS (PARTITION BY c, m ORDER BY seen, kind, text))
    SELECT CAST(c AS VARCHAR) AS channel_id, m AS ts, kind, text, seen AS observed_at,
           CAST(row_number() OVER (PARTITION BY c, m ORDER BY seen, kind, text) AS INTEGER) AS revision
      FROM p WHERE n = 1 OR kind IS DISTINCT FROM pk OR text IS DISTINCT FROM pt""")
def _(v):
    edits = _edits(v)
    known = edits.where(F.col("ts") != "view").select("channel_id", "ts")
    return store.append_revisions(edits, known)


@query("alert_refires", """
    SELECT event_type || '-' || (user_id % 5) AS fingerprint, date_trunc('hour', ts) AS starts_at,
           count(*) AS seen_count, max(ts) AS last_seen_at, min(ts) AS received_at,
           arg_min(event_id, ts) AS id FROM events GROUP BY 1, 2""")
def _(v):
    sent = v.events().select(
        F.concat_ws("-", "event_type", (F.col("user_id") % 5).cast("string")).alias("fingerprint"),
        F.date_trunc("hour", "ts").alias("starts_at"), F.col("ts").alias("received_at"),
        F.col("event_id").alias("id"),
    )
    return store.count_refires(sent)


@query("insert_new_messages", """
    WITH k AS (SELECT *, row_number() OVER (PARTITION BY role, turn ORDER BY conv_id) AS n FROM conversations)
    SELECT role, turn, conv_id FROM k WHERE n = 1 AND turn NOT IN (SELECT r_regionkey FROM region)""")
def _(v):
    rows = v.table("conversations").select("role", "turn", "conv_id")
    stored = rows.join(v.table("region"), F.col("turn") == F.col("r_regionkey"), "left_semi")
    return store.insert_new(rows, stored, ["role", "turn"], ["conv_id"])


@query("upsert_latest", """
    SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (
        PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1""")
def _(v):
    rows = v.table("orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    done = F.col("o_orderstatus") == "F"
    return store.upsert_latest(
        rows.where(done), rows.where(~done), ["o_custkey"], ["o_orderdate", "o_orderkey"]
    ).drop("o_orderdate")


@query("next_sequence", """
    WITH old AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
    SELECT o.o_custkey, o_orderkey, CAST(coalesce(n, 0) + row_number() OVER (
             PARTITION BY o.o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS seq
      FROM orders o LEFT JOIN old USING (o_custkey) WHERE o_orderstatus <> 'F'""")
def _(v):
    rows = v.table("orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("timestamp").alias("at"),
                                    "o_orderstatus")
    stored = rows.where(F.col("o_orderstatus") == "F").groupBy("o_custkey").agg(F.count("*").alias("seq"))
    return store.next_sequence(
        rows.where(F.col("o_orderstatus") != "F"), stored, ["o_custkey"], ["at", "o_orderkey"], "seq"
    ).select("o_custkey", "o_orderkey", "seq")


@query("awaiting_document", """
    SELECT id, resolved_at FROM v_incidents WHERE state = 'closed'
       AND id NOT IN (SELECT incident_id FROM v_documents)""")
def _(v):
    return sweeps.awaiting_document(v.incidents(), v.documents(), limit=None, state="closed")


@query("nudges", """
    SELECT id, public_key, detected_at,
           CAST(epoch(TIMESTAMP '2001-08-02' - detected_at) AS BIGINT) AS age_s,
           'nudge:' || CAST(floor(epoch(TIMESTAMP '2001-08-02' - detected_at) / 300) AS BIGINT) AS discriminator
      FROM v_incidents WHERE state = 'engaged' AND correlated_alert_count > 4
       AND epoch(TIMESTAMP '2001-08-02' - detected_at) > 600""")
def _(v):
    late = v.incidents().withColumn(
        "acknowledged_at", F.when(F.col("correlated_alert_count") <= 4, F.col("acknowledged_at"))
    )
    return sweeps.nudges(late, ORDERS_AS_OF, limit=None)


@query("abandonment_candidates", """
    WITH moved AS (SELECT l_orderkey FROM lineitem WHERE l_shipdate > TIMESTAMP '2001-08-02' - INTERVAL 4800 HOUR)
    SELECT id, public_key, state, detected_at, state IN ('engaged', 'acknowledged') AS movable
      FROM v_incidents WHERE state IN ('engaged', 'mitigated')
       AND detected_at < TIMESTAMP '2001-08-02' - INTERVAL 4800 HOUR
       AND id NOT IN (SELECT l_orderkey FROM moved)
       AND id NOT IN (SELECT incident_id FROM v_messages WHERE received_at > TIMESTAMP '2001-08-02' - INTERVAL 4800 HOUR)""")
def _(v):
    moved = v.table("lineitem").select(
        F.col("l_orderkey").alias("incident_id"), F.col("l_shipdate").cast("timestamp").alias("occurred_at")
    )
    return sweeps.abandonment_candidates(
        v.incidents(), v.messages(), moved, ORDERS_AS_OF, hours=4800, limit=None
    )


@query("sampled_completeness", """
    WITH h AS (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY ts DESC) AS k FROM v_messages)
    SELECT channel_id, count(*) AS sampled, count(*) FILTER (WHERE user_id <> 'assistant') AS held,
           round(count(*) FILTER (WHERE user_id <> 'assistant') * 1.0::DOUBLE / count(*), 6) AS ratio
      FROM h WHERE k <= 15 GROUP BY channel_id""")
def _(v):
    history = v.messages()
    stored = history.where(F.col("user_id") != "assistant")
    return rounded(sweeps.completeness_of_channels(history, history, stored))


@query("orphan_channels", """
    SELECT DISTINCT 'C' || (event_id * 7) AS channel_id FROM events
     WHERE 'C' || (event_id * 7) NOT IN (SELECT chat_channel_id FROM v_incidents WHERE state <> 'closed')""")
def _(v):
    channels = v.events().select(F.concat(F.lit("C"), (F.col("event_id") * 7).cast("string")).alias("channel_id"))
    return sweeps.orphan_channels(channels, v.incidents().where(F.col("state") != "closed"))


@query("channel_incidents", """
    SELECT m.id, max(i.id) AS incident_id FROM v_messages m LEFT JOIN v_incidents i
        ON i.chat_channel_id = m.channel_id GROUP BY m.id""")
def _(v):
    return sweeps.with_incident(v.messages().select("id", "channel_id"), v.incidents()).drop("channel_id")


@query("incident_services", """
    SELECT DISTINCT i.id AS incident_id, s.name AS service FROM v_incidents i
      JOIN (SELECT l_orderkey AS id, s_nationkey AS sid FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
            UNION SELECT id, primary_service_id FROM v_incidents) a ON a.id = i.id
      JOIN v_services s ON s.id = a.sid""")
def _(v):
    touched = v.table("lineitem").join(v.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy(
        F.col("l_orderkey").alias("id")
    ).agg(F.collect_set("s_nationkey").alias("affected_services"))
    return sweeps.incident_services(v.incidents().join(touched, "id", "left"), v.services())


def _transitions(v):
    """A history per order line: the states its line number and flag suggest."""
    names = F.array(*[F.lit(s) for s in (
        "detected", "triaging", "engaged", "acknowledged", "mitigating", "mitigated", "resolved", "closed")])
    return v.table("lineitem").groupBy(
        F.col("l_orderkey").alias("incident_id"), F.col("l_linenumber").cast("int").alias("seq")
    ).agg(F.count("*").alias("n")).select(
        "incident_id", "seq", names[F.col("seq") - 1].alias("from_state"),
        F.when(F.col("n") > 1, "merged").otherwise(names[F.col("seq")]).alias("to_state"),
    )


@query("illegal_transitions", """
    WITH t AS (SELECT l_orderkey AS incident_id, CAST(l_linenumber AS INTEGER) AS seq, count(*) AS n
                 FROM lineitem GROUP BY 1, 2),
    s AS (SELECT *, ['detected', 'triaging', 'engaged', 'acknowledged', 'mitigating', 'mitigated', 'resolved',
                     'closed'] AS names FROM t),
    u AS (SELECT incident_id, seq, names[seq] AS from_state,
                 CASE WHEN n > 1 THEN 'merged' ELSE names[seq + 1] END AS to_state FROM s),
    j AS (SELECT u.*, p.to_state AS previous_state FROM u LEFT JOIN u p
             ON p.incident_id = u.incident_id AND p.seq = u.seq - 1)
    SELECT * FROM (SELECT incident_id, seq, from_state, to_state, previous_state,
        CASE WHEN (to_state = 'merged' AND from_state <> 'triaging') OR to_state = 'closed' THEN 'not_permitted'
             WHEN previous_state <> from_state THEN 'does_not_follow'
             WHEN seq > 1 AND previous_state IS NULL THEN 'missing_predecessor' END AS problem FROM j)
     WHERE problem IS NOT NULL""")
def _(v):
    return audit.illegal_transitions(_transitions(v))


@query("incident_violations", """
    SELECT id, 'resolved_before_detected' AS rule FROM v_incidents
     WHERE correlated_alert_count > 5 AND resolved_at IS NOT NULL
    UNION ALL SELECT id, 'merged_without_parent' FROM v_incidents
     WHERE state = 'mitigated' AND parent_incident_id IS NULL""")
def _(v):
    bent = v.incidents().withColumns(
        {
            "resolved_at": F.when(
                F.col("correlated_alert_count") > 5,
                F.when(F.col("resolved_at").isNotNull(), F.col("detected_at") - F.expr("INTERVAL 1 HOUR")),
            ).otherwise(F.col("resolved_at")),
            "state": F.when(F.col("state") == "mitigated", "merged").otherwise(F.col("state")),
        }
    )
    return audit.violations(bent, "incidents", "id")


@query("message_triage", """
    SELECT reason, count(*) AS n FROM (SELECT CASE WHEN role = 'assistant' THEN 'bot_message'
              WHEN turn = 3 THEN 'ignored_subtype' WHEN i.c IS NULL THEN 'not_an_incident_channel'
              WHEN turn = 4 THEN 'malformed_ts' ELSE 'stored' END AS reason
      FROM conversations LEFT JOIN (SELECT DISTINCT chat_channel_id AS c FROM v_incidents WHERE state <> 'closed') i
        ON i.c = 'C' || conv_id) GROUP BY reason""")
def _(v):
    turn = F.col("turn")
    events = v.messages().select(
        F.when(turn == 3, "channel_join").alias("subtype"),
        F.when(F.col("user_id") == "assistant", "B1").alias("bot_id"),
        F.col("channel_id").alias("channel"), F.when(turn == 4, "12x").otherwise(F.col("ts")).alias("ts"),
        "channel_id",
    )
    owned = sweeps.with_incident(events, v.incidents().where(F.col("state") != "closed"))
    return audit.triage_messages(owned).groupBy("reason").agg(F.count("*").alias("n"))


def _timeline(v):
    return v.events().select(
        F.col("ts").alias("time"), F.col("event_type").alias("intent"), F.col("user_id").alias("incident_id")
    )


@query("rollup_incident_daily", """
    SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type AS intent, count(*) AS events,
           count(DISTINCT user_id) AS incidents FROM events GROUP BY 1, 2""")
def _(v):
    return rollups.incident_daily(_timeline(v))


@query("rollup_llm_cost_daily", """
    SELECT date_trunc('day', created_at)::TIMESTAMP AS day, 'synthesize' AS role, model, prompt_version,
           CAST(sum(cost_usd) AS DOUBLE) AS cost, count(*) AS calls, round(avg(generation_ms), 6) AS avg_ms
      FROM v_documents GROUP BY 1, 2, 3, 4""")
def _(v):
    daily = rollups.llm_cost_daily(v.llm_calls())
    return rounded(daily.withColumn("cost", F.col("cost").cast("double")))


@query("rollup_page_load_daily", """
    SELECT date_trunc('day', time)::TIMESTAMP AS day, responder, count(*) AS pages,
           count(*) FILTER (WHERE severity = 'sev1') AS sev1_pages FROM v_pages GROUP BY 1, 2""")
def _(v):
    return rollups.page_load_daily(v.pages())


@query("rollup_llm_latency_daily", """
    SELECT DISTINCT model, true AS within_bound FROM v_documents""")
def _(v):
    """The sketch's value lies within two hundredths of the asked rank, over all calls."""
    calls = v.llm_calls()
    found = rollups.latency_quantile(rollups.llm_latency_daily(calls), ["model"], 0.95)
    ranks = calls.select("model", F.col("latency_ms").alias("own")).join(found, "model").groupBy("model").agg(
        F.avg((F.col("own") < F.col("latency_ms")).cast("int")).alias("below"),
        F.avg((F.col("own") <= F.col("latency_ms")).cast("int")).alias("up_to"),
    )
    return ranks.select("model", ((F.col("below") <= 0.97) & (F.col("up_to") >= 0.93)).alias("within_bound"))


@query("rollup_refresh_range", """
    SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type AS intent, count(*) AS events,
           count(DISTINCT user_id) AS incidents FROM events
     WHERE ts >= TIMESTAMP '2024-01-21' AND ts < TIMESTAMP '2024-01-30' GROUP BY 1, 2""")
def _(v):
    return rollups.incident_daily(rollups.refresh_range(_timeline(v), EVENTS_AS_OF, 10))


@query("spend_by_scope", """
    WITH c AS (SELECT CAST(incident_id AS VARCHAR) AS i, strftime(created_at, '%Y-%m-%d') AS d,
                      strftime(created_at, '%Y-%m') AS m, cost_usd FROM v_documents WHERE cost_usd > 0),
    s AS (SELECT 'incident' AS scope, i AS key, sum(cost_usd) AS spent, 0.02 AS l FROM c GROUP BY i
          UNION ALL SELECT 'day', d, sum(cost_usd), 0.1 FROM c GROUP BY d
          UNION ALL SELECT 'month', m, sum(cost_usd), 50.0 FROM c GROUP BY m)
    SELECT scope, key, round(CAST(spent AS DOUBLE), 6) AS spent, CAST(l AS DOUBLE) AS limit_usd,
           spent >= l AS breached FROM s""")
def _(v):
    limits = {"incident": 0.02, "day": 0.1, "month": 50.0}
    return rounded(spend.spend_by_scope(v.llm_calls(), limits))


@query("cost_estimate", """
    SELECT l_returnflag AS model, round(sum((l_orderkey * 3.0::DOUBLE + l_partkey * 15.0::DOUBLE) / 1000000), 4) AS cost_usd
      FROM lineitem GROUP BY 1""")
def _(v):
    cost = spend.estimated_cost(F.col("l_orderkey"), F.col("l_partkey"), F.lit(3.0), F.lit(15.0))
    return v.table("lineitem").groupBy(F.col("l_returnflag").alias("model")).agg(
        F.round(F.sum(cost), 4).alias("cost_usd")
    )


@query("similar_incidents", """
    WITH s AS (SELECT p.id AS probe_id, i.id, list_cosine_similarity(p.v, i.v) AS c
                 FROM v_vectors p JOIN v_vectors i ON p.id <> i.id WHERE p.id % 20 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY round(c, 9) DESC, id) AS rank FROM s WHERE c > 0.85)
    SELECT probe_id, CAST(rank AS INTEGER) AS rank, id, round(c, 6) AS similarity FROM r WHERE rank <= 5""")
def _(v):
    return rounded(similarity_index.similar_incidents(v.vector_versions(), F.col("id") % 20 == 0))


@query("similar_groups", """
    WITH RECURSIVE near AS MATERIALIZED (
        SELECT a.id AS a, b.id AS b FROM v_vectors a JOIN v_vectors b ON list_cosine_similarity(a.v, b.v) >= 0.85),
    reach(a, b) AS (SELECT a, b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON n.a = r.b)
    SELECT a AS id, min(b) AS group_id FROM reach GROUP BY a""")
def _(v):
    return similarity_index.similar_groups(v.vector_versions(), recall=0.999)
