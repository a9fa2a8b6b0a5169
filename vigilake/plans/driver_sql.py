"""SQL text of the test views and of each check, for an independent engine."""

from __future__ import annotations

import re

VIEWS = {
    "v_services": "SELECT n_nationkey AS id, n_name AS name, 1 + n_regionkey % 3 AS tier FROM nation",
    "v_lines": """
        SELECT l_orderkey, count(*) AS n, min(l_quantity) AS q_min, max(l_quantity) AS q_max,
               sum(l_quantity) AS q_sum, min(l_partkey) AS part
          FROM lineitem GROUP BY l_orderkey""",
    "v_incidents": """
        SELECT o_orderkey AS id, 'inc-' || o_orderkey AS public_key, 'order ' || o_orderkey AS title,
               'cust-' || o_custkey AS dedup_key,
               CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey - 1 END AS parent_incident_id,
               CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'sev1' WHEN '2' THEN 'sev2'
                    WHEN '3' THEN 'sev3' ELSE 'sev4' END AS severity,
               CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'P' THEN 'mitigated'
                    ELSE 'engaged' END AS state,
               CASE WHEN o_orderkey % 10 <> 0 THEN c_nationkey END AS primary_service_id,
               o_orderdate AS detected_at,
               o_orderdate + to_seconds(CAST(q_min * 60 AS BIGINT)) AS acknowledged_at,
               CASE WHEN o_orderstatus IN ('P', 'F')
                    THEN o_orderdate + to_seconds(CAST(q_sum * 60 AS BIGINT)) END AS mitigated_at,
               CASE WHEN o_orderstatus = 'F' THEN o_orderdate
                    + to_seconds(CAST(q_sum * 60 + q_max * 600 AS BIGINT)) END AS resolved_at,
               o_orderdate AS last_alert_at, n AS correlated_alert_count,
               CAST(part % 20 AS INTEGER) AS runbook_id, 'C' || (o_orderkey % 997) AS chat_channel_id
          FROM orders JOIN v_lines ON o_orderkey = l_orderkey
          JOIN customer ON o_custkey = c_custkey""",
    "v_timed": """
        SELECT *, epoch(acknowledged_at - detected_at) AS tta_seconds,
               epoch(mitigated_at - detected_at) AS ttm_seconds,
               epoch(resolved_at - detected_at) AS mttr_seconds FROM v_incidents""",
    "v_runbooks": """
        SELECT DISTINCT CAST(p_partkey % 20 AS INTEGER) AS id,
               'runbook-' || (p_partkey % 20) AS name FROM part""",
    "v_steps": """
        SELECT id AS runbook_id, name, 'step-' || k AS step_id
          FROM v_runbooks CROSS JOIN range(1, 8) t(k)""",
    "v_step_signals": """
        SELECT DISTINCT l_orderkey AS incident_id, i.runbook_id, 'step-' || l_linenumber AS step_id
          FROM lineitem JOIN v_incidents i ON i.id = l_orderkey WHERE l_returnflag <> 'N'""",
    "v_action_items": """
        SELECT o_orderkey AS incident_id,
               CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'P0' WHEN '2' THEN 'P1'
                    ELSE 'P2' END AS priority,
               CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE 'done' END AS status,
               o_orderdate AS created_at,
               CASE WHEN shipped >= o_orderdate THEN shipped END AS completed_at
          FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS shipped FROM lineitem
                             GROUP BY l_orderkey) ON o_orderkey = l_orderkey""",
    "v_documents": """
        SELECT d.doc_id // 2 AS incident_id, CAST(d.doc_id % 2 + 1 AS INTEGER) AS revision,
               CASE WHEN source = 'src0' THEN 'skeleton' ELSE 'primary' END AS generation_layer,
               'model-' || lang AS model, '2.' || (d.doc_id % 3) AS prompt_version,
               CAST(n_chars / 1000000.0 AS DECIMAL(10,6)) AS cost_usd, n_chars AS generation_ms,
               CASE quality WHEN 1 THEN 1.0 WHEN 0 THEN 0.5 END AS citation_coverage,
               CAST((d.doc_id % 10) / 10.0 AS DECIMAL(4,3)) AS human_edit_ratio,
               TIMESTAMP '2024-01-01 00:00:00' + to_hours(d.doc_id) AS created_at, text AS body
          FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "v_vectors": """
        SELECT vec_id * 3 + k AS id, list_transform(list_zip(embedding, list_reverse(embedding)),
                                                   lambda z: z[1]::DOUBLE + share::DOUBLE * z[2]::DOUBLE) AS v
          FROM embeddings, (VALUES (0, 0.0), (1, 0.3), (2, 0.5)) t(k, share)
        UNION ALL SELECT 10000000 + vec_id, embedding::DOUBLE[] FROM embeddings WHERE vec_id % 10 = 0""",
    "v_messages": """
        SELECT conv_id * 10000 + turn AS id, conv_id AS incident_id, 'C' || conv_id AS channel_id,
               CAST(1700000000 + conv_id * 3600 + turn * 60 AS VARCHAR) AS ts, role AS user_id, text,
               TIMESTAMP '2023-11-14 22:13:20' + to_seconds(conv_id * 3600 + turn * 60) AS received_at,
               turn
          FROM conversations""",
    "v_alerts": """
        SELECT event_id AS id, 'svc-' || (user_id % 12) AS service,
               substr(sha256('alertname=ErrorRate|service=svc-' || (user_id % 12) || '|namespace=ns-'
                      || (user_id % 12 % 3) || '|cluster=|severity=critical'), 1, 32) AS fingerprint,
               ts AS starts_at
          FROM events WHERE event_type = 'error'""",
    "v_edges": """
        SELECT DISTINCT 'svc-' || (user_id % 12) AS service, 'svc-' || (user_id % 12 + 3) AS depends_on
          FROM events WHERE event_type = 'error' AND user_id % 12 < 9""",
    "v_pages": """
        SELECT ts AS time, 'U' || user_id AS responder,
               CASE WHEN event_type = 'error' THEN 'sev1' ELSE 'sev3' END AS severity,
               CASE user_id % 3 WHEN 0 THEN 'UTC' WHEN 1 THEN 'Asia/Kolkata'
                    ELSE 'America/Los_Angeles' END AS tz, event_id AS incident_id,
               CASE user_id % 3 WHEN 0 THEN ts WHEN 1 THEN ts + INTERVAL 330 MINUTE
                    ELSE ts - INTERVAL 480 MINUTE END AS local_time
          FROM events WHERE event_type IN ('error', 'purchase')""",
    "v_page_incidents": """
        SELECT event_id AS id, ts AS detected_at,
               ts + to_microseconds(CAST(round(value * 60000000) AS BIGINT)) AS resolved_at
          FROM events WHERE event_type IN ('error', 'purchase')""",
    "v_deploys": """
        SELECT substr(sha256(CAST(l_orderkey * 10 + l_linenumber AS VARCHAR)), 1, 12) AS sha,
               s_nationkey AS service_id, l_orderkey * 10 + l_linenumber AS line,
               l_shipdate AS deployed_at
          FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""",
    "v_samples": """
        SELECT ts AS time, 'user-' || user_id AS series, event_type AS outcome, event_id,
               CAST(count(*) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id)
                    AS DOUBLE) AS value FROM events""",
}


def _needed(sql: str) -> list[str]:
    """Views a text uses, their own views first."""
    found: list[str] = []
    for name in sorted(set(re.findall(r"\bv_[a-z_]+\b", sql))):
        if name in VIEWS:
            for inner in [*_needed(VIEWS[name]), name]:
                if inner not in found:
                    found.append(inner)
    return found


def with_views(sql: str) -> str:
    """Puts the definitions of the views a query uses in front of it."""
    views = _needed(sql)
    if not views:
        return sql.strip()
    body = ", ".join(f"{name} AS ({VIEWS[name].strip()})" for name in views)
    text = sql.strip()
    if text.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {body}, {text[15:]}"
    if text.upper().startswith("WITH "):
        return f"WITH {body}, {text[5:]}"
    return f"WITH {body} {text}"
