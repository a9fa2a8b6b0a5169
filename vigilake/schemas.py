"""Explicit schemas of the tables the operators read. Nothing is inferred at run time."""

from __future__ import annotations

from pyspark.sql.types import StructType

_DDL = {
    "services": "id INT, name STRING, team STRING, tier SMALLINT, depends_on ARRAY<INT>, "
    "graph_depth SMALLINT",
    "incidents": "id BIGINT, public_key STRING, dedup_key STRING, dedup_epoch INT, "
    "parent_incident_id BIGINT, title STRING, severity STRING, state STRING, "
    "primary_service_id INT, affected_services ARRAY<INT>, root_signal STRING, "
    "correlated_alert_count INT, detected_at TIMESTAMP, acknowledged_at TIMESTAMP, "
    "mitigated_at TIMESTAMP, resolved_at TIMESTAMP, closed_at TIMESTAMP, last_alert_at TIMESTAMP, "
    "chat_channel_id STRING, runbook_id INT, embedding ARRAY<FLOAT>",
    "alerts": "id BIGINT, incident_id BIGINT, source STRING, status STRING, fingerprint STRING, "
    "dedup_key STRING, alertname STRING, service STRING, severity STRING, severity_rank INT, "
    "labels MAP<STRING,STRING>, annotations MAP<STRING,STRING>, starts_at TIMESTAMP, "
    "ends_at TIMESTAMP, received_at TIMESTAMP, is_root_signal BOOLEAN, merge_score DECIMAL(4,3), "
    "merge_reasons ARRAY<STRING>, last_seen_at TIMESTAMP, seen_count INT",
    "incident_transitions": "incident_id BIGINT, seq INT, from_state STRING, to_state STRING, "
    "actor STRING, reason STRING, occurred_at TIMESTAMP",
    "messages": "id BIGINT, incident_id BIGINT, channel_id STRING, ts STRING, thread_ts STRING, "
    "user_id STRING, text STRING, received_at TIMESTAMP",
    "message_revisions": "message_id BIGINT, revision INT, kind STRING, text STRING, "
    "observed_at TIMESTAMP",
    "timeline_events": "time TIMESTAMP, incident_id BIGINT, intent STRING, "
    "confidence DECIMAL(3,2), description STRING, author_user_id STRING, "
    "source_message_ts STRING",
    "page_events": "time TIMESTAMP, responder STRING, incident_id BIGINT, severity STRING, "
    "tz STRING, accepted BOOLEAN",
    "runbooks": "id INT, name STRING, alert_pattern STRING, severity_filter STRING, "
    "service_filter STRING, step_ids ARRAY<STRING>",
    "step_signals": "incident_id BIGINT, runbook_id INT, step_id STRING, detected_by STRING, "
    "source_message_ts STRING, observed_at TIMESTAMP",
    "deploys": "sha STRING, service STRING, environment STRING, repository STRING, actor STRING, "
    "title STRING, deployed_at TIMESTAMP",
    "documents": "incident_id BIGINT, revision INT, generation_layer STRING, body STRING, "
    "provider STRING, model STRING, prompt_version STRING, cost_usd DECIMAL(10,6), "
    "generation_ms INT, citation_coverage DECIMAL(4,3), human_edit_ratio DECIMAL(4,3), "
    "created_at TIMESTAMP",
    "action_items": "id BIGINT, incident_id BIGINT, priority STRING, status STRING, owner STRING, "
    "created_at TIMESTAMP, completed_at TIMESTAMP",
    "llm_calls": "time TIMESTAMP, incident_id BIGINT, role STRING, provider STRING, model STRING, "
    "prompt_version STRING, input_tokens BIGINT, output_tokens BIGINT, cost_usd DECIMAL(10,6), "
    "latency_ms INT, outcome STRING",
    "signal_samples": "time TIMESTAMP, incident_id BIGINT, series STRING, service STRING, "
    "value DOUBLE",
    "metric_samples": "time TIMESTAMP, name STRING, labels MAP<STRING,STRING>, value DOUBLE",
    "model_deployments": "id BIGINT, role STRING, provider STRING, model STRING, state STRING, "
    "traffic_pct INT, prompt_version STRING, eval_run_id STRING, promoted_by STRING, "
    "started_at TIMESTAMP, ended_at TIMESTAMP",
    "correlation_feedback": "incident_id BIGINT, alert_id BIGINT, action STRING, actor STRING, "
    "original_score DOUBLE, original_reasons ARRAY<STRING>, created_at TIMESTAMP",
    "service_edges": "service STRING, depends_on STRING",
    "oncall_rota": "schedule STRING, members ARRAY<STRING>, period_days INT, team_channel STRING",
}

# A cited claim and the nested draft document.
_CITATION = "ARRAY<STRUCT<kind: STRING, ref: STRING>>"
_CLAIM = f"STRUCT<text: STRING, citations: {_CITATION}>"
DRAFT_DDL = (
    f"summary ARRAY<{_CLAIM}>, "
    f"timeline ARRAY<STRUCT<at: STRING, description: STRING, citations: {_CITATION}>>, "
    f"contributing_factors ARRAY<{_CLAIM}>, what_went_well ARRAY<{_CLAIM}>, "
    f"what_went_wrong ARRAY<{_CLAIM}>, root_cause_hypothesis {_CLAIM}, "
    "action_items ARRAY<STRUCT<description: STRING, owner: STRING, priority: STRING, "
    f"category: STRING, citations: {_CITATION}>>"
)

ALERT_ENVELOPE_DDL = (
    "receiver STRING, status STRING, externalURL STRING, version STRING, groupKey STRING, "
    "truncatedAlerts INT, groupLabels MAP<STRING,STRING>, commonLabels MAP<STRING,STRING>, "
    "commonAnnotations MAP<STRING,STRING>, alerts ARRAY<STRUCT<status: STRING, "
    "labels: MAP<STRING,STRING>, annotations: MAP<STRING,STRING>, startsAt: STRING, "
    "endsAt: STRING, generatorURL: STRING>>"
)

CHAT_EVENT_DDL = (
    "type STRING, subtype STRING, channel STRING, ts STRING, thread_ts STRING, user STRING, "
    "bot_id STRING, text STRING, message STRUCT<ts: STRING, text: STRING>, "
    "previous_message STRUCT<ts: STRING>, deleted_ts STRING, event_time TIMESTAMP"
)


def schema(name: str) -> StructType:
    """The declared schema of one table."""
    return StructType.fromDDL(_DDL[name])


def table_names() -> tuple[str, ...]:
    return tuple(_DDL)
