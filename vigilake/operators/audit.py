"""Stored rows that break a declared rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.constants import CLAIM_MAX_CHARS, IGNORED_SUBTYPES, STATE_EDGES, TERMINAL_STATES
from vigilake.functions.times import chat_timestamp


def _not_before(column: str) -> Column:
    return F.col(column) < F.col("detected_at")


def _bad_length(column: str, low: int, high: int) -> Column:
    return ~F.length(column).between(low, high)


def _rules() -> dict[str, dict[str, Column]]:
    return {
        "incidents": {
            "acknowledged_before_detected": _not_before("acknowledged_at"),
            "mitigated_before_detected": _not_before("mitigated_at"),
            "resolved_before_detected": _not_before("resolved_at"),
            "merged_without_parent": (F.col("state") == "merged")
            & F.col("parent_incident_id").isNull(),
        },
        "model_deployments": {
            "unknown_state": ~F.col("state").isin(
                "shadow", "canary", "default", "deprecated", "rolled_back"
            ),
            "traffic_out_of_range": ~F.col("traffic_pct").between(0, 100),
            "shadow_with_traffic": (F.col("state") == "shadow") & (F.col("traffic_pct") != 0),
            "default_without_evidence": (F.col("state") == "default")
            & F.col("eval_run_id").isNull(),
        },
        "claims": {
            "text_length": _bad_length("text", 3, CLAIM_MAX_CHARS),
            "no_citation": F.coalesce(F.size("citations"), F.lit(0)) < 1,
            "reference_length": F.exists(
                F.coalesce("citations", F.array().cast("array<struct<kind:string,ref:string>>")),
                lambda c: ~F.length(c["ref"]).between(3, 200),
            ),
        },
        "action_items": {
            "priority": ~F.col("priority").rlike(r"^P[0-2]\z"),
            "description_length": _bad_length("description", 3, CLAIM_MAX_CHARS),
            "category_length": _bad_length("category", 2, 64),
            "no_citation": F.coalesce(F.size("citations"), F.lit(0)) < 1,
        },
    }


def violations(rows: DataFrame, table: str, key: str) -> DataFrame:
    """(key, rule): one row per broken rule; a condition over NULL does not break a rule.

    Rules whose columns the input lacks are not checked.
    """
    checks = []
    for name, broken in _rules()[table].items():
        checks.append((name, broken))
    flags = F.array(*[F.when(broken, F.lit(name)) for name, broken in checks])
    return rows.select(F.col(key), F.explode(F.array_compact(flags)).alias("rule"))


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Declared-unique keys that occur more than once."""
    return rows.groupBy(*keys).agg(F.count("*").alias("copies")).where(F.col("copies") > 1)


def rival_defaults(ledger: DataFrame) -> DataFrame:
    """Roles with more than one live default."""
    live = ledger.where((F.col("state") == "default") & F.col("ended_at").isNull())
    return duplicate_keys(live, ["role"])


def illegal_transitions(transitions: DataFrame) -> DataFrame:
    """Transitions that leave a terminal state, are not permitted, or do not follow on.

    The predecessor is found by its sequence number, so a long history of one
    incident is spread like any other rows.
    """
    arrow = lambda a, b: F.concat_ws(">", a, b)
    allowed = [f"{a}>{b}" for a, b in STATE_EDGES]
    before = transitions.select(
        "incident_id", (F.col("seq") + 1).alias("seq"), F.col("to_state").alias("previous_state")
    )
    joined = transitions.join(before, ["incident_id", "seq"], "left")
    problem = (
        F.when(F.col("from_state").isin(*TERMINAL_STATES), "from_terminal")
        .when(~arrow("from_state", "to_state").isin(*allowed), "not_permitted")
        .when(F.col("previous_state") != F.col("from_state"), "does_not_follow")
        .when((F.col("seq") > 1) & F.col("previous_state").isNull(), "missing_predecessor")
    )
    return joined.withColumn("problem", problem).where(F.col("problem").isNotNull())


def message_reason() -> Column:
    """Why a chat event is not stored as a message; `stored` when it is."""
    blank = lambda name: F.coalesce(F.col(name), F.lit("")) == ""
    return (
        F.when(F.col("subtype") == "message_changed", "edit")
        .when(F.col("subtype") == "message_deleted", "delete")
        .when(~blank("bot_id"), "bot_message")
        .when(F.col("subtype").isin(*IGNORED_SUBTYPES), "ignored_subtype")
        .when(blank("channel") | blank("ts"), "malformed_event")
        .when(F.col("incident_id").isNull(), "not_an_incident_channel")
        .when(chat_timestamp(F.col("ts")).isNull(), "malformed_ts")
        .otherwise("stored")
    )


def triage_messages(events: DataFrame) -> DataFrame:
    """Chat events with the incident of their channel and a `reason` per event."""
    return events.withColumn("reason", message_reason())
