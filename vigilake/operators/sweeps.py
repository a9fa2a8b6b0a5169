"""Periodic checks over open work: what is late, lost, unclaimed or unwritten."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilake.constants import (
    ABANDON_AFTER_H,
    HISTORY_SAMPLE,
    NUDGE_AFTER_S,
    NUDGE_INTERVAL_S,
)
from vigilake.functions.labels import is_open
from vigilake.functions.times import as_of_literal, interval, seconds_between


def awaiting_document(
    incidents: DataFrame, documents: DataFrame, limit: int | None = None, state: str = "resolved"
) -> DataFrame:
    """Resolved incidents without any document, oldest first; a limit makes it one batch of a sweep."""
    written = documents.select(F.col("incident_id").alias("id")).distinct()
    waiting = (
        incidents.where(F.col("state") == state).join(written, "id", "left_anti")
        .orderBy("resolved_at", "id").select("id", "resolved_at")
    )
    return waiting if limit is None else waiting.limit(limit)


def nudges(
    incidents: DataFrame, as_of, after_s: int = NUDGE_AFTER_S, every_s: int = NUDGE_INTERVAL_S,
    limit: int | None = None,
) -> DataFrame:
    """Unacknowledged incidents due a reminder, one key per reminder interval."""
    age = seconds_between(F.col("detected_at"), as_of_literal(as_of))
    late = (
        incidents.where(
            F.col("state").isin("engaged", "triaging") & F.col("acknowledged_at").isNull()
            & (age > after_s)
        )
        .select("id", "public_key", "detected_at", F.round(age).cast("bigint").alias("age_s"))
        .withColumn(
            "discriminator",
            F.concat(F.lit("nudge:"), F.floor(F.col("age_s") / max(every_s, 60)).cast("string")),
        )
        .orderBy("detected_at", "id")
    )
    return late if limit is None else late.limit(limit)


def abandonment_candidates(
    incidents: DataFrame, messages: DataFrame, transitions: DataFrame, as_of,
    hours: int = ABANDON_AFTER_H, limit: int | None = None,
) -> DataFrame:
    """Open incidents silent for the period: no alert, no message, no transition.

    `movable` marks the states from which an incident may be abandoned.
    """
    edge = as_of_literal(as_of) - interval(hours, "HOUR")
    talked = messages.where(F.col("received_at") > edge).select("incident_id").distinct()
    moved = transitions.where(F.col("occurred_at") > edge).select("incident_id").distinct()
    silent = (
        incidents.where(
            is_open(F.col("state")) & (F.coalesce("last_alert_at", "detected_at") < edge)
        )
        .join(talked, F.col("id") == talked["incident_id"], "left_anti")
        .join(moved, F.col("id") == moved["incident_id"], "left_anti")
        .select(
            "id", "public_key", "state", "detected_at",
            F.col("state").isin("engaged", "acknowledged").alias("movable"),
        )
        .orderBy("detected_at", "id")
    )
    return silent if limit is None else silent.limit(limit)


def held_messages(candidates: DataFrame, messages: DataFrame) -> DataFrame:
    """Which of the candidate (channel_id, ts) are stored."""
    return candidates.join(messages.select("channel_id", "ts"), ["channel_id", "ts"], "left_semi")


def sampled_completeness(
    history: DataFrame, messages: DataFrame, sample: int = HISTORY_SAMPLE
) -> DataFrame:
    """Per channel, the share of the newest `sample` history entries that are stored."""
    newest = Window.partitionBy("channel_id").orderBy(F.desc("ts"))
    sampled = history.select("channel_id", "ts").distinct().withColumn(
        "_rank", F.row_number().over(newest)
    ).where(F.col("_rank") <= sample)
    stored = messages.select("channel_id", "ts").distinct().withColumn("_held", F.lit(1))
    return (
        sampled.join(stored, ["channel_id", "ts"], "left")
        .groupBy("channel_id")
        .agg(F.count("*").alias("sampled"), F.count("_held").alias("held"))
        .withColumn("ratio", F.col("held") / F.col("sampled"))
    )


def completeness_of_channels(
    channels: DataFrame, history: DataFrame, messages: DataFrame, sample: int = HISTORY_SAMPLE
) -> DataFrame:
    """Sampled completeness of every given channel; an empty history is complete."""
    measured = sampled_completeness(history, messages, sample)
    return channels.select("channel_id").distinct().join(measured, "channel_id", "left").select(
        "channel_id", F.coalesce("sampled", F.lit(0)).alias("sampled"),
        F.coalesce("held", F.lit(0)).alias("held"), F.coalesce("ratio", F.lit(1.0)).alias("ratio"),
    )


def orphan_channels(channels: DataFrame, incidents: DataFrame) -> DataFrame:
    """Channels no incident has ever owned, open or closed."""
    owned = incidents.where(F.col("chat_channel_id").isNotNull()).select(
        F.col("chat_channel_id").alias("channel_id")
    ).distinct()
    return channels.join(owned, "channel_id", "left_anti")


def with_incident(messages: DataFrame, incidents: DataFrame) -> DataFrame:
    """Chat rows with the incident their channel belongs to, NULL when none.

    A channel that served several incidents belongs to the newest of them.
    """
    owners = incidents.where(F.col("chat_channel_id").isNotNull()).groupBy(
        F.col("chat_channel_id").alias("channel_id")
    ).agg(F.max("id").alias("incident_id"))
    return messages.join(owners, "channel_id", "left")


def incident_services(incidents: DataFrame, services: DataFrame) -> DataFrame:
    """(incident_id, service) for affected services and the primary, ids resolved to names."""
    names = services.select(F.col("id").alias("_service"), F.col("name").alias("service"))
    ids = F.array_union(
        F.coalesce("affected_services", F.array().cast("array<int>")), F.array("primary_service_id")
    )
    return (
        incidents.select(F.col("id").alias("incident_id"), F.explode(ids).alias("_service"))
        .join(names, "_service").select("incident_id", "service").distinct()
    )
