"""Responder load, fatigue, routing and rota resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilake.constants import (
    FATIGUE_TERMS,
    INVITE_SECONDARY_AT,
    REROUTE_AT,
    ROTATION_EPOCH,
)
from vigilake.functions.text import saturating_ratio
from vigilake.functions.times import as_of_literal, interval, local_date, local_hour, seconds_between

DAY_HOURS = (8, 22)  # both hours count as day, so night starts at 23:00
LOAD_TERMS = (
    "pages_8h", "night_pages_24h", "sev1_count_7d", "incident_minutes_24h",
    "consecutive_oncall_days",
)


def fatigue_windows(
    pages: DataFrame, incidents: DataFrame, at, responder: str | None = None
) -> DataFrame:
    """Five load terms per responder over windows ending at `at`, both ends closed.

    One 30-day scan feeds all terms. The streak works on distinct local days,
    at most 31 per responder.
    """
    now = as_of_literal(at)
    recent = pages.where((F.col("time") > now - interval(30, "DAY")) & (F.col("time") <= now))
    if responder is not None:
        recent = recent.where(F.col("responder") == responder)
    since = lambda amount, unit: F.col("time") > now - interval(amount, unit)
    night = ~local_hour(F.col("time"), F.col("tz")).between(*DAY_HOURS)

    counts = (
        recent.where(since(7, "DAY"))
        .groupBy("responder")
        .agg(
            F.count_if(since(8, "HOUR")).alias("pages_8h"),
            F.count_if(since(24, "HOUR") & night).alias("night_pages_24h"),
            F.count_if(F.col("severity") == "sev1").alias("sev1_count_7d"),
        )
    )
    spans = incidents.select(
        F.col("id").alias("incident_id"),
        seconds_between(
            F.col("detected_at"), F.least(F.coalesce("resolved_at", now), now)
        ).alias("_seconds"),
    )
    engaged = (
        recent.where(since(24, "HOUR") & F.col("incident_id").isNotNull())
        .select("responder", "incident_id").distinct()
        .join(spans, "incident_id")
        .groupBy("responder")
        .agg(F.round(F.sum("_seconds") / 60).cast("int").alias("incident_minutes_24h"))
    )
    days = recent.select(
        "responder", local_date(F.col("time"), F.col("tz")).alias("day")
    ).distinct()
    by_day = Window.partitionBy("responder").orderBy("day")
    streaks = (
        days.withColumn("_run", F.date_sub("day", F.row_number().over(by_day)))
        .groupBy("responder", "_run")
        .agg(F.count("*").cast("int").alias("_length"), F.max("day").alias("_last"))
        .where(F.col("_last") >= F.date_sub(F.to_date(now), 1))
        .groupBy("responder")
        .agg(F.max("_length").alias("consecutive_oncall_days"))
    )
    zero = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    return (
        counts.join(engaged, "responder", "left")
        .join(streaks, "responder", "left")
        .select(
            "responder", "pages_8h", "night_pages_24h", "sev1_count_7d",
            zero("incident_minutes_24h"), zero("consecutive_oncall_days"),
        )
        .orderBy(F.desc("pages_8h"))
    )


def window_for(windows: DataFrame, responders: DataFrame) -> DataFrame:
    """Windows of the given responders; one never paged has an empty window."""
    joined = responders.select("responder").distinct().join(windows, "responder", "left")
    return joined.select(
        "responder", *[F.coalesce(c, F.lit(0)).alias(c) for c in LOAD_TERMS]
    )


def _fatigue_parts(max_pages: int) -> list[tuple[Column, Column]]:
    """(contribution, wording) of each term, in declared order."""
    weights = {name: (weight, ceiling) for name, weight, ceiling in FATIGUE_TERMS}
    plural = F.when(F.col("pages_8h") == 1, F.lit(" page in 8h")).otherwise(F.lit(" pages in 8h"))
    sources = (
        ("recent_pages", "pages_8h", plural),
        ("night_pages", "night_pages_24h", F.lit(" outside 08:00-22:00 local")),
        ("incident_time", "incident_minutes_24h", F.lit(" min in incidents in 24h")),
        ("long_rotation", "consecutive_oncall_days", F.lit(" consecutive on-call days")),
        ("sev1_load", "sev1_count_7d", F.lit(" sev1 in 7 days")),
    )
    parts = []
    for term, column, wording in sources:
        weight, ceiling = weights[term]
        if term == "recent_pages":
            ceiling = max_pages
        if term == "long_rotation":
            ratio = F.when(F.col(column) >= ceiling, 1.0).otherwise(0.0)
        else:
            ratio = saturating_ratio(F.col(column), ceiling)
        parts.append((F.lit(weight) * ratio, F.concat(F.col(column).cast("string"), wording)))
    return parts


def fatigue_scores(windows: DataFrame, max_pages: int = 2, reasons: int = 3) -> DataFrame:
    """Score in 0..1 with the heaviest contributing terms spelled out."""
    parts = _fatigue_parts(max_pages)
    total = F.least(sum((part for part, _ in parts), F.lit(0.0)), F.lit(1.0))
    terms = F.array(
        *[
            F.struct((-part).alias("neg"), F.lit(i).alias("at"), text.alias("text"))
            for i, (part, text) in enumerate(parts)
        ]
    )
    contributing = F.slice(F.array_sort(F.filter(terms, lambda t: t["neg"] < 0)), 1, reasons)
    return windows.withColumns(
        {"score": total, "reasons": F.transform(contributing, lambda t: t["text"])}
    )


def routing_band(score: Column) -> Column:
    return (
        F.when(score < INVITE_SECONDARY_AT, "page_primary")
        .when(score < REROUTE_AT, "page_primary_and_invite_secondary")
        .otherwise("page_secondary_notify_primary")
    )


def routing_plan(oncall: DataFrame, scores: DataFrame) -> DataFrame:
    """Who to page, notify and invite for each resolved schedule.

    `oncall` has schedule, primary, secondary, source, reason, team_channel.
    A primary without a fatigue row is rested; a schedule without a primary
    falls back to its team channel.
    """
    fatigue = scores.select(F.col("responder").alias("primary"), "score", "reasons")
    known = F.col("primary").isNotNull()
    score = F.when(known, F.coalesce("score", F.lit(0.0))).otherwise(F.lit(0.0))
    rerouted = F.col("routing") == "page_secondary_notify_primary"
    both = (F.col("routing") != "page_primary") & F.col("secondary").isNotNull()
    nobody = F.array().cast("array<string>")
    first, second = F.array("primary"), F.array("secondary")
    return (
        oncall.join(fatigue, "primary", "left")
        .withColumn("score", score)
        .withColumn("routing", routing_band(F.col("score")))
        .withColumn("page", F.when(~known, nobody).when(both & rerouted, second).otherwise(first))
        .withColumn(
            "notify",
            F.when(known & both & rerouted, first).when(known & both, second).otherwise(nobody),
        )
        .withColumn(
            "invite",
            F.when(~known, nobody).when(both, F.array("primary", "secondary")).otherwise(first),
        )
        .withColumn("broadcast_channel", F.when(~known, F.col("team_channel")))
        .withColumn(
            "degraded_reason",
            F.when(~known, F.coalesce("reason", F.lit("no on-call could be resolved")))
            .when(F.col("source") == "static_schedule", F.col("reason")),
        )
    )


def resolve_oncall(
    schedules: DataFrame, cache: DataFrame, provider: DataFrame, rota: DataFrame
) -> DataFrame:
    """First source that knows a primary: cache, provider, static rota, else team broadcast.

    `cache` and `provider` have schedule, primary, secondary; `provider` also a
    nullable error; `rota` is the output of `resolve_rota`.
    """
    def side(df: DataFrame, prefix: str, *extra: str) -> DataFrame:
        return df.select(
            "schedule", F.col("primary").alias(f"{prefix}_primary"),
            F.col("secondary").alias(f"{prefix}_secondary"),
            *[F.col(c).alias(f"{prefix}_{c}") for c in extra],
        )

    joined = (
        schedules.select("schedule").distinct()
        .join(side(cache, "cache"), "schedule", "left")
        .join(side(provider, "provider", "error"), "schedule", "left")
        .join(side(rota, "rota", "team_channel"), "schedule", "left")
    )
    source = (
        F.when(F.coalesce("cache_primary", F.lit("")) != "", "cache")
        .when(F.col("provider_primary").isNotNull() & F.col("provider_error").isNull(), "provider")
        .when(F.col("rota_primary").isNotNull(), "static_schedule")
        .otherwise("team_broadcast")
    )
    pick = lambda role: (
        F.when(F.col("source") == "cache", F.col(f"cache_{role}"))
        .when(F.col("source") == "provider", F.col(f"provider_{role}"))
        .when(F.col("source") == "static_schedule", F.col(f"rota_{role}"))
    )
    why = F.when(
        F.col("provider_error").isNotNull(),
        F.concat(F.lit("paging provider unavailable: "), F.col("provider_error")),
    ).otherwise(F.lit("paging provider returned no on-call"))
    return joined.withColumn("source", source).select(
        "schedule", pick("primary").alias("primary"), pick("secondary").alias("secondary"),
        "source", F.col("rota_team_channel").alias("team_channel"),
        F.when(F.col("source").isin("static_schedule", "team_broadcast"), why).alias("reason"),
    )


def resolve_rota(requests: DataFrame, rota: DataFrame) -> DataFrame:
    """Primary and next member for each (schedule, at); unknown schedules use `default`."""
    entry = F.struct("members", "period_days", "team_channel").alias("rota")
    rows = rota.select(F.col("schedule").alias("_entry"), entry)
    listed = rota.select("schedule", F.col("schedule").alias("_listed"))
    named = requests.join(listed, "schedule", "left").withColumn(
        "_entry", F.coalesce("_listed", F.lit("default"))
    )
    size = F.size("rota.members")
    slot = F.floor(
        F.datediff(F.to_date("at"), F.lit(ROTATION_EPOCH).cast("date"))
        / F.greatest(F.col("rota.period_days"), F.lit(1))
    )
    member = lambda step: F.get("rota.members", F.pmod(slot + step, size).cast("int"))
    return (
        named.join(rows, "_entry", "left")
        .select(
            "schedule", "at",
            F.when(size > 0, member(0)).alias("primary"),
            F.when(size > 1, member(1)).alias("secondary"),
            F.col("rota.team_channel").alias("team_channel"),
        )
    )


def enrich_pages(pages: DataFrame, responders: DataFrame, default_tz: str = "UTC") -> DataFrame:
    """Pages with the responder's own time zone, UTC when unknown."""
    zones = responders.select("responder", F.col("tz").alias("_tz"))
    return (
        pages.drop("tz").join(zones, "responder", "left")
        .withColumn("tz", F.coalesce("_tz", F.lit(default_tz)))
        .drop("_tz")
    )
