"""The named reports over incidents, documents, action items and the model ledger.

Every report takes DataFrames and the instant it is asked at; nothing reads the clock.
Dimension tables are joined without hints: adaptive execution broadcasts the
side whose measured size is small enough and shuffles otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.functions.labels import is_open, severity_rank
from vigilake.functions.skew import exact_percentile
from vigilake.functions.times import after, as_of_literal, incident_timings, seconds_between

UNASSIGNED = "unassigned"


def _with_service_name(incidents: DataFrame, services: DataFrame, default: str | None = None):
    names = services.select(F.col("id").alias("primary_service_id"), F.col("name").alias("service"))
    joined = incidents.join(names, "primary_service_id", "left")
    if default is None:
        return joined
    return joined.withColumn("service", F.coalesce("service", F.lit(default)))


def _decimal_round(value, places: int, width: int = 20):
    """Half-away-from-zero rounding on decimals, returned as double."""
    exact = value.cast(f"decimal(38,{min(width, places + 12)})")
    return F.round(exact, places).cast("double")


def active_incidents(incidents: DataFrame, services: DataFrame, as_of) -> DataFrame:
    """Open incidents, most severe first, with the minutes since detection."""
    opened = _with_service_name(incidents.where(is_open(F.col("state"))), services)
    elapsed = seconds_between(F.col("detected_at"), as_of_literal(as_of)) / 60
    return opened.select(
        "public_key", "title", "severity", "state", "service", "detected_at",
        elapsed.alias("elapsed_min"), "correlated_alert_count", "chat_channel_id",
    ).orderBy(severity_rank(F.col("severity")).desc(), "detected_at")


def mttr_by_service(
    incidents: DataFrame, services: DataFrame, as_of, days: int = 30
) -> DataFrame:
    """Median and tail response times per service; incidents without one stay visible.

    Durations are whole seconds, so the exact percentile's state is one counter
    per distinct duration, built on the map side, however many incidents a
    service has.
    """
    resolved = incident_timings(incidents.where(after(F.col("resolved_at"), as_of, days)))
    named = _with_service_name(resolved, services, UNASSIGNED)
    median = lambda col, unit: (F.percentile(col, 0.5) / unit)
    return (
        named.groupBy("service")
        .agg(
            F.count("*").alias("incidents"),
            median("tta_seconds", 1).alias("p50_tta_s"),
            median("ttm_seconds", 60).alias("p50_ttm_min"),
            median("mttr_seconds", 60).alias("p50_mttr_min"),
            (F.percentile("mttr_seconds", 0.95) / 60).alias("p95_mttr_min"),
        )
        .orderBy(F.desc_nulls_last("p50_mttr_min"))
    )


def storm_compression(incidents: DataFrame, as_of, days: int = 90) -> DataFrame:
    """Alerts absorbed per root incident and week; NULL in a week without a root incident."""
    roots = F.count_if(F.col("parent_incident_id").isNull())
    alerts = F.sum("correlated_alert_count")
    return (
        incidents.where(after(F.col("detected_at"), as_of, days))
        .groupBy(F.date_trunc("week", "detected_at").alias("week"))
        .agg(roots.alias("incidents"), alerts.alias("alerts"))
        .withColumn(
            "ratio",
            _decimal_round(
                F.col("alerts").cast("decimal(20,0)") / F.nullif(F.col("incidents"), F.lit(0)), 1
            ),
        )
        .orderBy("week")
    )


def runbook_efficacy(
    incidents: DataFrame, runbooks: DataFrame, signals: DataFrame, min_uses: int = 3
) -> DataFrame:
    """How fast and how completely each runbook is followed on mitigated incidents."""
    followed = (
        signals.groupBy(F.col("incident_id").alias("id"), "runbook_id")
        .agg(F.count("*").alias("followed"))
    )
    books = runbooks.select(
        F.col("id").alias("runbook_id"), "name",
        F.nullif(F.size("step_ids"), F.lit(0)).alias("declared"),
    )
    used = incident_timings(incidents.where(F.col("mitigated_at").isNotNull()))
    return (
        used.select("id", "runbook_id", "ttm_seconds")
        .join(followed, ["id", "runbook_id"], "left")
        .join(books, "runbook_id")
        .groupBy("name")
        .agg(
            F.count("*").alias("uses"),
            (F.percentile("ttm_seconds", 0.5) / 60).alias("median_ttm_min"),
            F.avg(F.coalesce("followed", F.lit(0)) / F.col("declared")).alias("adherence"),
        )
        .where(F.col("uses") >= min_uses)
        .orderBy(F.desc("median_ttm_min"))
    )


def dead_steps(
    incidents: DataFrame, runbooks: DataFrame, signals: DataFrame,
    min_uses: int = 5, skip_threshold: float = 0.8,
) -> DataFrame:
    """Declared steps almost nobody executes.

    Uses of a step are the uses of its runbook, so incidents are counted per
    runbook and executions per step; incidents are never multiplied by steps.
    """
    used = incidents.where(
        F.col("mitigated_at").isNotNull() & F.col("runbook_id").isNotNull()
    ).select("id", "runbook_id").distinct()
    uses = used.groupBy("runbook_id").agg(F.count("*").alias("uses"))
    executed = (
        signals.select(F.col("incident_id").alias("id"), "step_id").distinct()
        .join(used, "id")
        .groupBy("runbook_id", "step_id")
        .agg(F.count("*").alias("executed"))
    )
    steps = runbooks.select(
        F.col("id").alias("runbook_id"), "name",
        F.explode(F.array_distinct("step_ids")).alias("step_id"),
    )
    skipped = F.col("uses") - F.coalesce(F.col("executed"), F.lit(0))
    rate = skipped.cast("decimal(20,0)") / F.col("uses").cast("decimal(20,0)")
    return (
        steps.join(uses, "runbook_id")
        .join(executed, ["runbook_id", "step_id"], "left")
        .where((F.col("uses") >= min_uses) & (rate > F.lit(skip_threshold)))
        .select(
            "name", F.col("step_id").alias("step"), "uses", skipped.alias("skipped"),
            _decimal_round(rate, 2).alias("skip_rate"),
        )
        .orderBy(F.desc("skip_rate"))
    )


def toil_by_service(
    incidents: DataFrame, services: DataFrame, as_of, days: int = 7
) -> DataFrame:
    """Incidents and elapsed incident hours per service."""
    resolved = incident_timings(incidents.where(after(F.col("resolved_at"), as_of, days)))
    hours = F.sum("mttr_seconds").cast("decimal(24,0)") / F.lit(3600).cast("decimal(6,0)")
    return (
        _with_service_name(resolved, services, UNASSIGNED)
        .groupBy("service")
        .agg(F.count("*").alias("incidents"), _decimal_round(hours, 1).alias("incident_hours"))
        .orderBy(F.desc_nulls_last("incident_hours"))
    )


def latest_revision(documents: DataFrame) -> DataFrame:
    """The newest revision of each incident's document, reduced on the map side."""
    row = F.struct(*[c for c in documents.columns if c != "incident_id"])
    newest = documents.groupBy("incident_id").agg(F.max_by(row, F.col("revision")).alias("row"))
    return newest.select("incident_id", "row.*").select(*documents.columns)


def grounding_compliance(documents: DataFrame, limit: int = 30) -> DataFrame:
    """Per day: published documents, how many are fully grounded, how many are skeletons."""
    return (
        latest_revision(documents)
        .groupBy(F.date_trunc("day", "created_at").alias("day"))
        .agg(
            F.count("*").alias("pirs"),
            F.count_if(F.col("citation_coverage") == 1).alias("fully_grounded"),
            F.count_if(F.col("generation_layer") == "skeleton").alias("skeletons"),
            _decimal_round(F.avg("human_edit_ratio"), 3).alias("avg_edit_ratio"),
        )
        .orderBy(F.desc("day"))
        .limit(limit)
    )


def action_half_life(action_items: DataFrame, as_of) -> DataFrame:
    """Open and closed items per priority, median days to close, oldest open item."""
    close_days = seconds_between(F.col("created_at"), F.col("completed_at")) / 86_400
    age_days = seconds_between(F.col("created_at"), as_of_literal(as_of)) / 86_400
    timed = action_items.withColumn("close_days", close_days)
    counts = timed.groupBy("priority").agg(
        F.count_if(F.col("status") == "open").alias("open_now"),
        F.count_if(F.col("status") == "done").alias("closed"),
        F.max(F.when(F.col("status") == "open", age_days)).alias("oldest_open_days"),
    )
    medians = exact_percentile(timed, ["priority"], "close_days", 0.5, "median_close_days")
    return (
        counts.join(medians, "priority", "left")
        .select("priority", "open_now", "closed", "median_close_days", "oldest_open_days")
        .orderBy("priority")
    )


def cost_per_document(documents: DataFrame, as_of, days: int = 60) -> DataFrame:
    """Cost, latency and edit ratio per prompt version and model; skeletons cost nothing."""
    return (
        documents.where(
            after(F.col("created_at"), as_of, days) & (F.col("generation_layer") != "skeleton")
        )
        .groupBy("prompt_version", "model")
        .agg(
            F.count("*").alias("pirs"),
            _decimal_round(F.avg("cost_usd"), 4).alias("avg_cost_usd"),
            _decimal_round(F.sum("cost_usd"), 4).alias("total_cost_usd"),
            _decimal_round(F.avg("generation_ms"), 0).alias("avg_ms"),
            _decimal_round(F.avg("human_edit_ratio"), 3).alias("avg_edit_ratio"),
        )
        .orderBy(F.desc("prompt_version"), "model")
    )


def transcript_completeness(incidents: DataFrame, messages: DataFrame) -> DataFrame:
    """Stored messages and the newest arrival per open incident, zero when none."""
    stored = messages.groupBy(F.col("incident_id").alias("id")).agg(
        F.count("*").alias("stored"), F.max("received_at").alias("newest_stored_at")
    )
    return (
        incidents.where(is_open(F.col("state")))
        .select("id", "public_key", "chat_channel_id")
        .join(stored, "id", "left")
        .select(
            "public_key", "chat_channel_id",
            F.coalesce("stored", F.lit(0)).alias("stored"), "newest_stored_at",
        )
        .orderBy("public_key")
    )


def deployments(ledger: DataFrame, limit: int = 50) -> DataFrame:
    """The model ledger, newest first."""
    return ledger.select(
        "role", "provider", "model", "state", "traffic_pct", "prompt_version", "eval_run_id",
        "promoted_by", "started_at", "ended_at",
    ).orderBy(F.desc("started_at")).limit(limit)


def compression_total(weeks: DataFrame) -> DataFrame:
    """Overall alerts per incident over the weekly report."""
    return weeks.agg(
        F.sum("alerts").alias("alerts"), F.sum("incidents").alias("incidents")
    ).withColumn("ratio", F.col("alerts") / F.nullif(F.col("incidents"), F.lit(0)))


def grounding_total(days: DataFrame) -> DataFrame:
    """Share of model drafts that are fully grounded over the daily report, in percent."""
    return days.agg(
        F.sum("fully_grounded").alias("grounded"),
        F.sum(F.col("pirs") - F.col("skeletons")).alias("drafted"),
    ).withColumn("grounded_pct", F.col("grounded") / F.nullif(F.col("drafted"), F.lit(0)) * 100)


def jsonable(df: DataFrame) -> DataFrame:
    """Decimals as doubles and timestamps as ISO text, driven by the schema."""
    def projected(field):
        kind = field.dataType.typeName()
        if kind == "decimal":
            return F.col(field.name).cast("double").alias(field.name)
        if kind == "timestamp":
            return F.date_format(field.name, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias(field.name)
        return F.col(field.name)

    return df.select(*[projected(f) for f in df.schema.fields])
