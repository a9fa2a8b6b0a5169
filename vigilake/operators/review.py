"""Review documents as lines of markdown for many incidents at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.functions.skew import time_cell, with_running

NEWEST_DEPLOYS = 5

# Wording of the documents.
BANNER = (
    "> :construction: **AI drafting unavailable** — this is the structured "
    "skeleton, generated from the recorded timeline and computed metrics. "
    "Please complete the narrative sections marked _TODO_."
)
TODO_PROMPTS = (
    ("Summary", "What happened, in two sentences someone outside the team would understand?"),
    ("Root cause", 'What actually caused it? _"We do not know yet" is a valid answer._'),
    ("Contributing factors", "What made it worse, or made it take longer to find?"),
    ("What went well", "What worked? Detection, tooling, a runbook step, a person."),
    ("What went wrong", "What slowed you down that could be fixed?"),
    ("Action items", "One line each, with an owner who was actually in this incident."),
)
DRAFT_SECTIONS = (
    ("summary", "Summary"),
    ("root_cause_hypothesis", "Root cause"),
    ("contributing_factors", "Contributing factors"),
    ("what_went_well", "What went well"),
    ("what_went_wrong", "What went wrong"),
)
DRAFT_FOOTER = (
    "_Every claim above carries a citation into the stored incident record. "
    "Impact figures are computed from metrics, never generated._"
)
IMPACT_VALUES = ("error_rate_pct", "failed_requests", "p99_latency_ms", "pods_unready", "total_requests")


def _lines(rows: DataFrame, section: int, *texts: Column | str, at: Column | None = None,
           rank: Column | None = None) -> DataFrame:
    """Each text as one line of the section; NULL texts are no line."""
    entries = F.array(
        *[F.struct(F.lit(i).alias("line"), (F.lit(t) if isinstance(t, str) else t).alias("text"))
          for i, t in enumerate(texts)]
    )
    moment = at if at is not None else F.lit(None).cast("timestamp")
    return rows.select(
        "incident_id", F.lit(section).alias("section"), moment.alias("at"),
        (rank if rank is not None else F.lit(0)).cast("int").alias("rank"), F.explode(entries).alias("e"),
    ).select("incident_id", "section", "at", "rank", "e.line", "e.text").where(F.col("text").isNotNull())


def _code(value: Column) -> Column:
    return F.concat(F.lit("`"), value, F.lit("`"))


def _general(value: Column) -> Column:
    """Six significant digits without trailing zeros, as figures are shown in a table."""
    plain = F.regexp_replace(F.format_string("%.6f", value), r"\.?0+$", "")
    digits = F.greatest(F.lit(0), F.lit(5) - F.floor(F.log10(F.abs(value))).cast("int"))
    rounded = F.round(value * F.pow(F.lit(10.0), digits)) / F.pow(F.lit(10.0), digits)
    short = F.regexp_replace(F.format_string("%.6f", rounded), r"\.?0+$", "")
    return F.when(value == 0, "0").when(F.abs(value) >= 1e6, F.format_string("%.5e", value)).otherwise(
        F.when(F.abs(value) < 1, plain).otherwise(short)
    )


def _impact_lines(report: DataFrame, section: int, with_reason: bool) -> DataFrame:
    known = F.coalesce(F.col("status") == "computed", F.lit(False))
    figures = [
        F.concat(F.lit(f"| `{name}` | "),
                 F.coalesce(_general(F.col(name).cast("double")), F.lit("unknown")), F.lit(" |"))
        for name in IMPACT_VALUES
    ]
    shown = [
        F.when(known & (F.lit(name != "error_rate_pct") | F.col(name).isNotNull()), text)
        for name, text in zip(IMPACT_VALUES, figures)
    ]
    gone = F.lit(
        "_Metrics unavailable for this window — **no impact figures are estimated.**_"
        if with_reason else "_Metrics unavailable for this window — **no figures are estimated.**_"
    )
    reason = F.concat(
        F.lit("_Reason: "), F.coalesce("reason", F.lit("no metrics adapter configured")), F.lit("_")
    )
    tail = [
        F.when(known, F.lit("")),
        F.when(known, F.lit("_Computed from PromQL over the incident window, not generated._")),
        F.when(~known, F.lit("")), F.when(~known, reason), F.lit(""),
    ] if with_reason else [F.lit("")]
    return _lines(
        report, section, "## Impact", "", F.when(~known, gone), F.when(known, F.lit("| Metric | Value |")),
        F.when(known, F.lit("|---|---|")), *shown, *tail,
    )


def skeleton_lines(
    incidents: DataFrame, report: DataFrame, timeline: DataFrame, deploys: DataFrame, counts: DataFrame,
    newest_deploys: int = NEWEST_DEPLOYS,
) -> DataFrame:
    """Lines of the model-free review of each incident; it names its `newest_deploys` deploys only.

    `incidents` has incident_id, public_key, title, severity, detected_at,
    resolved_at, runbook_name and the root alert's fields; `counts` has
    messages, events, alerts, steps and participants per incident; `deploys`
    carries its newest-first `rank`.
    """
    minutes = F.greatest(
        F.floor((F.unix_micros("resolved_at") - F.unix_micros("detected_at")) / 60_000_000), F.lit(0)
    )
    duration = (
        F.when(F.col("resolved_at").isNull(), "ongoing")
        .when(minutes >= 60, F.concat(F.floor(minutes / 60).cast("string"), F.lit("h "),
                                      (minutes % 60).cast("string"), F.lit("m")))
        .otherwise(F.concat(minutes.cast("string"), F.lit("m")))
    )
    iso = lambda name: F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss+00:00")
    headed = F.concat(
        F.lit("**Severity** "), F.upper("severity"), F.lit("  ·  **Detected** "), iso("detected_at"),
        F.lit("  ·  **Duration** "), duration,
    )
    head = _lines(
        incidents, 0, BANNER, "", F.concat(F.lit("# "), "public_key", F.lit(" — "), "title"), "", headed, ""
    )
    facts = incidents.select("incident_id").join(report, "incident_id", "left")
    entry = F.concat(
        F.lit("- "), _code(F.date_format("time", "HH:mm:ss")), F.lit(" **"), "intent", F.lit("**"),
        F.coalesce(F.concat(F.lit(" <@"), "author_user_id", F.lit(">")), F.lit("")), F.lit(" — "),
        "description", F.lit("  "), _code(F.concat(F.lit("tl:"), "timeline_id")),
    )
    known = counts.withColumn("events", F.coalesce("events", F.lit(0)))
    empty = F.when(
        F.col("events") == 0, F.lit("_No classified events were recorded for this incident._")
    )
    book = incidents.join(counts, "incident_id", "left")
    n = lambda name: F.coalesce(name, F.lit(0)).cast("string")
    root = F.concat(
        F.lit("- **Root signal** "), _code(F.col("root_alertname")), F.lit(" on "),
        _code(F.coalesce("root_service", F.lit("unknown"))), F.lit(" "),
        _code(F.concat(F.lit("alert:"), "root_fingerprint")),
    )
    runbook = F.concat(
        F.lit("- **Runbook** "), "runbook_name", F.lit(" ("), n("steps"), F.lit(" steps recorded)")
    )
    deploy = F.concat(
        F.lit("- **Deploy** "), _code(F.col("sha")), F.lit(" to "), _code(F.col("service")),
        F.lit(" at "), iso("deployed_at"), F.lit("  "), _code(F.concat(F.lit("deploy:"), "sha")),
    )
    transcript = F.concat(
        F.lit("- **Transcript** "), n("messages"), F.lit(" messages from "), n("participants"),
        F.lit(" participants"),
    )
    todo = [
        line for heading, prompt in TODO_PROMPTS
        for line in (f"## {heading}", "", f"_TODO — {prompt}_", "")
    ]
    closing = F.concat(
        F.lit("_Generated from "), n("messages"), F.lit(" stored messages, "), n("events"),
        F.lit(" timeline events and "), n("alerts"),
        F.lit(" alerts. No model was involved in this document._"),
    )
    parts = [
        head, _impact_lines(facts, 1, True), _lines(incidents, 2, "## Timeline", ""),
        _lines(timeline, 3, entry, at=F.col("time")), _lines(known, 4, empty, ""),
        _lines(incidents, 5, "## Evidence available", "", root), _lines(book, 6, runbook),
        _lines(deploys.where(F.col("rank") <= newest_deploys), 7, deploy, rank=F.col("rank")),
        _lines(book, 8, transcript, ""), _lines(incidents, 9, *todo), _lines(book, 10, "---", "", closing),
    ]
    return _union(parts)


def draft_lines(incidents: DataFrame, claims: DataFrame, report: DataFrame) -> DataFrame:
    """Lines of the cited review: every claim followed by the references it rests on."""
    head = _lines(
        incidents, 0, F.concat(F.lit("# "), "public_key", F.lit(" — "), "title"), "",
        F.concat(F.lit("**Severity** "), F.upper("severity"), F.lit("  ·  **Service** "),
                 F.coalesce("service", F.lit("unknown"))), "",
    )
    facts = incidents.select("incident_id").join(report, "incident_id", "left")
    refs = F.array_join(F.transform("citations", lambda c: _code(c["ref"])), " ")
    parts = [head, _impact_lines(facts, 1, False)]
    said = F.concat(F.lit("- "), "text", F.lit("  "), refs)
    present = claims.select("incident_id", "path", "field").withColumn(
        "name", F.regexp_extract("path", r"^[a-z_]+", 0)
    ).select("incident_id", "name").distinct()
    for i, (name, heading) in enumerate(DRAFT_SECTIONS):
        base = 10 * (i + 1)
        having = present.where(F.col("name") == name)
        own = claims.where(F.col("path").startswith(name))
        parts += [
            _lines(having, base, f"## {heading}", ""),
            _lines(own, base + 1, said, rank=F.col("position")), _lines(having, base + 2, ""),
        ]
        if name == "root_cause_hypothesis":
            lacking = incidents.join(having, "incident_id", "left_anti")
            parts.append(_lines(lacking, base, f"## {heading}", "", "_Not established during this incident._", ""))
    timed = present.where(F.col("name") == "timeline")
    clock = _code(F.date_format(F.try_to_timestamp("at"), "HH:mm:ss"))
    parts += [
        _lines(timed, 70, "## Timeline", ""),
        _lines(claims.where(F.col("path").startswith("timeline")), 71,
               F.concat(F.lit("- "), clock, F.lit(" "), "text", F.lit("  "), refs), rank=F.col("position")),
        _lines(timed, 72, ""),
    ]
    acted = present.where(F.col("name") == "action_items")
    owner = F.coalesce(F.concat(F.lit("<@"), "owner", F.lit(">")), F.lit("_unassigned_"))
    row = F.concat(
        F.lit("| "), "priority", F.lit(" | "), owner, F.lit(" | "), "text", F.lit(" | "), refs, F.lit(" |")
    )
    parts += [
        _lines(acted, 80, "## Action items", "", "| Priority | Owner | Action | Evidence |", "|---|---|---|---|"),
        _lines(claims.where(F.col("path").startswith("action_items")), 81, row, rank=F.col("position")),
        _lines(acted, 82, ""), _lines(incidents, 90, "---", "", DRAFT_FOOTER),
    ]
    return _union(parts)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def assemble(lines: DataFrame) -> DataFrame:
    """(incident_id, text): the lines of each document in order."""
    order = ["section", "at", "rank", "line", "text"]
    cell = F.struct("section", F.coalesce(time_cell(F.col("at"), 3600), F.lit(0)).alias("hour"))
    numbered = with_running(lines, ["incident_id"], cell, order, F.lit(1), "number")
    return numbered.groupBy("incident_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("number", "text"))), lambda l: l["text"]), "\n"
        ).alias("text")
    )
