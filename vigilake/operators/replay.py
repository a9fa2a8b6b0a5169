"""Scoring recorded incidents in one job: correlate, classify, ground, compare, aggregate.

Recordings come from `sources.files.read_recordings`. Every step is the table
operator the live data goes through, keyed by recording, so a thousand
recordings are one set of joins rather than a thousand runs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.functions.times import window_minutes
from vigilake.operators import evaluation, grounding
from vigilake.operators.correlation import correlate
from vigilake.operators.intent import timeline_id, with_rule_intent
from vigilake.operators.metrics import IMPACT_QUERIES, impact_windows
from vigilake.operators.spend import estimated_cost
from vigilake.schemas import DRAFT_DDL
from vigilake.session import cut_lineage
from vigilake.sources.webhooks import accepted, alert_entries

NEVER_S = 10 * 365 * 86_400  # a recording never closes an incident
LABELS_DDL = (
    "service STRING, severity STRING, expects_pir BOOLEAN, expected_incidents INT, "
    "expected_layer STRING, runbook STRING, resolved_t DOUBLE, "
    "timeline ARRAY<STRUCT<t: DOUBLE, intent: STRING>>, action_items ARRAY<STRING>"
)
MAX_ATTEMPTS = 2


def _at(path: str) -> Column:
    return F.get_json_object("body", "$." + path)


def _moment(offset: Column | str) -> Column:
    seconds = F.col(offset) if isinstance(offset, str) else offset
    return F.timestamp_micros(F.unix_micros("start") + F.round(seconds * 1_000_000).cast("bigint"))


@dataclass
class Recordings:
    """The tables of a set of recordings."""

    headers: DataFrame
    entries: DataFrame
    labels: DataFrame

    def of(self, *kinds: str) -> DataFrame:
        return self.entries.where(F.col("kind").isin(*kinds)).join(
            self.headers.select("recording", "start"), "recording"
        )

    def truth(self) -> DataFrame:
        parsed = self.labels.select("recording", F.from_json("labels", LABELS_DDL).alias("l"))
        return self.headers.select("recording").join(
            parsed.select("recording", "l.*"), "recording", "left"
        ).withColumns(
            {
                "expects_pir": F.coalesce("expects_pir", F.lit(True)),
                "expected_incidents": F.coalesce("expected_incidents", F.lit(1)),
            }
        )

    def alerts(self) -> DataFrame:
        """Alert entries through the ordinary normaliser, in recorded order."""
        group = F.to_json(F.struct(F.coalesce(_at("group.groupKey"), F.lit("")).alias("groupKey")))
        envelope = F.concat(F.lit('{"alerts":['), _at("payload"), F.lit("],"), F.substr(group, F.lit(2)))
        payloads = self.of("alert").select("recording", "seq", "t", envelope.alias("value"))
        return accepted(alert_entries(payloads, ("recording", "seq", "t"))).withColumns(
            {"id": F.xxhash64("recording", "seq"), "taken": F.struct("t", "seq")}
        )

    def messages(self) -> DataFrame:
        """Chat messages with the text of their last later edit."""
        order = F.struct("t", "seq")
        said = self.of("chat.event.message", "chat.event.message_changed").select(
            F.col("recording").alias("incident_id"), F.col("seq").alias("id"), "kind", "t",
            F.coalesce(_at("payload.ts"), F.concat(F.unix_seconds(_moment("t")).cast("string"), F.lit(".000100")))
            .alias("ts"),
            _at("payload.user").alias("user_id"), F.coalesce(_at("payload.text"), F.lit("")).alias("text"),
            order.alias("place"),
        )
        edits = said.where(F.col("kind") == "chat.event.message_changed").groupBy("incident_id", "ts").agg(
            F.max("place").alias("_when"), F.max_by("text", "place").alias("_new")
        )
        return said.where(F.col("kind") == "chat.event.message").join(
            edits, ["incident_id", "ts"], "left"
        ).withColumn("text", F.when(F.col("_when") > F.col("place"), F.col("_new")).otherwise(F.col("text"))).select(
            "incident_id", "id", "ts", "user_id", "text"
        )

    def timeline(self) -> DataFrame:
        """What the rules read out of every message and edit."""
        said = self.of("chat.event.message", "chat.event.message_changed").select(
            F.col("recording").alias("incident_id"), "t", _moment("t").alias("time"),
            F.coalesce(_at("payload.text"), F.lit("")).alias("text"),
        )
        read = with_rule_intent(said).where(F.col("rule.intent") != "noise").select(
            "incident_id", "t", "time", "rule.intent", F.col("rule.summary").alias("description"),
            F.lit(None).cast("string").alias("author_user_id"),
        )
        return timeline_id(read)

    def deploys(self) -> DataFrame:
        return self.of("deploy").select(
            F.col("recording").alias("incident_id"), F.coalesce(_at("payload.sha"), F.lit("")).alias("sha"),
            F.coalesce(_at("payload.service"), F.lit("")).alias("service"), _at("payload.title").alias("title"),
            _at("payload.actor").alias("actor"), _moment("t").alias("deployed_at"),
        )

    def incidents(self) -> DataFrame:
        """One row per recording: service, runbook name and the review window."""
        first = self.alerts().groupBy("recording").agg(
            F.min_by("starts_at", "taken").alias("_starts"), F.min_by("service", "taken").alias("_service")
        )
        last = self.entries.groupBy("recording").agg(F.max("t").alias("_last"))
        facts = self.headers.join(self.truth(), "recording").join(first, "recording", "left").join(
            last, "recording", "left"
        )
        return facts.select(
            F.col("recording").alias("id"), F.col("recording").alias("incident_id"),
            F.coalesce(F.nullif("service", F.lit("")), "_service").alias("service"),
            F.lit("default").alias("namespace"), F.col("runbook").alias("runbook_name"),
            F.coalesce("_starts", "start").alias("detected_at"),
            _moment(F.coalesce("resolved_t", "_last")).alias("resolved_at"),
        )

    def steps(self) -> DataFrame:
        names = self.incidents().select("incident_id", "runbook_name")
        return self.of("runbook.step").select(
            F.col("recording").alias("incident_id"), _at("payload.runbook_id").alias("runbook_id"),
            F.coalesce(_at("payload.step_id"), F.lit("")).alias("step_id"),
        ).join(names, "incident_id")

    def impact(self) -> DataFrame:
        """The impact report from recorded query answers; one missing answer voids it."""
        asked = self.incidents().select(
            "incident_id", F.coalesce("service", F.lit("unknown")).alias("service"), "namespace",
            "detected_at", F.col("resolved_at").alias("end_at"), F.lit("computed").alias("status"),
            window_minutes(F.col("detected_at"), F.col("resolved_at")).alias("minutes"),
            *[F.lit(None).cast("double").alias(key) for key in IMPACT_QUERIES],
        )
        answers = self.of("promql").groupBy(F.col("recording").alias("incident_id"), _at("query").alias("query")).agg(
            F.max(_at("response.value").cast("double")).alias("_answer"), F.count("*").alias("_answered")
        )
        windows = impact_windows(asked).join(answers, ["incident_id", "query"], "left")
        whole = windows.groupBy("incident_id").agg(F.count("_answered").alias("_n")).where(
            F.col("_n") == len(IMPACT_QUERIES)
        )
        return windows.join(whole, "incident_id", "left_semi").withColumn("value", F.col("_answer")).drop(
            "_answer", "_answered"
        )

    def calls(self) -> DataFrame:
        """Model calls with their attempt number."""
        rows = self.of("llm").where(F.coalesce(_at("role"), F.lit("synthesize")) == "synthesize")
        earlier = F.expr("row_number() OVER (PARTITION BY recording ORDER BY t, seq)")
        return rows.select(
            "recording", earlier.alias("attempt"), _at("response.content").alias("content"),
            _at("prompt_sha256").alias("prompt_sha"),
            F.coalesce(_at("response.input_tokens").cast("bigint"), F.lit(0)).alias("input_tokens"),
            F.coalesce(_at("response.output_tokens").cast("bigint"), F.lit(0)).alias("output_tokens"),
            F.coalesce(_at("response.latency_ms").cast("int"), F.lit(0)).alias("latency_ms"),
        )


def impact_number_rows(windows: DataFrame) -> DataFrame:
    """Spellings of the recorded figures and of the error rate derived from them."""
    wide = windows.groupBy("incident_id").agg(
        *[F.max(F.when(F.col("key") == key, F.col("value"))).alias(key) for key in IMPACT_QUERIES]
    ).withColumn(
        "error_rate_pct",
        F.when(F.col("total_requests") != 0, F.bround(F.col("failed_requests") / F.col("total_requests") * 100, 2)),
    )
    return grounding.impact_numbers(wide, [*IMPACT_QUERIES, "error_rate_pct"])


def replay(
    recordings: Recordings, edges: DataFrame, *, input_rate: float, output_rate: float,
    prompt_sha: str | None = None, **correlation,
) -> DataFrame:
    """One score row per recording, ready for `evaluation.corpus_metrics`.

    Parsed entries and judged claims feed many joins and are written once.
    """
    recordings = Recordings(
        cut_lineage(recordings.headers), cut_lineage(recordings.entries), cut_lineage(recordings.labels)
    )
    truth, timeline = recordings.truth(), recordings.timeline()
    ids = recordings.headers.select(F.col("recording").alias("id"))
    alerts, messages, deploys = recordings.alerts(), recordings.messages(), recordings.deploys()
    incidents, steps, windows = recordings.incidents(), recordings.steps(), recordings.impact()
    owned = alerts.withColumn("incident_id", F.col("recording"))

    made = correlate(
        alerts, edges, order="taken", tenant="recording", close_after_s=NEVER_S, **correlation
    ).where(F.col("kind") == "new").groupBy(F.col("tenant").cast("bigint").alias("id")).agg(
        F.count("*").alias("made")
    )
    stored = grounding.evidence(messages, timeline, owned, deploys, steps, windows)
    people = grounding.participants(messages, timeline, deploys)
    strong = grounding.strong_terms(incidents, owned, deploys, steps)
    numbers = impact_number_rows(windows)

    calls = recordings.calls()
    drafted = calls.where(F.col("attempt") <= MAX_ATTEMPTS).select(
        F.concat_ws("#", "recording", "attempt").alias("draft_id"), F.col("recording").alias("incident_id"),
        "attempt", F.from_json("content", DRAFT_DDL).alias("draft"),
    ).where(F.size("draft.summary") > 0)
    walked = grounding.walk_claims(drafted, "draft_id")
    walked = cut_lineage(walked)
    numbered = walked.withColumns(
        {
            "incident_id": F.substring_index("draft_id", "#", 1).cast("bigint"),
            "attempt": F.substring_index("draft_id", "#", -1).cast("int"),
            "path": F.concat_ws("#", F.substring_index("draft_id", "#", -1), "path"),
        }
    )
    judged = cut_lineage(grounding.judge_citations(numbered, stored, strong))
    broken = grounding.findings(numbered, judged, people, numbers).select(
        "incident_id", F.substring_index("path", "#", 1).cast("int").alias("attempt")
    ).distinct()
    chosen = numbered.select("incident_id", "attempt").distinct().join(
        broken, ["incident_id", "attempt"], "left_anti"
    ).groupBy("incident_id").agg(F.min("attempt").alias("attempt"))
    chosen = cut_lineage(chosen)
    claims = numbered.join(chosen, ["incident_id", "attempt"], "left_semi")
    cited = judged.withColumn("attempt", F.substring_index("path", "#", 1).cast("int")).join(
        chosen, ["incident_id", "attempt"], "left_semi"
    )
    quality = grounding.citation_scores(claims, cited).withColumnRenamed("incident_id", "id")

    predicted = timeline.select(F.col("incident_id").alias("id"), "t", "intent")
    labelled = truth.select(F.col("recording").alias("id"), F.explode("timeline").alias("e")).select(
        "id", F.coalesce("e.t", F.lit(0.0)).alias("t"), F.coalesce("e.intent", F.lit("")).alias("intent")
    )
    wanted = truth.select(
        F.col("recording").alias("id"), F.posexplode("action_items").alias("position", "description")
    )
    offered = claims.where(F.col("path").contains("action_items")).select(
        F.col("incident_id").alias("id"), F.col("text").alias("description")
    )
    spent = calls.groupBy(F.col("recording").alias("id")).agg(
        F.sum(estimated_cost(F.col("input_tokens"), F.col("output_tokens"), F.lit(input_rate), F.lit(output_rate)))
        .alias("cost_usd"),
        F.sum("latency_ms").alias("generation_ms"),
        F.countDistinct(F.when(F.col("prompt_sha") != F.lit(prompt_sha), F.col("prompt_sha"))).alias("prompt_drift"),
    )
    facts = (
        ids.join(recordings.headers.select(F.col("recording").alias("id"), "bucket"), "id")
        .join(truth.select(F.col("recording").alias("id"), "expects_pir", "expected_incidents", "expected_layer"), "id")
        .join(made, "id", "left").join(quality, "id", "left").join(spent, "id", "left")
        .join(chosen.select(F.col("incident_id").alias("id"), "attempt"), "id", "left")
        .join(evaluation.timeline_f1(predicted, labelled, ids), "id")
        .join(evaluation.action_item_recall(offered, wanted, ids), "id")
    )
    expected = F.col("expects_pir")
    clean = lambda name, empty: F.when(~expected, F.lit(empty)).otherwise(
        F.coalesce(name, F.lit(empty))).alias(name)
    layer = F.when(~expected, "none").when(F.col("attempt").isNotNull(), "primary").otherwise("skeleton")
    return facts.select(
        F.col("id").alias("recording"), "bucket", clean("timeline_f1", 1.0), clean("citation_precision", 1.0),
        clean("uncited_claims", 0), clean("fabricated_citations", 0), clean("action_item_recall", 1.0),
        evaluation.storm_score(F.coalesce("made", F.lit(0)), F.col("expected_incidents")).alias("storm_compression"),
        clean("cost_usd", 0.0), clean("generation_ms", 0), F.lit(0).alias("network_calls"),
        clean("prompt_drift", 0), layer.alias("layer"),
        F.when((layer == "skeleton") & (F.coalesce("expected_layer", F.lit("")) != "skeleton"), 1).otherwise(0)
        .alias("unexpected_skeleton"),
        F.lit(None).cast("string").alias("error"),
    )
