"""Checks of the metric, text, grounding and evaluation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilake.constants import BUCKETS, EXEMPLARS, INTENT_RULES
from vigilake.functions.evidence import message_ref, numbers_in
from vigilake.operators import evaluation, grounding, intent, metrics, privacy, review, runbooks
from vigilake.plans.registry import query, rounded

GROWN = """
    p AS (SELECT *, lag(value) OVER (PARTITION BY series ORDER BY time, event_id) AS prev FROM v_samples),
    g AS (SELECT *, CASE WHEN prev IS NULL THEN 0 WHEN value < prev THEN value ELSE value - prev END AS inc FROM p),
    st AS (SELECT CAST(ceil(epoch_us(time) / 30000000.0) AS BIGINT) * 30 AS s, sum(inc) AS tot,
                  sum(CASE WHEN outcome = 'error' THEN inc ELSE 0 END) AS bad FROM g GROUP BY 1)"""


def _grown(v):
    return metrics.increments(v.samples(), ["series"], ["event_id"])


def _ratio(width):
    return (
        f"(sum(bad) OVER (ORDER BY s RANGE BETWEEN {width - 30} PRECEDING AND CURRENT ROW) / {width}.0)"
        f" / greatest(sum(tot) OVER (ORDER BY s RANGE BETWEEN {width - 30} PRECEDING AND CURRENT ROW) / {width}.0, 1e-9)"
    )


RATIOS = ", ".join(
    f"{_ratio(s)} AS ratio_{w}" for w, s in (("5m", 300), ("30m", 1800), ("1h", 3600), ("6h", 21600))
)


@query("counter_increase", f"""
    WITH {GROWN} SELECT series, sum(inc) AS increase, count(*) AS samples FROM g GROUP BY series""")
def _(v):
    return _grown(v).groupBy("series").agg(
        F.sum("increase").alias("increase"), F.count("*").alias("samples")
    )


@query("error_ratios", f"""
    WITH {GROWN}, r AS (SELECT s, {RATIOS} FROM st)
    SELECT TIMESTAMP '1970-01-01' + to_seconds(s) AS at, round(ratio_5m, 6) AS ratio_5m,
           round(ratio_30m, 6) AS ratio_30m, round(ratio_1h, 6) AS ratio_1h, round(ratio_6h, 6) AS ratio_6h FROM r""")
def ratios(v):
    grown = _grown(v).withColumn("slo", F.lit("ingest"))
    return rounded(metrics.error_ratios(grown, ["slo"], F.col("outcome") == "error").drop("slo"))


def _held(flag, minutes):
    return f"""SELECT *, {flag} AND s - coalesce(min(CASE WHEN {flag} THEN s END) OVER (PARTITION BY run_{flag}), s)
                  >= {minutes * 60} AS firing_{flag}"""


@query("burn_rate_alerts", f"""
    WITH {GROWN}, r AS (SELECT s, {RATIOS} FROM st),
    f AS (SELECT s, ratio_1h > 14.4 * 0.01 AND ratio_5m > 14.4 * 0.01 AS fast,
                 ratio_6h > 6 * 0.01 AND ratio_30m > 6 * 0.01 AS slow FROM r),
    n AS (SELECT *, sum(CASE WHEN fast THEN 0 ELSE 1 END) OVER (ORDER BY s) AS run_fast,
                 sum(CASE WHEN slow THEN 0 ELSE 1 END) OVER (ORDER BY s) AS run_slow FROM f),
    a AS ({_held('fast', 2)} FROM n), b AS ({_held('slow', 15)} FROM a)
    SELECT TIMESTAMP '1970-01-01' + to_seconds(s) AS at, firing_fast AS fast_burn_firing,
           firing_slow AS slow_burn_firing FROM b""")
def _(v):
    grown = _grown(v).withColumn("slo", F.lit("ingest"))
    found = metrics.error_ratios(grown, ["slo"], F.col("outcome") == "error")
    return metrics.burn_alerts(found, ["slo"], objective=0.01).select(
        "at", "fast_burn_firing", "slow_burn_firing"
    )


@query("scalar_alerts", """
    WITH rules(alert, name, sign, edge, held) AS (VALUES
        ('ingest_latency', 0, '>', 0.25, 10), ('citation_coverage', 1, '<', 1.0, 1), ('validation_rejections', 2, '>', 0.05, 15),
        ('everything_is_a_skeleton', 3, '>', 0.5, 20), ('degradation_elevated', 4, '>=', 2.0, 5), ('degradation_degraded', 4, '==', 1.0, 30),
        ('budget_tripping', 5, '>', 3.0, 5), ('cost_per_incident', 6, '>', 0.5, 60), ('transcript_completeness', 7, '<', 0.9999, 15),
        ('history_off_reconciler', 8, '>', 0.0, 1), ('service_down', 9, '==', 0.0, 1), ('stream_backlog', 10, '>', 1000.0, 10)),
    d AS (SELECT date_trunc('hour', ts) AS t, user_id % 11 AS name,
                 CASE user_id % 11 WHEN 4 THEN floor(avg(value) / 10) WHEN 10 THEN avg(value) * 100 WHEN 9 THEN floor(avg(value) / 20)
                      WHEN 5 THEN avg(value) / 4 ELSE avg(value) / 20 END AS v
            FROM events GROUP BY 1, 2, user_id % 11),
    f AS (SELECT *, CASE sign WHEN '>' THEN v > edge WHEN '<' THEN v < edge WHEN '>=' THEN v >= edge ELSE v = edge END AS hit
            FROM d JOIN rules USING (name)),
    n AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY alert ORDER BY t) AS run FROM f)
    SELECT alert, t AS at, round(v, 6) AS value,
           hit AND epoch(t - min(CASE WHEN hit THEN t END) OVER (PARTITION BY alert, run)) >= held * 60 AS firing FROM n""")
def _(v):
    names = list(dict.fromkeys(name for _, name, *_ in metrics.SCALAR_ALERTS))
    mean = F.avg("value")
    number = F.col("number")
    hourly = v.events().groupBy(F.date_trunc("hour", "ts").alias("at"), (F.col("user_id") % 11).alias("number")).agg(
        F.when(number == 4, F.floor(mean / 10).cast("double")).when(number == 10, mean * 100)
        .when(number == 9, F.floor(mean / 20).cast("double")).when(number == 5, mean / 4).otherwise(mean / 20).alias("value")
    ).withColumn("name", F.element_at(F.array(*[F.lit(n) for n in names]), (number + 1).cast("int")))
    return rounded(metrics.scalar_alerts(hourly))


BOUNDS = BUCKETS["alerts_per_incident"]
LES = ", ".join(str(b) for b in BOUNDS) + ", CAST('inf' AS DOUBLE)"


@query("histogram_counts", f"""
    SELECT event_type, le, count(*) FILTER (WHERE value <= le) AS "count"
      FROM events, (SELECT unnest([{LES}]) AS le) GROUP BY 1, 2""")
def _(v):
    return metrics.histogram_counts(v.events(), "value", BOUNDS, ["event_type"])


@query("histogram_quantile", f"""
    WITH b AS (SELECT event_type, le, count(*) FILTER (WHERE value <= le) AS c
                 FROM events, (SELECT unnest([{LES}]) AS le) GROUP BY 1, 2),
    w AS (SELECT *, coalesce(lag(c) OVER o, 0) AS below, coalesce(lag(le) OVER o, 0) AS low,
                 max(c) OVER (PARTITION BY event_type) * 0.95 AS rank FROM b
           WINDOW o AS (PARTITION BY event_type ORDER BY le)),
    h AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY le) AS k FROM w WHERE c >= rank)
    SELECT event_type, round(CASE WHEN isinf(le) THEN 100 ELSE low + (le - low) * (rank - below) / (c - below) END, 6)
           AS value FROM h WHERE k = 1""")
def _(v):
    buckets = metrics.histogram_counts(v.events(), "value", BOUNDS, ["event_type"])
    return rounded(metrics.histogram_quantile(buckets, 0.95, ["event_type"]))


@query("instant_values", """
    SELECT series, arg_max(value, time) AS value FROM v_samples
     WHERE time <= TIMESTAMP '2024-01-20' AND time > TIMESTAMP '2024-01-19 12:00:00' GROUP BY series""")
def _(v):
    return metrics.instant_values(v.samples(), "2024-01-20 00:00:00", lookback_min=720)


@query("time_to_war_room", """
    SELECT i.id, epoch(min(m.received_at) - i.detected_at)::DOUBLE AS seconds
      FROM v_incidents i JOIN v_messages m ON m.incident_id = i.id GROUP BY i.id, i.detected_at""")
def _(v):
    opened = v.messages().select("incident_id", F.col("received_at").alias("created_at"))
    return metrics.time_to_war_room(v.incidents(), opened)


def _word_bounded(pattern: str) -> str:
    """The rule with letters of any script as word characters, for an engine without that option."""
    inner = pattern.removeprefix(r"\b").removesuffix(r"\b")
    return rf"(?i)(^|[^\p{{L}}\p{{M}}\p{{N}}_])({inner})([^\p{{L}}\p{{M}}\p{{N}}_]|$)"


_CASES = " ".join(
    f"WHEN regexp_matches(body, '{_word_bounded(pattern)}') THEN '{kind}'" for kind, pattern, _ in INTENT_RULES
)
_SURE = " ".join(f"WHEN '{kind}' THEN {confidence}" for kind, _, confidence in INTENT_RULES)


@query("rule_intents", f"""
    WITH t AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS body FROM documents),
    k AS (SELECT doc_id, CASE WHEN length(body) < 3 OR body[1] = ':' THEN 'sure'
                 {_CASES} ELSE 'noise' END AS kind FROM t)
    SELECT doc_id, CASE kind WHEN 'sure' THEN 'noise' ELSE kind END AS intent,
           CAST(CASE kind WHEN 'sure' THEN 1.0 WHEN 'noise' THEN 0.5 {_SURE} END AS DOUBLE) AS confidence FROM k""")
def _(v):
    return intent.with_rule_intent(v.table("documents").select("doc_id", "text")).select(
        "doc_id", "rule.intent", "rule.confidence"
    )


_PHRASES = ", ".join(
    "({}, '{}', '{}')".format(i, kind, phrase.replace("'", "''"))
    for i, (kind, phrase) in enumerate((kind, p) for kind, phrases in EXEMPLARS.items() for p in phrases)
)


@query("nearest_exemplar", f"""
    WITH given(i, kind, phrase) AS (VALUES {_PHRASES}),
    said AS (SELECT 'p' AS side, i AS a, 0 AS b, phrase AS text FROM given UNION ALL
             SELECT 'm', conv_id, turn, text FROM conversations),
    words AS (SELECT side, a, b, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: w NOT IN
              ('a', 'an', 'and', 'at', 'for', 'in', 'is', 'it', 'of', 'on', 'the', 'to', 'we')) AS ws FROM said),
    joined AS (SELECT *, array_to_string(ws, ' ') AS j FROM words),
    feats AS (SELECT side, a, b, 'w:' || unnest(ws) AS f FROM joined UNION ALL
              SELECT side, a, b, 'c:' || substr(j, unnest(range(1, length(j) - 1)), 3) FROM joined),
    tally AS (SELECT side, a, b, f, count(*) AS n FROM feats GROUP BY ALL),
    unit AS (SELECT side, a, b, f, n / sqrt(sum(n * n) OVER (PARTITION BY side, a, b)) AS w FROM tally),
    cosine AS (SELECT m.a AS conv_id, m.b AS turn, p.a AS i, sum(m.w * p.w) AS score
                 FROM unit m JOIN unit p ON p.f = m.f AND p.side = 'p' WHERE m.side = 'm' GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY round(score, 9) DESC, i) AS k FROM cosine)
    SELECT conv_id, turn, kind AS intent, round(score, 6) AS score FROM ranked JOIN given USING (i) WHERE k = 1""")
def _(v):
    near = v.table("conversations").withColumn("near", intent.nearest_exemplar("text"))
    return rounded(near.select("conv_id", "turn", "near.intent", F.col("near.score").alias("score")).where("score > 0"))


def _classified(v):
    return intent.classify(v.messages())


# What a chat would say about an event of each type; the fifth type says nothing.
SAID = {"click": "looking at the dashboard", "view": "restarting db", "error": "rolled back", "purchase": "all green"}


@query("timeline", """
    WITH s(event_type, text, intent, sure) AS (VALUES ('click', 'looking at the dashboard', 'investigation', 0.7),
        ('view', 'restarting db', 'remediation_start', 0.95), ('error', 'rolled back', 'remediation_end', 0.9),
        ('purchase', 'all green', 'recovery_signal', 0.9))
    SELECT date_trunc('second', ts) AS time, user_id AS incident_id, intent, sure::DOUBLE AS confidence, text AS description,
           'U' || user_id AS author_user_id, CAST(floor(epoch(ts)) AS BIGINT)::VARCHAR AS source_message_ts
      FROM events JOIN s USING (event_type)""")
def _(v):
    text = F.lit("hm hm hm")
    for kind, said in SAID.items():
        text = F.when(F.col("event_type") == kind, said).otherwise(text)
    messages = v.events().select(
        F.col("user_id").alias("incident_id"), F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("user_id"),
        F.unix_seconds("ts").cast("string").alias("ts"), text.alias("text"),
    )
    return intent.timeline(intent.classify(messages))


@query("redacted_documents")
def _(v):
    texts = v.table("documents").select(
        "doc_id", F.floor(F.col("doc_id") / 2).alias("incident_id"), "text"
    )
    return privacy.redact(texts, ["doc_id"], "incident_id", ["doc_id"])[0].select(
        "doc_id", "incident_id", "redacted"
    )


@query("redaction_audit")
def _(v):
    texts = v.table("documents").select("doc_id", "text")
    return privacy.redaction_audit(privacy.pii_spans(texts, ["doc_id"], []))


@query("runbook_match", """
    WITH k AS (SELECT p_brand, min(p_partkey) AS id, min(p_name) AS low, max(p_name) AS high, max(p_size) % 4 AS size,
                      min(p_type) AS kind, count(*) AS n FROM part GROUP BY p_brand),
    b AS (SELECT id, id AS position, '(?i)' || upper(low) || '|' || split_part(high, ' ', 1) AS pat,
                 CASE WHEN n % 2 = 0 THEN 'sev' || (1 + size) END AS sev, CASE WHEN id % 3 = 0 THEN kind END AS svc FROM k),
    i AS (SELECT DISTINCT p_name AS name, 'sev' || (1 + p_partkey % 4) AS severity, lower(p_type) AS service FROM part),
    m AS (SELECT i.*, b.id, position, 1 + CASE WHEN sev IS NULL THEN 0 ELSE 1 END
                 + CASE WHEN svc IS NULL THEN 0 ELSE 2 END AS score
            FROM i JOIN b ON regexp_matches(i.name, pat) AND (sev IS NULL OR sev = severity)
             AND (svc IS NULL OR regexp_matches(service, '(?i)' || svc))),
    r AS (SELECT *, row_number() OVER (PARTITION BY name, severity, service ORDER BY score DESC, position) AS k FROM m)
    SELECT p.p_partkey AS id, r.id AS runbook_id, score, r.name AS matched_on FROM part p JOIN r
        ON k = 1 AND r.name = p_name AND r.severity = 'sev' || (1 + p_partkey % 4) AND r.service = lower(p_type)""")
def _(v):
    part = v.table("part")
    books = part.groupBy("p_brand").agg(
        F.min("p_partkey").alias("id"), F.min("p_name").alias("low"), F.max("p_name").alias("high"),
        (F.max("p_size") % 4).alias("size"), F.min("p_type").alias("kind"), F.count("*").alias("n"),
    ).select(
        "id", F.col("id").alias("position"),
        F.concat(F.upper("low"), F.lit("|"), F.split_part("high", F.lit(" "), F.lit(1))).alias("alert_pattern"),
        F.when(F.col("n") % 2 == 0, F.concat(F.lit("sev"), (1 + F.col("size")).cast("string"))).alias("severity_filter"),
        F.when(F.col("id") % 3 == 0, F.col("kind")).alias("service_filter"),
    )
    raised = part.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("root_signal"),
        F.lit(None).cast("string").alias("alertname"),
        F.concat(F.lit("sev"), (1 + F.col("p_partkey") % 4).cast("string")).alias("severity"),
        F.lower("p_type").alias("service"),
    )
    return runbooks.match_runbooks(raised, books).drop("source")


@query("step_detection", """
    WITH s AS (SELECT item_id % 4 AS runbook_id, item_id, list_distinct(list_filter(
                 regexp_extract_all(lower(text), '[a-z0-9_./:-]{3,}'), lambda w: w NOT IN ('get', 'bash', 'curl'))) AS toks
                 FROM benchmark),
    h AS (SELECT m.id, item_id, len(list_filter(toks, lambda t: contains(lower(m.text), t))) AS hits
            FROM v_messages m JOIN s ON s.runbook_id = m.incident_id % 4),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY hits DESC, item_id) AS k FROM h WHERE hits >= 2)
    SELECT id, 'item-' || item_id AS step_id, CAST(hits AS INTEGER) AS hits FROM r WHERE k = 1""")
def _(v):
    steps = v.table("benchmark").select(
        (F.col("item_id") % 4).alias("runbook_id"), F.col("item_id").alias("position"),
        F.concat(F.lit("item-"), F.col("item_id").cast("string")).alias("step_id"),
        F.concat(F.lit("```\n"), "text", F.lit("\n```")).alias("body"),
    )
    said = v.messages().withColumn("runbook_id", F.col("incident_id") % 4)
    return runbooks.detect_steps(said, steps).select("id", "step_id", "hits")


@query("transcript_trim", """
    WITH m AS (SELECT user_id AS incident_id, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a,
                      row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS z FROM events)
    SELECT incident_id, id FROM m WHERE a <= 20 OR z <= 20""")
def _(v):
    rows = v.events().select(F.col("user_id").alias("incident_id"), F.col("event_id").alias("id"), "ts")
    return grounding.trim_transcript(rows, 20, 20).drop("ts")


def _claims(v):
    """Every chat turn as a claim citing the turn before it, the first citing a message never stored."""
    turn = F.col("turn")
    return v.messages().select(
        "incident_id", F.concat(F.lit("summary["), turn.cast("string"), F.lit("]")).alias("path"), "text",
        F.array(F.struct(F.lit("message").alias("kind"), message_ref(
            (F.col("ts").cast("bigint") - 60).cast("string")).alias("ref"))).alias("citations"),
        F.when(turn % 2 == 0, F.lit("system")).alias("owner"),
    )


def _judged(v):
    none = v.messages().where(F.lit(False))
    rows = v.messages().select("incident_id", F.lit("message").alias("kind"),
                               message_ref(F.col("ts")).alias("ref"), "text")
    strong = none.select("incident_id", F.col("text").alias("term"))
    return grounding.judge_citations(_claims(v), rows, strong)


TOKENS = (
    "list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9][a-z0-9._/-]*[a-z0-9]|[a-z0-9]'), lambda w: "
    "length(w) > 2 AND w NOT IN ('the', 'a', 'an', 'and', 'or', 'of', 'to', 'in', 'on', 'at', 'for', 'was', 'were', "
    "'is', 'are', 'be', 'been', 'this', 'that', 'it', 'we', 'with', 'as', 'by', 'from', 'after', 'before', 'during', "
    "'which', 'had', 'has')))"
)
JUDGED = f"""
    WITH m AS (SELECT incident_id, turn, text, {TOKENS.format('text')} AS toks FROM v_messages),
    c AS (SELECT a.incident_id, a.turn, a.text, a.toks AS mine, b.toks AS theirs, b.turn AS prev
            FROM m a LEFT JOIN m b ON b.incident_id = a.incident_id AND b.turn = a.turn - 1),
    j AS (SELECT incident_id, turn, CASE WHEN prev IS NULL THEN 'fabricated'
             WHEN len(mine) = 0 OR len(theirs) = 0 THEN 'ok'
             WHEN len(list_intersect(mine, theirs)) / len(mine) >= 0.35 THEN 'ok' ELSE 'unsupported' END AS verdict FROM c)"""


@query("citation_verdicts", JUDGED + " SELECT verdict, count(*) AS n FROM j GROUP BY verdict")
def _(v):
    return _judged(v).groupBy("verdict").agg(F.count("*").alias("n"))


@query("grounding_coverage", JUDGED + """
    SELECT incident_id, count(*) AS checked_claims, count(*) AS checked_citations,
           round_even(count(*) FILTER (WHERE verdict = 'ok') * 1.0::DOUBLE / count(*), 3) AS coverage FROM j GROUP BY 1""")
def _(v):
    return grounding.coverage(_claims(v), _judged(v))


@query("citation_scores", JUDGED + """
    SELECT incident_id, round(count(*) FILTER (WHERE verdict = 'ok') * 1.0::DOUBLE / count(*), 6) AS citation_precision,
           CAST(0 AS BIGINT) AS uncited_claims, count(*) FILTER (WHERE verdict = 'fabricated') AS fabricated_citations
      FROM j GROUP BY 1""")
def _(v):
    return rounded(grounding.citation_scores(_claims(v), _judged(v)))


@query("never_stored_references", """
    SELECT a.incident_id, 'msg:' || (CAST(a.ts AS BIGINT) - 60) AS ref FROM v_messages a LEFT JOIN v_messages b
        ON b.incident_id = a.incident_id AND b.turn = a.turn - 1 WHERE b.turn IS NULL""")
def _(v):
    cited = _claims(v).select("incident_id", F.col("citations")[0]["ref"].alias("ref"))
    stored = v.messages().select("incident_id", message_ref(F.col("ts")).alias("ref"))
    return grounding.never_stored(cited, stored)


@query("grounding_findings")
def _(v):
    claims, talk = _claims(v), v.messages()
    nobody = talk.where(F.lit(False))
    people = grounding.participants(
        talk, nobody.select("incident_id", F.lit("").alias("author_user_id")),
        nobody.select("incident_id", F.lit("").alias("actor")),
    )
    numbers = nobody.select("incident_id", F.col("text").alias("number"))
    return grounding.findings(claims, _judged(v), people, numbers)


@query("numbers_in_documents")
def _(v):
    return v.table("documents").select("doc_id", F.explode(numbers_in(F.col("text"))).alias("number"))


@query("review_skeletons")
def _(v):
    talk = v.messages()
    ids = talk.groupBy("incident_id").agg(F.min("received_at").alias("detected_at"),
                                          F.max("received_at").alias("resolved_at"))
    text = lambda value: F.lit(value).cast("string")
    incidents = ids.select(
        "incident_id", F.concat(F.lit("inc-"), F.col("incident_id").cast("string")).alias("public_key"),
        F.lit("conversation").alias("title"), F.lit("sev3").alias("severity"), "detected_at", "resolved_at",
        text(None).alias("runbook_name"), text(None).alias("root_alertname"), text(None).alias("root_service"),
        text(None).alias("root_fingerprint"),
    )
    lines = intent.timeline_id(intent.timeline(_classified(v)))
    events = lines.groupBy("incident_id").agg(F.count("*").alias("events"))
    counts = talk.groupBy("incident_id").agg(
        F.count("*").alias("messages"), F.countDistinct("user_id").alias("participants"),
        F.lit(0).alias("alerts"), F.lit(0).alias("steps"),
    ).join(events, "incident_id", "left")
    report = ids.select(
        "incident_id", F.lit("unavailable").alias("status"), F.lit("no samples").alias("reason"),
        *[F.lit(None).cast("double").alias(n) for n in review.IMPACT_VALUES],
    )
    none = v.deploys().where(F.lit(False)).select(
        F.col("line").alias("incident_id"), "sha", F.lit("").alias("service"), "deployed_at", F.lit(1).alias("rank")
    )
    return review.assemble(review.skeleton_lines(incidents, report, lines, none, counts))


@query("timeline_f1", """
    WITH p AS (SELECT DISTINCT user_id AS id, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS b, event_type AS e FROM events WHERE value > 5),
    l AS (SELECT DISTINCT user_id AS id, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS b, event_type AS e FROM events WHERE value < 40),
    j AS (SELECT coalesce(p.id, l.id) AS id, count(p.id) AS np, count(l.id) AS nl,
                 count(*) FILTER (WHERE p.id IS NOT NULL AND l.id IS NOT NULL) AS h
            FROM p FULL JOIN l ON p.id = l.id AND p.b = l.b AND p.e = l.e GROUP BY 1)
    SELECT id, round(2.0::DOUBLE * h / (np + nl), 6) AS timeline_f1 FROM j""")
def _(v):
    rows = v.events().select(
        F.col("user_id").alias("id"), F.unix_seconds("ts").alias("t"), F.col("event_type").alias("intent"), "value"
    )
    return rounded(evaluation.timeline_f1(
        rows.where(F.col("value") > 5), rows.where(F.col("value") < 40), rows.select("id").distinct(), 86_400
    ))


def _scores(v):
    """Every review document as a scored replay, each measure from a column of its own."""
    size = F.col("generation_ms")
    flag = lambda condition: F.when(condition, 1).otherwise(0)
    return v.documents().select(
        F.col("model").alias("bucket"), F.col("human_edit_ratio").alias("timeline_f1"),
        F.coalesce("citation_coverage", F.lit(1.0)).alias("citation_precision"),
        (F.lit(1) - F.col("human_edit_ratio")).alias("action_item_recall"),
        (F.lit(1.0) - size % 5 / 10.0).alias("storm_compression"),
        flag(F.col("citation_coverage") < 1).alias("uncited_claims"), (size % 3).alias("fabricated_citations"),
        flag(F.col("prompt_version") != "2.0").alias("prompt_drift"),
        flag(F.col("generation_layer") == "skeleton").alias("unexpected_skeleton"),
        flag(size % 7 == 0).alias("network_calls"), "cost_usd", "generation_ms", F.col("generation_layer").alias("layer"),
        F.when(size % 11 == 0, "timeout").alias("error"),
    )


def _metrics_sql(bucket: str) -> str:
    """All corpus metrics as one row per bucket."""
    return f"""
    d AS (SELECT *, {bucket} AS bucket, row_number() OVER (PARTITION BY {bucket} ORDER BY generation_ms) AS k,
                 count(*) OVER (PARTITION BY {bucket}) AS size FROM v_documents),
    m AS (SELECT bucket, count(*) AS n, round_even(avg(CAST(human_edit_ratio AS DOUBLE)), 4) AS timeline_f1,
           round_even(avg(coalesce(CAST(citation_coverage AS DOUBLE), 1)), 4) AS citation_precision,
           round_even(avg(1 - CAST(human_edit_ratio AS DOUBLE)), 4) AS action_item_recall,
           round_even(avg(1 - generation_ms % 5 / 10.0::DOUBLE), 4) AS storm_compression,
           count(*) FILTER (citation_coverage < 1)::DOUBLE AS uncited_claims, sum(generation_ms % 3)::DOUBLE AS fabricated_citations,
           count(*) FILTER (prompt_version <> '2.0')::DOUBLE AS prompt_drift,
           count(*) FILTER (generation_layer = 'skeleton')::DOUBLE AS unexpected_skeleton,
           count(*) FILTER (generation_ms % 7 = 0)::DOUBLE AS network_calls,
           round_even(coalesce(avg(CAST(cost_usd AS DOUBLE)) FILTER (generation_layer <> 'skeleton'), 0), 4) AS cost_per_pir_usd,
           count(*) FILTER (generation_ms % 11 = 0)::DOUBLE AS replay_errors,
           max(generation_ms) FILTER (k = greatest(1, least(size, CAST(round_even(0.95::DOUBLE * size, 0) AS BIGINT))))::DOUBLE
               AS p95_generation_ms FROM d GROUP BY bucket)"""


@query("corpus_metrics_by_bucket", f"WITH {_metrics_sql('model')} SELECT * FROM m")
def _(v):
    return evaluation.corpus_metrics(_scores(v), "bucket")


@query("evaluation_gate", f"""
    WITH {_metrics_sql("'all'")},
    rules(metric, tier, sign, fixed, slack) AS (VALUES
        ('citation_precision', 'HARD', '=', 1.0, 0), ('uncited_claims', 'HARD', '=', 0.0, 0), ('fabricated_citations', 'HARD', '=', 0.0, 0),
        ('prompt_drift', 'HARD', '=', 0.0, 0), ('network_calls', 'HARD', '=', 0.0, 0), ('unexpected_skeleton', 'HARD', '=', 0.0, 0),
        ('replay_errors', 'HARD', '=', 0.0, 0), ('timeline_f1', 'SOFT', '>', 0.4, 0.03), ('action_item_recall', 'SOFT', '>', 0.4, 0.03),
        ('storm_compression', 'SOFT', '>', 0.95, 0), ('cost_per_pir_usd', 'BUDGET', '<', 0.5, 0), ('p95_generation_ms', 'BUDGET', '<', 30000.0, 0)),
    u AS (UNPIVOT (SELECT * EXCLUDE (bucket, n) FROM m) ON COLUMNS(*) INTO NAME metric VALUE value)
    SELECT metric, tier, value, fixed::DOUBLE AS reference,
           CASE sign WHEN '=' THEN value = fixed WHEN '>' THEN value >= fixed - slack ELSE value <= fixed END AS passed
      FROM rules JOIN u USING (metric)""")
def _(v):
    values = evaluation.metric_rows(evaluation.corpus_metrics(_scores(v)))
    baseline = values.select("metric", F.lit(0.4).alias("value"))
    return evaluation.gate(values, baseline).drop("tolerance")


@query("judge_agreement", """
    WITH d AS (SELECT quality AS h, toxic AS j FROM labels),
    t AS (SELECT count(*) AS n, avg(CASE WHEN h = j THEN 1.0 ELSE 0.0 END)::DOUBLE AS rate,
                 avg(h)::DOUBLE * avg(j)::DOUBLE + (1 - avg(h)::DOUBLE) * (1 - avg(j)::DOUBLE) AS e FROM d)
    SELECT dimension, n, round(rate, 6) AS rate, round((rate - e) / (1 - e), 6) AS kappa
      FROM t CROSS JOIN (SELECT unnest(['coherence', 'all']) AS dimension)""")
def _(v):
    pairs = v.table("labels").select(
        F.col("doc_id").alias("item"), F.lit("coherence").alias("dimension"),
        F.col("quality").alias("human"), F.col("toxic").alias("judge"),
    )
    return rounded(evaluation.agreement(pairs))


# Two labelled items a part: its name, drafted with a tail of a length of its own, and its number, never drafted.
@query("action_item_recall", """
    SELECT p_partkey AS id, CASE WHEN 2.0 * length(p_name) / (2 * length(p_name) + 1 + p_size) >= 0.6 THEN 0.5 ELSE 0.0 END
           AS action_item_recall FROM part""")
def _(v):
    part = v.table("part").select(F.col("p_partkey").alias("id"), "p_name", "p_size")
    labelled = part.select("id", F.lit(0).alias("position"), F.upper("p_name").alias("description")).unionByName(
        part.select("id", F.lit(1).alias("position"), F.col("id").cast("string").alias("description")))
    tail = F.expr("repeat('#', cast(p_size AS int))")
    drafted = part.select("id", F.concat("p_name", F.lit(" "), tail).alias("description"))
    return evaluation.action_item_recall(drafted, labelled, part)
