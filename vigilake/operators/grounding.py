"""Is every claim of a review backed by something that was stored?"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilake.constants import CLAIM_FIELDS, SUPPORT_THRESHOLD, TRANSCRIPT_HEAD, TRANSCRIPT_TAIL
from vigilake.functions.evidence import (
    alert_ref,
    claim_tokens,
    deploy_ref,
    entities,
    is_reference,
    message_ref,
    metric_ref,
    numbers_in,
    runbook_ref,
    timeline_ref,
)
from vigilake.functions.text import number_spellings, strip

CITATIONS = "array<struct<kind:string,ref:string>>"


CLAIM = (
    f"array<struct<field:int,position:int,path:string,text:string,citations:{CITATIONS},"
    "owner:string,priority:string,category:string,at:string>>"
)


def _claims_of(name: str, order: int):
    """The claims of one draft field as an array in the common shape."""
    field, single = F.col("draft")[name], name == "root_cause_hypothesis"
    items = F.when(field.isNotNull(), F.array(field)) if single else field
    nothing = F.lit(None).cast("string")
    acted, timed = name == "action_items", name == "timeline"

    def shaped(claim, i):
        path = F.lit(name) if single else F.concat(F.lit(name + "["), i.cast("string"), F.lit("]"))
        details = [claim[c] if acted else nothing for c in ("owner", "priority", "category")]
        return F.struct(
            F.lit(order).alias("field"), i.alias("position"), path.alias("path"),
            claim["description" if acted or timed else "text"].alias("text"),
            claim["citations"].alias("citations"), details[0].alias("owner"),
            details[1].alias("priority"), details[2].alias("category"),
            (claim["at"] if timed else nothing).alias("at"),
        )

    return F.coalesce(F.transform(items, shaped).cast(CLAIM), F.array().cast(CLAIM))


def walk_claims(drafts: DataFrame, key: str = "incident_id") -> DataFrame:
    """One row per claim of the struct column `draft`: key, field, position, path, text, citations, owner.

    The seven fields are laid end to end as one array and exploded once.
    """
    parts = [_claims_of(name, order) for order, name in enumerate(CLAIM_FIELDS)]
    walked = drafts.select(key, F.explode_outer(F.concat(*parts)).alias("c"))
    return walked.where(F.col("c").isNotNull()).select(key, "c.*")


def trim_transcript(
    messages: DataFrame, head: int = TRANSCRIPT_HEAD, tail: int = TRANSCRIPT_TAIL
) -> DataFrame:
    """The first and last messages of each incident; shorter transcripts stay whole.

    Both ends are ranked with a per-partition limit before the shuffle, and a
    transcript of at most head + tail rows is covered by the two ends together.
    """
    def end(order, limit):
        ranked = Window.partitionBy("incident_id").orderBy(*order)
        return messages.withColumn("_rank", F.row_number().over(ranked)).where(
            F.col("_rank") <= limit
        ).drop("_rank")

    first = end([F.asc("ts"), F.asc("id")], head)
    last = end([F.desc("ts"), F.desc("id")], tail)
    return first.unionByName(last).dropDuplicates(["incident_id", "id"])


def evidence(
    messages: DataFrame, timeline: DataFrame, alerts: DataFrame, deploys: DataFrame,
    steps: DataFrame, windows: DataFrame,
) -> DataFrame:
    """(incident_id, kind, ref, text): everything a claim may cite, one row per reference.

    `timeline` has timeline_id, `steps` has runbook_name, `windows` is the
    output of the impact report's windows.
    """
    blank = lambda name: F.coalesce(F.col(name), F.lit(""))
    one = lambda rows, kind, ref, text, order: rows.select(
        "incident_id", F.lit(kind).alias("kind"), ref.alias("ref"), text.alias("text"),
        order.cast("string").alias("_order"),
    )
    word = lambda *parts: F.concat_ws(" ", *parts)
    rows = [
        one(messages, "message", message_ref(F.col("ts")), blank("text"), F.col("ts")),
        one(timeline, "timeline", timeline_ref(F.col("timeline_id")),
            word("intent", "description"), F.col("time")),
        one(alerts, "alert", alert_ref(F.col("fingerprint")),
            word("alertname", blank("service")), F.col("starts_at")),
        one(deploys, "deploy", deploy_ref(F.col("sha")),
            word(F.lit("deploy"), "sha", "service", blank("title")),
            F.lpad((F.lit(10**12) - F.unix_seconds("deployed_at")).cast("string"), 14, "0")),
        one(steps, "runbook", runbook_ref(F.col("runbook_id"), F.col("step_id")),
            word(F.coalesce("runbook_name", F.lit("runbook")), "step_id"), F.col("step_id")),
        one(windows, "metric", metric_ref(F.col("query"), F.col("start_at"), F.col("end_at")),
            word("key", "query", F.coalesce(F.col("value").cast("string"), F.lit("None"))),
            F.col("key")),
    ]
    every = rows[0]
    for other in rows[1:]:
        every = every.unionByName(other)
    return every.where(F.col("ref").isNotNull()).groupBy("incident_id", "kind", "ref").agg(
        F.min_by("text", "_order").alias("text")
    )


def participants(messages: DataFrame, timeline: DataFrame, deploys: DataFrame) -> DataFrame:
    """Everyone who spoke, wrote a timeline entry or shipped around an incident."""
    who = lambda rows, name: rows.select("incident_id", F.col(name).alias("user"))
    every = who(messages, "user_id").union(who(timeline, "author_user_id")).union(
        who(deploys, "actor")
    )
    return every.where(F.coalesce("user", F.lit("")) != "").distinct()


def strong_terms(
    incidents: DataFrame, alerts: DataFrame, deploys: DataFrame, steps: DataFrame
) -> DataFrame:
    """Names that tie a claim to its source on their own: alerts, services, steps, runbook."""
    term = lambda rows, name, key="incident_id": rows.select(
        F.col(key).alias("incident_id"), F.lower(F.col(name)).alias("term")
    )
    every = (
        term(alerts, "alertname").union(term(alerts, "service")).union(term(deploys, "service"))
        .union(term(steps, "step_id")).union(term(incidents, "service", "id"))
        .union(term(incidents, "runbook_name", "id"))
    )
    return every.where(F.length("term") > 2).distinct()


def impact_numbers(report: DataFrame, values: list[str]) -> DataFrame:
    """(incident_id, number): the spellings of each computed figure."""
    figures = F.array_compact(F.array(*[F.col(v).cast("double") for v in values]))
    flat = report.select("incident_id", F.explode(figures).alias("v"))
    return flat.select("incident_id", F.explode(number_spellings("v")).alias("number")).distinct()


def judge_citations(claims: DataFrame, evidence_rows: DataFrame, strong: DataFrame) -> DataFrame:
    """One row per citation with its `verdict`: ok, malformed, fabricated or unsupported."""
    ids = ["incident_id", "path", "cite"]
    cited = claims.select(
        "incident_id", "path", "text", F.posexplode("citations").alias("cite", "c")
    ).select(*ids, "text", F.col("c.kind").alias("cited_as"), strip(F.col("c.ref")).alias("ref"))
    sources = evidence_rows.select("incident_id", "ref", F.col("text").alias("source"))
    known = cited.join(sources, ["incident_id", "ref"], "left")
    mine, theirs = claim_tokens(F.col("text")), claim_tokens(F.col("source"))
    facts = known.withColumns({"_mine": mine, "_theirs": theirs}).withColumn(
        "_shared", F.array_intersect("_mine", "_theirs")
    )
    silent = (F.size("_mine") == 0) | (F.size("_theirs") == 0)
    close = F.size("_shared") / F.nullif(F.size("_mine"), F.lit(0)) >= SUPPORT_THRESHOLD
    named = F.arrays_overlap(entities(F.col("text")), entities(F.col("source")))
    tested = facts.withColumn("_backed", F.coalesce(silent | close | named, F.lit(False)))
    weak = tested.where(F.col("source").isNotNull() & ~F.col("_backed")).select(
        *ids, F.explode("_shared").alias("term")
    )
    rescued = weak.join(strong, ["incident_id", "term"], "left_semi").select(*ids).distinct()
    judged = tested.join(rescued.withColumn("_rescued", F.lit(True)), ids, "left")
    verdict = (
        F.when(~is_reference(F.col("ref")), "malformed_reference")
        .when(F.col("source").isNull(), "fabricated")
        .when(F.col("_backed") | F.col("_rescued"), "ok")
        .otherwise("unsupported")
    )
    return judged.select(*ids, "cited_as", "ref", verdict.alias("verdict"))


def findings(
    claims: DataFrame, citations: DataFrame, people: DataFrame, numbers: DataFrame
) -> DataFrame:
    """Every broken grounding rule: (incident_id, path, reason, detail)."""
    row = lambda rows, reason, detail: rows.select(
        "incident_id", "path", reason.alias("reason"), detail.alias("detail")
    )
    bare = claims.where(F.coalesce(F.size("citations"), F.lit(0)) < 1)
    bad = citations.where(F.col("verdict") != "ok")
    why = (
        F.when(F.col("verdict") == "malformed_reference",
               F.concat(F.lit("not a reference id: '"), "ref", F.lit("'")))
        .when(F.col("verdict") == "fabricated",
              F.concat("cited_as", F.lit(":"), "ref", F.lit(" was never stored")))
        .otherwise(F.concat("ref", F.lit(" does not support the claim text")))
    )
    owned = claims.where(F.coalesce("owner", F.lit("")) != "")
    strangers = owned.join(
        people.select("incident_id", F.col("user").alias("owner")), ["incident_id", "owner"], "left_anti"
    )
    said = claims.select("incident_id", "path", F.explode(numbers_in(F.col("text"))).alias("number"))
    loose = said.join(numbers, ["incident_id", "number"], "left_anti")
    return (
        row(bare, F.lit("uncited"), F.lit("claim has no citations"))
        .unionByName(row(bad, F.col("verdict"), why))
        .unionByName(row(strangers, F.lit("non_participant"),
                         F.concat("owner", F.lit(" did not take part in this incident"))))
        .unionByName(row(loose, F.lit("ungrounded_number"),
                         F.concat("number", F.lit(" was not computed from metrics"))))
    )


def coverage(claims: DataFrame, citations: DataFrame) -> DataFrame:
    """Per incident: claims, citations and the share of claims whose every citation holds."""
    per_claim = citations.groupBy("incident_id", "path").agg(
        F.count("*").alias("_n"), F.count_if(F.col("verdict") != "ok").alias("_bad")
    )
    return (
        claims.select("incident_id", "path").join(per_claim, ["incident_id", "path"], "left")
        .groupBy("incident_id")
        .agg(
            F.count("*").alias("checked_claims"),
            F.coalesce(F.sum("_n"), F.lit(0)).alias("checked_citations"),
            F.bround(F.count_if(F.col("_bad") == 0) / F.count("*"), 3).alias("coverage"),
        )
    )


def citation_scores(claims: DataFrame, citations: DataFrame) -> DataFrame:
    """Per incident: citation precision, uncited claims, citations never stored."""
    judged = citations.groupBy("incident_id").agg(
        F.count("*").alias("_all"), F.count_if(F.col("verdict") == "ok").alias("_ok"),
        F.count_if(F.col("verdict").isin("fabricated", "malformed_reference")).alias("_fake"),
    )
    bare = claims.groupBy("incident_id").agg(
        F.count_if(F.coalesce(F.size("citations"), F.lit(0)) < 1).alias("uncited_claims")
    )
    return bare.join(judged, "incident_id", "left").select(
        "incident_id", F.coalesce(F.col("_ok") / F.col("_all"), F.lit(1.0)).alias("citation_precision"),
        "uncited_claims", F.coalesce("_fake", F.lit(0)).alias("fabricated_citations"),
    )


def never_stored(cited: DataFrame, evidence_rows: DataFrame) -> DataFrame:
    """Cited (incident_id, ref) that no evidence row carries."""
    return cited.select("incident_id", "ref").distinct().join(
        evidence_rows.select("incident_id", "ref"), ["incident_id", "ref"], "left_anti"
    )
