"""Severity assessment and escalation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.constants import FAST_BURN, SEVERITY_RANK, TIER_FLOOR
from vigilake.functions.labels import literal_map, severity_of_rank


def _rank(level: Column) -> Column:
    return literal_map(SEVERITY_RANK)[level]


def assess_severity(facts: DataFrame) -> DataFrame:
    """Adds `level`, `rank` and `reason`.

    `facts` has alert_severity, service_tier, affected_services, tier_one_services
    and burn; tier and burn may be NULL.
    """
    label = F.coalesce(_rank(F.col("alert_severity")), F.lit(SEVERITY_RANK["sev3"]))
    tier, burn = F.col("service_tier"), F.col("burn")
    floor = F.coalesce(
        literal_map({k: SEVERITY_RANK[v] for k, v in TIER_FLOOR.items()})[tier.cast("int")],
        F.lit(0),
    )
    burning = F.coalesce(burn >= FAST_BURN, F.lit(False))
    spread_one = F.coalesce("tier_one_services", F.lit(0)) >= 2
    spread_any = ~spread_one & (F.coalesce("affected_services", F.lit(1)) >= 3)
    rank = F.greatest(
        label, floor,
        F.when(burning | spread_one, SEVERITY_RANK["sev1"]).otherwise(0),
        F.when(spread_any, SEVERITY_RANK["sev2"]).otherwise(0),
    )
    said = F.concat_ws(
        " + ",
        F.concat(F.lit("alert label "), "alert_severity"),
        F.when((floor > label) | (tier == 1), F.concat(F.lit("tier-"), tier.cast("string"), F.lit(" service"))),
        F.when(burning, F.format_string("error budget burn %.1fx", burn)),
        F.when(spread_one, F.concat(F.col("tier_one_services").cast("string"), F.lit(" tier-1 services affected"))),
        F.when(spread_any, F.concat(F.col("affected_services").cast("string"), F.lit(" services affected"))),
    )
    return facts.withColumn("rank", rank).withColumn("level", severity_of_rank(F.col("rank"))).withColumn(
        "reason", F.concat(F.col("level"), F.lit(": "), said)
    )


def escalate(requests: DataFrame) -> DataFrame:
    """Adds `level` and `reason`; `requests` has current, target, actor, note. Never lowers."""
    target = F.when(_rank(F.col("target")).isNotNull(), F.col("target")).otherwise(F.col("current"))
    lower = _rank(target) < _rank(F.col("current"))
    note = F.when(
        F.coalesce("note", F.lit("")) != "", F.concat(F.lit(" ("), F.col("note"), F.lit(")"))
    ).otherwise("")
    refused = F.concat("current", F.lit(": de-escalation to "), target, F.lit(" requested by "), "actor", F.lit(" — refused"))
    raised = F.concat(target, F.lit(": escalated from "), "current", F.lit(" by "), "actor", note)
    return requests.withColumns(
        {
            "level": F.when(lower, F.col("current")).otherwise(target),
            "reason": F.when(lower, refused).otherwise(raised),
        }
    )
