"""What shipped around an incident."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilake.constants import DEPLOY_LOOKBACK_H, DEPLOY_TRAILING_MIN, DEPLOYS_PER_INCIDENT
from vigilake.functions.skew import time_cell, with_running
from vigilake.functions.times import interval
from vigilake.session import cut_lineage

HOUR = 3600
MOST_CELLS = 50_000


def evidence_window(incidents: DataFrame) -> DataFrame:
    """Adds `from_at` and `to_at`: six hours back to 30 minutes after resolution."""
    return incidents.withColumns(
        {
            "from_at": F.col("detected_at") - interval(DEPLOY_LOOKBACK_H, "HOUR"),
            "to_at": F.coalesce(
                F.col("resolved_at") + interval(DEPLOY_TRAILING_MIN, "MINUTE"),
                F.col("detected_at") + interval(DEPLOY_LOOKBACK_H, "HOUR"),
            ),
        }
    )


def deploys_near(
    incidents: DataFrame, deploys: DataFrame, newest: int = DEPLOYS_PER_INCIDENT
) -> DataFrame:
    """The newest deploys inside each incident's evidence window.

    `incidents` has id, service (NULL matches every service), detected_at and
    resolved_at. Deploys of a service are numbered by time (of an exact instant only the
    first `newest`, no window wants others) and a window learns the last number before its
    end. Numbers are shelved in blocks of `newest`, each with the block before: a window is
    one row and meets one shelf, however long it is and whenever deploys happened.
    """
    windows = evidence_window(incidents.select("id", "service", "detected_at", "resolved_at")).where(
        F.col("from_at") <= F.col("to_at"))
    shipped = deploys.where(F.col("deployed_at").isNotNull()).withColumn("_us", F.unix_micros("deployed_at"))
    owned = _newest_in(windows.where(F.col("service").isNotNull()), shipped.where(F.col("service").isNotNull()), ["service"], newest)
    unowned = _newest_in(windows.where(F.col("service").isNull()), shipped, [], newest)
    found = owned.unionByName(unowned).select("incident_id", *deploys.columns)
    by_age = Window.partitionBy("incident_id").orderBy(F.desc("deployed_at"), "sha")
    return found.withColumn("rank", F.row_number().over(by_age)).where(F.col("rank") <= newest)


def _newest_in(windows: DataFrame, shipped: DataFrame, keys: list[str], newest: int) -> DataFrame:
    """`incident_id` and the columns of the newest deploys in each window under equal `keys`."""
    instant = Window.partitionBy(*keys, "_us").orderBy("sha")
    kept = shipped.withColumn("_at", F.row_number().over(instant)).where(F.col("_at") <= newest).drop("_at")
    hour = time_cell(F.col("deployed_at"), HOUR)
    numbered = cut_lineage(with_running(kept, keys, hour, ["_us", F.desc("sha")], F.lit(1), "_number"))
    span = numbered.agg(F.min("_us").alias("first"), F.max("_us").alias("last")).first()
    if span["last"] is None:
        return numbered.withColumn("incident_id", F.lit(None).cast(windows.schema["id"].dataType)).drop("_number")
    # cells of an hour, longer ones where stray time stamps stretch the history
    width = max(HOUR * 1_000_000, -(-(span["last"] - span["first"]) // MOST_CELLS))
    cell = F.floor((F.col("_us") - span["first"]) / width).alias("_cell")
    marks = numbered.groupBy(*keys, cell, "_us").agg(F.max("_number").alias("_top"))
    ends = marks.groupBy(*keys, "_cell").agg(F.max("_top").alias("_top"))
    until = F.lead("_cell", 1, math.floor((span["last"] - span["first"]) / width) + 1).over(
        Window.partitionBy(*keys).orderBy("_cell"))
    # a cell starts with the last number of the cells before it
    carried = ends.withColumn("_next", until).withColumn(
        "_cell", F.explode(F.sequence(F.col("_cell") + 1, F.col("_next")))).drop("_next")
    asked = windows.select(
        *keys, F.col("id").alias("incident_id"), F.col("from_at").alias("_from"),
        F.least(F.unix_micros("to_at"), F.lit(span["last"])).alias("_us"),
    ).select("*", cell, F.lit(True).alias("_asks"))
    so_far = Window.partitionBy(*keys, "_cell").orderBy("_us", F.col("_asks").asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    met = (
        marks.unionByName(carried, allowMissingColumns=True).unionByName(asked, allowMissingColumns=True)
        .withColumn("_top", F.max("_top").over(so_far)).where(F.col("_asks") & F.col("_top").isNotNull())
        .select(*keys, "incident_id", "_from", "_top", F.floor((F.col("_top") - 1) / newest).alias("_block"))
    )
    block = F.floor((F.col("_number") - 1) / newest)
    shelf = numbered.withColumn("_block", F.explode(F.array(block, block + 1)))
    return met.join(shelf, [*keys, "_block"]).where(
        (F.col("_number") <= F.col("_top")) & (F.col("_number") > F.col("_top") - newest)
        & (F.col("deployed_at") >= F.col("_from")))


def last_deploy_before(incidents: DataFrame, deploys: DataFrame) -> DataFrame:
    """The single newest deploy of the incident's window that precedes detection."""
    until = incidents.withColumn(
        "resolved_at", F.col("detected_at") - interval(DEPLOY_TRAILING_MIN, "MINUTE")
    )
    return deploys_near(until, deploys, newest=1).drop("rank")
