"""Similar past incidents by embedding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def probe_vector(incidents: DataFrame, incident_id: int) -> DataFrame:
    """One row, always: the probe's embedding scaled to length one, NULL when it has none."""
    probe = incidents.where(F.col("id") == incident_id).agg(F.first("embedding").alias("v"))
    length = probe.withColumn("length", F.nullif(F.sqrt(dot(F.col("v"), F.col("v"))), F.lit(0.0)))
    return length.select(F.transform("v", lambda x: x / F.col("length")).alias("probe"))


def repeat_incidents(
    incidents: DataFrame, action_items: DataFrame, incident_id: int,
    threshold: float = 0.85, limit: int = 5,
) -> DataFrame:
    """Nearest other incidents above a similarity, with their open action items.

    The probe reaches every row as a scalar subquery, the scan keeps a top-k
    per partition, and action items are counted for the winners only.
    """
    probe = probe_vector(incidents, incident_id).scalar()
    nearest = (
        incidents.where((F.col("id") != incident_id) & F.col("embedding").isNotNull())
        .withColumn("_probe", probe)
        .withColumn("_length", F.nullif(F.sqrt(dot(F.col("embedding"), F.col("embedding"))), F.lit(0.0)))
        .withColumn("similarity", dot(F.col("embedding"), F.col("_probe")) / F.col("_length"))
        .where(F.col("similarity") > threshold)
        .select("id", "public_key", "title", "detected_at", "similarity")
        .orderBy(F.desc("similarity"))
        .limit(limit)
    )
    opened = (
        action_items.where(F.col("status") == "open")
        .join(nearest.select(F.col("id").alias("incident_id")), "incident_id", "left_semi")
        .groupBy(F.col("incident_id").alias("id"))
        .agg(F.count("*").alias("open_action_items"))
    )
    return (
        nearest.join(opened, "id", "left")
        .select(
            "public_key", "title", "detected_at", "similarity",
            F.coalesce("open_action_items", F.lit(0)).alias("open_action_items"),
        )
        .orderBy(F.desc("similarity"))
    )
