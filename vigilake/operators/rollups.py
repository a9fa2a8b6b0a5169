"""Daily rollups and their refresh."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.functions.times import as_of_literal, interval



def _day(column: str = "time"):
    return F.date_trunc("day", column).alias("day")


def incident_daily(timeline: DataFrame) -> DataFrame:
    """Events and distinct incidents per day and intent."""
    per_incident = timeline.groupBy(_day(), "intent", "incident_id").agg(F.count("*").alias("n"))
    return per_incident.groupBy("day", "intent").agg(
        F.sum("n").alias("events"), F.count("incident_id").alias("incidents")
    )


def llm_cost_daily(calls: DataFrame) -> DataFrame:
    return calls.groupBy(_day(), "role", "model", "prompt_version").agg(
        F.sum("cost_usd").alias("cost"), F.count("*").alias("calls"),
        F.avg("latency_ms").alias("avg_ms"),
    )


def page_load_daily(pages: DataFrame) -> DataFrame:
    return pages.groupBy(_day(), "responder").agg(
        F.count("*").alias("pages"), F.count_if(F.col("severity") == "sev1").alias("sev1_pages")
    )


def llm_latency_daily(calls: DataFrame) -> DataFrame:
    """Mergeable latency sketch per day, role and model."""
    return calls.groupBy(_day(), "role", "model").agg(
        F.kll_sketch_agg_double(F.col("latency_ms").cast("double")).alias("latency_sketch"),
        F.count("latency_ms").alias("calls"),
    )


def latency_quantile(rollup: DataFrame, keys: list[str], q: float) -> DataFrame:
    """A latency quantile over any coarser grouping of the stored sketches."""
    return rollup.groupBy(*keys).agg(
        F.kll_merge_agg_double("latency_sketch").alias("_sketch")
    ).select(*keys, F.kll_sketch_get_quantile_double("_sketch", F.lit(q)).alias("latency_ms"))


def refresh_range(rows: DataFrame, as_of, days: int, time: str = "time") -> DataFrame:
    """Source rows of the whole days between `as_of - days` and one hour ago."""
    now = as_of_literal(as_of)
    floor = F.date_trunc("day", now - interval(days, "DAY"))
    start = F.when(floor == now - interval(days, "DAY"), floor).otherwise(
        floor + interval(1, "DAY")
    )
    end = F.date_trunc("day", now - interval(1, "HOUR"))
    return rows.where((F.col(time) >= start) & (F.col(time) < end))


def refresh(
    build: Callable[[DataFrame], DataFrame], source: DataFrame, target: str, as_of, days: int
) -> None:
    """Recomputes the refresh range and replaces exactly the day partitions it produced."""
    fresh = build(refresh_range(source, as_of, days)).withColumn("day", F.to_date("day"))
    (
        fresh.repartition("day").write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(target)
    )
