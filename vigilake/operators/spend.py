"""Model spend: estimates and budget breaches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.constants import BUDGET_LIMITS
from vigilake.functions.labels import literal_map


def estimated_cost(
    input_tokens: Column, output_tokens: Column, input_rate: Column, output_rate: Column
) -> Column:
    """USD from token counts and rates per million tokens."""
    return (input_tokens * input_rate + output_tokens * output_rate) / 1_000_000


def spend_by_scope(calls: DataFrame, limits: dict[str, float] = BUDGET_LIMITS) -> DataFrame:
    """Spend per incident, day and month in one pass, with a flag where a limit is reached."""
    spent = calls.where(F.col("cost_usd") > 0).select(
        F.col("incident_id").cast("string").alias("incident"),
        F.date_format("time", "yyyy-MM-dd").alias("day"),
        F.date_format("time", "yyyy-MM").alias("month"), "cost_usd",
    )
    scopes = ["incident", "day", "month"]
    sums = spent.groupingSets([[F.col(s)] for s in scopes], *scopes).agg(
        F.sum("cost_usd").alias("spent"),
        *[F.grouping(s).alias(f"_{s}") for s in scopes],
    )
    scope = F.when(F.col("_incident") == 0, "incident").when(F.col("_day") == 0, "day").otherwise("month")
    limit = literal_map({k: float(v) for k, v in limits.items()})[F.col("scope")]
    return sums.withColumn("scope", scope).select(
        "scope",
        F.when(F.col("scope") == "incident", F.col("incident"))
        .when(F.col("scope") == "day", F.col("day")).otherwise(F.col("month")).alias("key"),
        F.col("spent").cast("double").alias("spent"), limit.alias("limit_usd"),
        ((limit > 0) & (F.col("spent").cast("double") >= limit)).alias("breached"),
    )
