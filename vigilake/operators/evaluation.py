"""Scores of recorded incidents against their labels, and the gate over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.constants import (
    ACTION_MATCH_THRESHOLD,
    GATE_RULES,
    TIMELINE_BUCKET_S,
)
from vigilake.functions.skew import nearest_rank
from vigilake.functions.text import ratio_at_least


def timeline_f1(predicted: DataFrame, labelled: DataFrame, ids: DataFrame,
                bucket_s: int = TIMELINE_BUCKET_S) -> DataFrame:
    """F1 over distinct (time bucket, intent) pairs per recording.

    `predicted` and `labelled` have id, t, intent; `ids` lists every recording.
    Two empty timelines agree.
    """
    def pairs(rows, name):
        return rows.select("id", F.floor(F.col("t") / bucket_s).alias("b"), "intent").distinct().withColumn(
            name, F.lit(1)
        )

    both = pairs(predicted, "p").join(pairs(labelled, "l"), ["id", "b", "intent"], "full")
    counts = both.groupBy("id").agg(
        F.count("p").alias("p"), F.count("l").alias("l"),
        F.count_if(F.col("p").isNotNull() & F.col("l").isNotNull()).alias("hits"),
    )
    f1 = F.when(F.col("p").isNull(), 1.0).otherwise(2 * F.col("hits") / (F.col("p") + F.col("l")))
    return ids.select("id").join(counts, "id", "left").select("id", f1.alias("timeline_f1"))


def action_item_recall(drafted: DataFrame, labelled: DataFrame, ids: DataFrame,
                       threshold: float = ACTION_MATCH_THRESHOLD) -> DataFrame:
    """Share of labelled action items some drafted item resembles; no labels count as full.

    Both inputs have id and description; items only meet inside one recording, and are
    compared in full only where their lengths and characters allow the threshold.
    """
    truth = labelled.select("id", F.col("description").alias("wanted"), F.col("position"))
    close = truth.join(drafted.select("id", "description"), "id").where(
        ratio_at_least(F.col("wanted"), F.col("description"), threshold))
    found = close.select("id", "position").distinct().withColumn("found", F.lit(True))
    per = truth.join(found, ["id", "position"], "left").groupBy("id").agg(
        (F.count("found") / F.count("*")).alias("recall")
    )
    return ids.select("id").join(per, "id", "left").select(
        "id", F.coalesce("recall", F.lit(1.0)).alias("action_item_recall")
    )


def storm_score(created: Column, expected: Column) -> Column:
    """One when as many incidents were made as expected, falling with the relative error."""
    return F.greatest(
        F.lit(0.0), F.lit(1.0) - F.abs(created - expected) / F.greatest(expected, F.lit(1))
    )


MEANS = ("timeline_f1", "citation_precision", "action_item_recall", "storm_compression")
TOTALS = (
    "uncited_claims", "fabricated_citations", "prompt_drift", "unexpected_skeleton", "network_calls",
)


def corpus_metrics(scores: DataFrame, by: str | None = None) -> DataFrame:
    """The twelve corpus metrics, overall or per value of `by` with the group size `n`.

    Skeletons are left out of the mean cost; the tail latency is the nearest rank.
    """
    keys = [by] if by else []
    frame = scores if by else scores.withColumn("_all", F.lit(1))
    keys = keys or ["_all"]
    mean = lambda c: F.bround(F.avg(F.col(c).cast("double")), 4).alias(c)
    drafted = F.when(F.col("layer") != "skeleton", F.col("cost_usd").cast("double"))
    base = frame.groupBy(*keys).agg(
        F.count("*").alias("n"), *[mean(c) for c in MEANS],
        *[F.sum(c).cast("double").alias(c) for c in TOTALS],
        F.bround(F.coalesce(F.avg(drafted), F.lit(0.0)), 4).alias("cost_per_pir_usd"),
        F.count_if(F.col("error").isNotNull()).cast("double").alias("replay_errors"),
    )
    tail = nearest_rank(frame, keys, "generation_ms", 0.95, "p95_generation_ms")
    joined = base.join(tail, keys, "left").withColumn(
        "p95_generation_ms", F.coalesce("p95_generation_ms", F.lit(0.0))
    )
    return joined if by else joined.drop("_all")


def metric_rows(metrics: DataFrame) -> DataFrame:
    """The one-row metric table as (metric, value)."""
    names = [r[0] for r in GATE_RULES]
    pairs = F.array(
        *[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names]
    )
    return metrics.select(F.explode(pairs).alias("p")).select("p.*")


def gate(values: DataFrame, baseline: DataFrame) -> DataFrame:
    """One row per rule with `passed`; both inputs have metric and value.

    A metric without a value counts as zero, as does a missing baseline.
    """
    spark = values.sparkSession
    rules = spark.createDataFrame(
        GATE_RULES, "metric STRING, tier STRING, op STRING, fixed DOUBLE, tolerance DOUBLE"
    )
    known = baseline.select("metric", F.col("value").alias("_base"))
    reference = F.coalesce("fixed", "_base", F.lit(0.0))
    value = F.coalesce("value", F.lit(0.0))
    passed = (
        F.when(F.col("op") == "==", F.abs(value - F.col("reference")) < 1e-9)
        .when(F.col("op") == ">=", value >= F.col("reference") - F.col("tolerance"))
        .otherwise(value <= F.col("reference"))
    )
    return (
        rules.join(values, "metric", "left").join(known, "metric", "left")
        .withColumn("reference", reference)
        .select("metric", "tier", value.alias("value"), "reference", "tolerance", passed.alias("passed"))
    )


def gate_summary(checks: DataFrame) -> DataFrame:
    return checks.agg(
        F.count_if("passed").alias("good"), F.count("*").alias("checks"),
        F.every("passed").alias("passed"),
    )


def agreement(pairs: DataFrame) -> DataFrame:
    """Agreement rate and Cohen's kappa per dimension and over all pairs.

    `pairs` has item, dimension, human, judge. Identical constant raters give 1.
    The overall row counts items, its rate and kappa use every pair.
    """
    rated = pairs.where(F.col("human").isNotNull() & F.col("judge").isNotNull())
    both = rated.unionByName(rated.withColumn("dimension", F.lit("all")))
    cells = both.groupBy("dimension", "human", "judge").agg(F.count("*").alias("n"))
    total = cells.groupBy("dimension").agg(
        F.sum("n").alias("pairs"), F.sum(F.when(F.col("human") == F.col("judge"), F.col("n"))).alias("same")
    )
    side = lambda who: cells.groupBy("dimension", F.col(who).alias("label")).agg(
        F.sum("n").alias(who + "_n")
    )
    chance = side("human").join(side("judge"), ["dimension", "label"]).groupBy("dimension").agg(
        F.sum(F.col("human_n").cast("double") * F.col("judge_n")).alias("chance")
    )
    observed = F.coalesce("same", F.lit(0)) / F.col("pairs")
    expected = F.coalesce("chance", F.lit(0.0)) / (F.col("pairs").cast("double") * F.col("pairs"))
    kappa = F.when(
        F.abs(1 - F.col("expected")) < 1e-12, F.when(F.abs(F.col("rate") - 1) < 1e-12, 1.0).otherwise(0.0)
    ).otherwise((F.col("rate") - F.col("expected")) / (1 - F.col("expected")))
    items = pairs.agg(F.countDistinct("item").alias("_items")).withColumn("dimension", F.lit("all"))
    return (
        total.join(chance, "dimension", "left")
        .select("dimension", "pairs", observed.alias("rate"), expected.alias("expected"))
        .join(items, "dimension", "left")
        .select("dimension", F.coalesce("_items", "pairs").alias("n"), "rate", kappa.alias("kappa"))
    )


