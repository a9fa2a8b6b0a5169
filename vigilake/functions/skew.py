"""Ordered computations inside a key that may hold a large share of all rows.

A window partitioned by the key alone sends a hot key to one task. Here the
key is cut into cells of its ordering column first: each cell is one window
partition, and only one summary row per cell meets its neighbours under the
key. The number of cells of a key is bounded by the time it spans, whatever the
number of rows in it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def time_cell(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_seconds(ts) / F.lit(seconds))


def with_previous(
    df: DataFrame, keys: Sequence[str], cell: Column, order: Sequence[str],
    carry: Sequence[str], name: str = "prev",
) -> DataFrame:
    """Adds struct `name` holding `carry` of the row before this one under `keys`."""
    order_key = F.struct(*order)
    celled = df.withColumn("_cell", cell).withColumn("_carry", F.struct(*carry))
    tails = celled.groupBy(*keys, "_cell").agg(F.max_by("_carry", order_key).alias("_tail"))
    before = tails.select(
        *keys, "_cell",
        F.lag("_tail").over(Window.partitionBy(*keys).orderBy("_cell")).alias("_before"),
    )
    inside = Window.partitionBy(*keys, "_cell").orderBy(*order)
    return (
        celled.withColumn("_lag", F.lag("_carry").over(inside))
        .join(before, [*keys, "_cell"], "left")
        .withColumn(name, F.coalesce("_lag", "_before"))
        .drop("_cell", "_carry", "_lag", "_before")
    )


def with_running(
    df: DataFrame, keys: Sequence[str], cell: Column, order: Sequence[str],
    value: Column, name: str, before: bool = False, how: str = "sum",
) -> DataFrame:
    """Adds the running sum (or max) of `value` under `keys`; `lit(1)` gives a row number.

    With `before` the row itself is left out, so the first row gets 0 (or NULL).
    """
    fold = {"sum": F.sum, "max": F.max}[how]
    celled = df.withColumn("_cell", cell).withColumn("_value", value)
    totals = celled.groupBy(*keys, "_cell").agg(fold("_value").alias("_total"))
    first = Window.unboundedPreceding
    earlier = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(first, -1)
    offsets = totals.select(*keys, "_cell", fold("_total").over(earlier).alias("_offset"))
    inside = (
        Window.partitionBy(*keys, "_cell").orderBy(*order)
        .rowsBetween(first, -1 if before else Window.currentRow)
    )
    joined = celled.withColumn("_inside", fold("_value").over(inside)).join(
        offsets, [*keys, "_cell"], "left"
    )
    if how == "sum":
        total = F.coalesce("_offset", F.lit(0)) + F.coalesce("_inside", F.lit(0))
    else:
        total = F.greatest("_offset", "_inside")
    return joined.withColumn(name, total).drop("_cell", "_value", "_inside", "_offset")


def exact_percentile(
    df: DataFrame, keys: Sequence[str], value: str, p: float, name: str, accuracy: int = 10_000
) -> DataFrame:
    """Interpolated percentile of `value` per key without gathering a key's values.

    `percentile` keeps every distinct value of a group in one reducer, which is
    fine for whole seconds and not for microsecond durations. A quantile sketch
    brackets the answer, everything below the bracket is only counted, and the
    few values inside it are ranked exactly. Groups small enough for the sketch
    to be coarser than a handful of ranks use their whole range as the bracket.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    slack = 3.0 / accuracy
    low_p, high_p = max(0.0, p - slack), min(1.0, p + slack)
    sketch = F.percentile_approx("_v", [low_p, high_p], accuracy)
    small = F.col("_n") * slack < 10
    bracket = (
        rows.groupBy(*keys)
        .agg(F.count("_v").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
             sketch.alias("_q"))
        .select(
            *keys, "_n",
            F.when(small, F.col("_min")).otherwise(F.col("_q")[0]).alias("_lo"),
            F.when(small, F.col("_max")).otherwise(F.col("_q")[1]).alias("_hi"),
        )
    )
    # everything below the bracket shares one NULL value, which sorts first
    counts = (
        rows.join(bracket, list(keys)).where(F.col("_v") <= F.col("_hi"))
        .groupBy(*keys, "_n", F.when(F.col("_v") >= F.col("_lo"), F.col("_v")).alias("_v"))
        .agg(F.count("*").alias("_c"))
    )
    up_to = (
        Window.partitionBy(*keys).orderBy(F.asc_nulls_first("_v"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranked = counts.withColumn("_end", F.sum("_c").over(up_to)).withColumn(
        "_pos", F.lit(p) * (F.col("_n") - 1)
    )
    at_or_after = lambda rank: F.min(F.when(F.col("_end") > rank, F.col("_v")))
    low, high = at_or_after(F.floor("_pos")), at_or_after(F.ceil("_pos"))
    return (
        ranked.groupBy(*keys)
        .agg(low.alias("_a"), high.alias("_b"), F.first("_pos").alias("_pos"))
        .select(
            *keys,
            (F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_pos") - F.floor("_pos")))
            .alias(name),
        )
    )


def nearest_rank(
    df: DataFrame, keys: Sequence[str], value: str, p: float, name: str
) -> DataFrame:
    """Value at index `round_half_even(p*n) - 1` of the sorted values, clamped to the ends.

    Ranks distinct values with their counts, so a group costs its distinct values.
    """
    if not keys:
        return nearest_rank(df.withColumn("_all", F.lit(1)), ["_all"], value, p, name).drop("_all")
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("_v"))
        .agg(F.count("*").alias("_c"))
    )
    whole = Window.partitionBy(*keys)
    up_to = whole.orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumn("_end", F.sum("_c").over(up_to))
    sizes = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    index = F.greatest(F.lit(1), F.least(F.col("_n"), F.bround(F.lit(p) * F.col("_n"))))
    return (
        ranked.join(sizes, list(keys))
        .where(F.col("_end") >= index)
        .groupBy(*keys)
        .agg(F.min("_v").cast("double").alias(name))
    )


def blocks_between(rows: DataFrame, at: Sequence[str], member: str, group: str, block_rows: int) -> DataFrame:
    """`at`, `lo`, `hi`, `member`: members of different groups under `at` meet in some (lo, hi).

    Members are put into blocks of about `block_rows`: a group beyond that has blocks of its
    own, small ones share some. Every pair of blocks is one unit of work, except pairs of one
    and the same group's, so a large group costs its rows, not its pairs.
    """
    per = rows.groupBy(*at, group).agg(F.count("*").alias("_own"))
    small = F.when(F.col("_own") <= block_rows, F.col("_own"))
    pooled = per.groupBy(*at).agg(F.sum(small).alias("_pooled"), F.count("*").alias("_groups")).where("_groups > 1")
    whole = per.where(F.col("_own") > block_rows)
    cut = lambda n: F.pmod(F.xxhash64(member, F.lit(3)), F.ceil(F.col(n) / block_rows))
    block = F.when(F.col("_own").isNotNull(), F.xxhash64(F.col(group), cut("_own"))).otherwise(
        F.xxhash64(F.lit("pooled"), cut("_pooled")))
    placed = rows.join(pooled, list(at)).join(whole, [*at, group], "left").withColumn("block", block)
    blocks = placed.groupBy(*at, "block").agg(F.min(group).alias("_g0"), F.max(group).alias("_g1"))
    other = blocks.select(*at, F.col("block").alias("_other"), F.col("_g0").alias("_o0"), F.col("_g1").alias("_o1"))
    pure = (F.col("_g0") == F.col("_g1")) & (F.col("_o0") == F.col("_o1")) & (F.col("_g0") == F.col("_o0"))
    pairs = blocks.join(other, list(at)).where((F.col("block") <= F.col("_other")) & ~pure).select(
        *at, F.col("block").alias("lo"), F.col("_other").alias("hi"))
    wanted = pairs.withColumn("block", F.explode(F.array_distinct(F.array("lo", "hi"))))
    return placed.select(*at, "block", member).join(wanted, [*at, "block"]).select(*at, "lo", "hi", member)
