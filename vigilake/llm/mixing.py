"""Mixing sources to target weights by entropy balancing.

Each source has a token target. Document rates are those nearest to 1 in relative
entropy that meet the targets: `rate = min(limit, exp(lambda * size / mean size))`
with one multiplier per source, found by Newton's iterations on the convex dual.
Every iteration is one distributed aggregation of gradient and curvature; rates
depend on source and size only, so it runs over (source, size) counts. Iterates that
leave the bracket of the root are replaced by its middle, and the last step rounds
rates into whole copies: the extra copies of a source go to the documents whose
fraction exceeds their hashed draw by most, up to the tokens still missing.

Everything is DataFrame operations, and per-source values stay in a frame.

Defined cases. A null text has size 0 and is never taken. Null is a source of its
own, the last one. A source of size 0 has target 0. Repeated rows are separate rows
with the same draw, and are taken together or split by the order of their ids.
No document is taken more than `limit` times. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilake.llm.common import WORD_PATTERN, stored

CELLS = 1024


def word_count(text: Column) -> Column:
    """Number of runs of other than blanks; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, limit: float) -> DataFrame:
    """`source, source_size, target` from `source, source_size`.

    Targets split `share` of all tokens by weight, stop at `limit` times the
    source's size, and the excess goes to the others by weight. A source is full
    if the level (tokens per unit of weight) reaches `limit * size / weight`, so
    sorting by that ratio and two running sums find the level without iteration.
    """
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth % len(weights) + 1).cast("int"))
    by_ratio = Window.orderBy("ratio", "nth").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ranked = (
        sizes.withColumn("nth", nth).withColumn("weight", weight)
        .withColumn("ratio", F.lit(limit) * F.col("source_size") / F.col("weight"))
        .withColumn("filled", F.coalesce(F.sum(F.lit(limit) * F.col("source_size")).over(by_ratio), F.lit(0.0)))
        .withColumn("used", F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0)))
        .withColumn("total", F.lit(share) * F.sum("source_size").over(everything))
        .withColumn("level", (F.col("total") - F.col("filled")) / (F.sum("weight").over(everything) - F.col("used")))
        # the first source in ratio order whose ratio exceeds the level ends the full ones
        .withColumn("level", F.min(
            F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "nth", "level"))
        ).over(everything)["level"])
    )
    full = F.lit(limit) * F.col("source_size").cast("double")
    return ranked.select(
        "source", "source_size",
        F.when(F.col("level").isNull(), full).otherwise(F.least(full, F.col("weight") * F.col("level"))).alias("target"),
    )


def multipliers(
    counts: DataFrame, targets: DataFrame, limit: float, tolerance: float = 1e-6, max_steps: int = 60
) -> DataFrame:
    """`source, lambda, mean`: Newton's iterations on the dual, one aggregation each."""
    state = stored(
        counts.groupBy("source").agg(
            (F.sum(F.col("size") * F.col("n")) / F.greatest(F.sum("n"), F.lit(1))).alias("mean"),
            F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"),
        ).join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).select(
            "source", "mean", "target", "source_size",
            (F.col("target") >= limit * F.col("source_size") * (1 - 1e-12)).alias("full"),
            F.lit(0.0).alias("lambda"), F.lit(-80.0).alias("low"),
            (F.log(F.lit(limit)) * F.col("mean") / F.col("least")).alias("high"),
        )
    )
    narrow = state.count() <= 10_000
    for _ in range(max_steps):
        at = F.broadcast(state) if narrow else state
        x = F.col("size") / F.col("mean")
        rate = F.least(F.lit(limit), F.exp(F.least(F.col("lambda") * x, F.lit(50.0))))
        moved = (
            counts.where(F.col("size") > 0).withColumnRenamed("source", "of")
            .join(at, F.col("of").eqNullSafe(F.col("source")))
            .groupBy("source").agg(
                F.sum(F.col("n") * F.col("size") * rate).alias("taken"),
                F.sum(F.when(rate < limit, F.col("n") * F.col("size") * rate * x).otherwise(0.0)).alias("curve"),
            ).withColumnRenamed("source", "of")
        )
        gap = F.col("taken") - F.col("target")
        low = F.when(gap < 0, F.col("lambda")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("lambda")).otherwise(F.col("high"))
        newton = F.col("lambda") - gap / F.col("curve")
        step = F.when((F.col("curve") > 0) & (newton > low) & (newton < high), newton).otherwise((low + high) / 2)
        near = F.abs(gap) <= tolerance * F.greatest(F.col("target"), F.lit(1.0))
        state = stored(
            state.join(moved, F.col("of").eqNullSafe(F.col("source")), "left").select(
                "source", "mean", "target", "source_size", "full",
                F.when(F.col("full") | F.col("taken").isNull() | near, F.col("lambda"))
                .otherwise(F.round(step, 10)).alias("lambda"),
                low.alias("low"), high.alias("high"),
                (F.col("full") | F.col("taken").isNull() | near).alias("done"),
            )
        )
        if state.where(~F.col("done")).isEmpty():
            break
    return state.select("source", "mean", "target", "source_size", "full", F.col("lambda"))


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, limit: int = 2,
) -> DataFrame:
    """`doc_id, source, size, source_size, target, rate, copies, taken` for every document."""
    sized = stored(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")
    ))
    counts = stored(sized.groupBy("source", "size").agg(F.count("*").alias("n")))
    sizes = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = stored(source_targets(sizes, weights, share, float(limit)))
    solved = multipliers(counts, targets, float(limit)).withColumnRenamed("source", "of")
    at = F.broadcast(solved) if solved.count() <= 10_000 else solved
    rate = F.when(F.col("size") == 0, 0.0).when(F.col("full"), float(limit)).otherwise(
        F.least(F.lit(float(limit)), F.exp(F.least(F.col("lambda") * F.col("size") / F.col("mean"), F.lit(50.0))))
    )
    draw = (F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 40)) + 0.5) / (1 << 40)
    rated = (
        sized.join(at, F.col("source").eqNullSafe(F.col("of"))).drop("of")
        .withColumn("rate", rate).withColumn("whole", F.floor("rate").cast("int"))
        # documents in order of this value get an extra copy until the target is met
        .withColumn("value", draw - (F.col("rate") - F.col("whole")))
        .withColumn("cell", F.floor(F.col("value") * CELLS))
    )
    rated = stored(rated)
    extra = F.when((F.col("whole") < limit) & (F.col("size") > 0), F.col("size")).otherwise(0)
    cells = rated.groupBy("source", "cell").agg(
        F.sum(extra).alias("in_cell"), F.sum(F.col("whole") * F.col("size")).alias("sure")
    )
    earlier = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select(
        F.col("source").alias("of"), F.col("cell").alias("of_cell"),
        F.coalesce(F.sum("in_cell").over(earlier), F.lit(0)).alias("before"),
        F.sum("sure").over(Window.partitionBy("source")).alias("sure"),
    )
    inside = (
        Window.partitionBy("source", "cell").orderBy("value", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    placed = (
        rated.withColumn("running", F.sum(extra).over(inside))
        .join(F.broadcast(offsets) if offsets.count() <= 100_000 else offsets,
              F.col("source").eqNullSafe(F.col("of")) & (F.col("cell") == F.col("of_cell")))
    )
    more = (extra > 0) & (
        F.col("before") + F.col("running") - extra / 2 <= F.col("target") - F.col("sure")
    )
    copies = F.when(F.col("size") > 0, F.col("whole") + more.cast("int")).otherwise(0)
    return placed.withColumn("copies", copies).select(
        "doc_id", "source", "size", "source_size", "target", "rate", "copies",
        (F.col("copies") * F.col("size")).cast("long").alias("taken"),
    )
