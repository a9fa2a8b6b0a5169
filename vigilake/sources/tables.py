"""Time-partitioned tables: writing, pruned reading and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.functions.times import as_of_literal, interval
from vigilake.schemas import schema

# Days each table is kept; tables not named here are kept for good.
RETENTION_DAYS = {"timeline_events": 90, "signal_samples": 90, "page_events": 90, "llm_calls": 400}
ROWS_PER_FILE = 5_000_000


def write_by_day(
    rows: DataFrame, path: str, time: str, segment: list[str], rows_per_task: int = ROWS_PER_FILE,
    mode: str = "append",
) -> None:
    """Writes day partitions sorted by segment and time, so row-group statistics can skip.

    Rows of a day are spread by a hash of all their columns over as many tasks as
    its counted rows fill, which keeps a busy day or segment from being one task's
    work. The count reads only the time column.
    """
    dated = rows.withColumn("day", F.to_date(time))
    tasks = dated.groupBy(F.col("day").alias("_of")).agg(
        F.ceil(F.count("*") / F.lit(rows_per_task)).alias("_tasks")
    )
    flat = [F.to_json(c) if "map<" in kind else F.col(c) for c, kind in rows.dtypes]
    (
        dated.join(tasks, F.col("day").eqNullSafe(F.col("_of")))
        .withColumn("_spread", F.pmod(F.xxhash64(*flat), "_tasks")).drop("_of", "_tasks")
        .repartition("day", "_spread").sortWithinPartitions("day", *segment, time).drop("_spread")
        .write.mode(mode).option("maxRecordsPerFile", ROWS_PER_FILE)
        .option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    )


def read_range(
    spark: SparkSession, path: str, table: str, time: str, start, end
) -> DataFrame:
    """Rows in `[start, end]`; the day predicate is stated so that folders are pruned."""
    low, high = as_of_literal(start), as_of_literal(end)
    stored = spark.read.schema(schema(table).add("day", "date")).parquet(path)
    return stored.where(
        F.col("day").between(F.to_date(low), F.to_date(high)) & F.col(time).between(low, high)
    ).drop("day")


def retained(rows: DataFrame, as_of, keep_days: int) -> DataFrame:
    """Partitions still inside the retention period."""
    return rows.where(F.col("day") >= F.to_date(as_of_literal(as_of) - interval(keep_days, "DAY")))


def rewrite_retained(spark: SparkSession, source: str, target: str, as_of, keep_days: int) -> None:
    """Copies what is still retained to a new folder, day by day as it is."""
    retained(spark.read.parquet(source), as_of, keep_days).write.mode("overwrite").partitionBy(
        "day"
    ).parquet(target)
