"""Deduplication, upserts and per-key numbering of stored rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilake.functions.skew import time_cell, with_running

DAY = 86_400


def _reduce(rows: DataFrame, keys: Sequence[str], order: Column, last: bool) -> DataFrame:
    """First or last row per key by plain aggregation, combined on the map side."""
    rest = F.struct(*[c for c in rows.columns if c not in keys])
    pick = F.max_by if last else F.min_by
    return (
        rows.groupBy(*keys).agg(pick(rest, order).alias("_row"))
        .select(*keys, "_row.*").select(*rows.columns)
    )


def keep_first(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Insert-or-ignore: of rows with the same key the earliest arrival stays."""
    return _reduce(rows, keys, F.struct(*order), last=False)


def insert_new(incoming: DataFrame, stored: DataFrame, keys: Sequence[str], order: Sequence[str]):
    """The incoming rows an insert-or-ignore would actually add to `stored`."""
    fresh = keep_first(incoming, keys, order)
    return fresh.join(stored.select(*keys).distinct(), list(keys), "left_anti")


def upsert_latest(
    stored: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """Stored and incoming rows merged, the latest row per key winning."""
    return _reduce(stored.unionByName(incoming), keys, F.struct(*order), last=True)


def idempotency_key(incident_id: Column, action: Column, discriminator: Column) -> Column:
    """Hashed identity of an outgoing intent, so a repeat can be recognised."""
    parts = F.concat_ws(":", incident_id.cast("string"), action, F.coalesce(discriminator, F.lit("")))
    return F.sha2(parts, 256)


def count_refires(alerts: DataFrame) -> DataFrame:
    """One row per (fingerprint, starts_at) with how often and when last it was sent."""
    keys = ["fingerprint", "starts_at"]
    rest = [c for c in alerts.columns if c not in (*keys, "received_at")]
    return alerts.groupBy(*keys).agg(
        F.count("*").alias("seen_count"), F.max("received_at").alias("last_seen_at"),
        F.min("received_at").alias("received_at"),
        F.min_by(F.struct(*rest), F.col("received_at")).alias("_row"),
    ).select(*keys, "received_at", "last_seen_at", "seen_count", "_row.*")


def next_sequence(
    incoming: DataFrame, stored: DataFrame, keys: Sequence[str], order: Sequence[str],
    seq: str, start: int = 1,
) -> DataFrame:
    """Numbers incoming rows per key after the highest stored number.

    `order[0]` is a timestamp; it spreads a busy key over days.
    """
    highest = stored.groupBy(*keys).agg(F.max(seq).alias("_highest"))
    numbered = with_running(
        incoming, keys, time_cell(F.col(order[0]), DAY), order, F.lit(1), "_n"
    )
    base = F.coalesce(F.col("_highest") + 1, F.lit(start))
    return (
        numbered.join(highest, list(keys), "left")
        .withColumn(seq, (base + F.col("_n") - 1).cast("int"))
        .drop("_n", "_highest")
    )


def append_revisions(
    events: DataFrame, messages: DataFrame, stored: DataFrame | None = None
) -> DataFrame:
    """Edits and deletes of known messages as numbered revisions.

    `events` has channel_id, ts, kind, text, observed_at. An event equal to the
    revision before it, NULL text included, adds nothing.
    """
    keys = ["channel_id", "ts"]
    order = ["observed_at", "kind", "text"]
    known = messages.select(*keys).distinct()
    rows = events.select(*keys, "kind", "text", "observed_at", F.lit(None).cast("int").alias("done"))
    if stored is not None:
        old = stored.select(*keys, "kind", "text", "observed_at", F.col("revision").alias("done"))
        rows = rows.unionByName(old)
    rows = rows.join(known, keys, "left_semi")
    # inside a cell of time rows are compared with the one before; what a cell's first row
    # follows, and how many revisions precede the cell, is known from one summary per cell
    here = Window.partitionBy(*keys, "_cell").orderBy(*order)
    now = F.struct("kind", "text")
    equal = lambda a, b: a["kind"].eqNullSafe(b["kind"]) & a["text"].eqNullSafe(b["text"])
    celled = rows.withColumn("_cell", time_cell(F.col("observed_at"), DAY)).withColumns({
        "_now": now, "_before": F.lag(now).over(here), "_first": F.row_number().over(here) == 1})
    later = ~F.col("_first") & (F.col("done").isNotNull() | ~equal(F.col("_now"), F.col("_before")))
    celled = celled.withColumn("_later", later)
    by_time = F.struct(*order)
    cells = Window.partitionBy(*keys).orderBy("_cell")
    ahead = cells.rowsBetween(Window.unboundedPreceding, -1)
    summary = celled.groupBy(*keys, "_cell").agg(
        F.min_by(F.struct("kind", "text", "done"), by_time).alias("_head"), F.max_by("_now", by_time).alias("_tail"),
        F.count_if("_later").alias("_rest"),
    ).withColumn("_follows", F.lag("_tail").over(cells)).withColumn("_head_kept", (
        F.col("_head.done").isNotNull() | F.col("_follows").isNull() | ~equal(F.col("_head"), F.col("_follows"))
    ).cast("int")).select(
        *keys, "_cell", "_head_kept", F.coalesce(F.sum(F.col("_rest") + F.col("_head_kept")).over(ahead), F.lit(0)).alias("_offset"))
    so_far = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = celled.withColumn("_so_far", F.count_if("_later").over(so_far)).join(summary, [*keys, "_cell"])
    kept = F.col("_later") | (F.col("_first") & (F.col("_head_kept") == 1))
    return counted.where(kept & F.col("done").isNull()).select(
        *keys, "kind", "text", "observed_at",
        (F.col("_offset") + F.col("_head_kept") + F.col("_so_far")).cast("int").alias("revision"),
    )


def dedup_epochs(opened: DataFrame) -> DataFrame:
    """Epoch of each incident: how many of its key were opened before it."""
    by_key = Window.partitionBy("dedup_key").orderBy("detected_at", "id")
    return opened.withColumn("dedup_epoch", F.row_number().over(by_key) - 1)
