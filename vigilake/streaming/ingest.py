"""From raw payload streams to stored rows, safe under redelivery.

A watermark bounds how long a stream remembers keys. Redelivery can be later
than that, so every sink also leaves out rows its table already holds; a
replayed micro-batch therefore adds nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.functions.times import chat_timestamp
from vigilake.operators.audit import triage_messages
from vigilake.operators.intent import classify, snapshot_requests, timeline
from vigilake.operators.store import append_revisions, insert_new
from vigilake.operators.sweeps import with_incident
from vigilake.sources.webhooks import (
    accepted,
    alert_entries,
    chat_events,
    chat_rejects,
    rejected,
    split_chat,
)

Sink = Callable[[DataFrame, int], None]


def payload_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Files of JSON lines as a stream of payloads."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)


def firing(alerts: DataFrame) -> DataFrame:
    return alerts.where(F.col("status") == "firing")


def resolved(alerts: DataFrame) -> DataFrame:
    return alerts.where(F.col("status") == "resolved")


def once(rows: DataFrame, keys: Sequence[str], time: str, remember: str = "6 hours") -> DataFrame:
    """One row per key within the remembered time; which copy survives is not defined."""
    return rows.withWatermark(time, remember).dropDuplicatesWithinWatermark(list(keys))


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at `path`, or None before its first write."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def of_days(table: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of a day-partitioned table on the days `rows` fall in.

    The first and the last day are read from the rows and prune the table's folders;
    the days between are compared by a join.
    """
    first, last = rows.agg(F.min("day"), F.max("day")).first()
    if first is None:
        return table.where(F.lit(False))
    return table.where(F.col("day").between(F.lit(first), F.lit(last))).join(rows.select("day").distinct(), "day", "left_semi")


def append_new(rows: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], time: str) -> None:
    """Appends the earliest row of each key the table lacks; only the rows' own days are compared."""
    dated = rows.withColumn("day", F.to_date(time))
    table = stored(rows.sparkSession, path)
    held = dated.where(F.lit(False)) if table is None else of_days(table, dated)
    insert_new(dated, held, keys, order).write.mode("append").partitionBy("day").parquet(path)


def _keep_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    """One folder per query and micro-batch, so that a replay replaces what it wrote and nothing else.

    A query keeps its id as long as it has its checkpoint; another query, or the same one
    after its checkpoint was lost, numbers its batches anew under an id of its own.
    """
    query = rows.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "none"
    rows.write.mode("overwrite").parquet(f"{path}/query={query}/batch={batch_id}")


def alert_sink(alerts_path: str, rejects_path: str, resolved_path: str, sightings_path: str) -> Sink:
    """Stores each firing alert once by (fingerprint, starts_at), counting how often it came.

    Resolved alerts have a table of their own, once per (fingerprint, starts_at,
    ends_at), since they must not open incidents. Unusable payloads go aside.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        entries = alert_entries(batch)
        _keep_batch(rejected(entries), rejects_path, batch_id)
        good = accepted(entries)
        order = ["severity_rank", "raw"]
        append_new(firing(good), alerts_path, ["fingerprint", "starts_at"], order, "starts_at")
        append_new(resolved(good), resolved_path, ["fingerprint", "starts_at", "ends_at"], order, "starts_at")
        seen = firing(good).groupBy("fingerprint", "starts_at").agg(
            F.count("*").alias("seen"), F.current_timestamp().alias("seen_at")
        )
        _keep_batch(seen, sightings_path, batch_id)

    return write


def with_sightings(alerts: DataFrame, sightings: DataFrame) -> DataFrame:
    """Stored alerts with `seen_count` and `last_seen_at` over all deliveries."""
    keys = ["fingerprint", "starts_at"]
    total = sightings.groupBy(*keys).agg(
        F.sum("seen").alias("seen_count"), F.max("seen_at").alias("last_seen_at")
    )
    return alerts.join(total, keys, "left")


def transcript_sink(incidents: DataFrame, messages_path: str, timeline_path: str, snapshots_path: str,
                    revisions_path: str, rejects_path: str) -> Sink:
    """Stores messages once, classifies the new ones, and logs edits and deletes.

    Unreadable payloads go aside. An edit whose message was never stored has
    nothing to revise and adds no revision.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        _keep_batch(chat_rejects(batch), rejects_path, batch_id)
        messages, edits, deletes = split_chat(chat_events(batch))
        owned = with_incident(messages.withColumn("channel_id", F.col("channel")), incidents)
        kept = triage_messages(owned).where(F.col("reason") == "stored").select(
            "incident_id", "channel_id", "ts", "thread_ts", F.col("user").alias("user_id"),
            F.coalesce("text", F.lit("")).alias("text"), chat_timestamp(F.col("ts")).alias("time"),
            F.col("event_time").alias("received_at"),
        )
        # Timeline first: its own key makes a repeat harmless, so a crash between
        # the two writes is repaired by the replay of the micro-batch.
        events = timeline(classify(kept))
        append_new(events, timeline_path, ["incident_id", "source_message_ts"], ["intent"], "time")
        append_new(
            snapshot_requests(events).withColumn("time", chat_timestamp(F.col("at"))), snapshots_path,
            ["incident_id", "at"], ["reason"], "time",
        )
        append_new(kept, messages_path, ["channel_id", "ts"], ["received_at", "text"], "time")
        spark = batch.sparkSession
        held = stored(spark, messages_path)
        if held is None:
            return
        by_day = lambda rows: rows.withColumn("time", chat_timestamp(F.col("ts"))).withColumn("day", F.to_date("time"))
        observed = edits.unionByName(deletes)
        touched = by_day(observed).select("channel_id", "ts", "day").distinct()
        keys = touched.select("channel_id", "ts")
        log = stored(spark, revisions_path)
        known = of_days(held, touched).join(keys, ["channel_id", "ts"], "left_semi")
        past = None if log is None else of_days(log, touched).join(keys, ["channel_id", "ts"], "left_semi")
        # the log is cut by the day of the message, as the messages are
        fresh = by_day(append_revisions(observed, known, past)).drop("day")
        append_new(fresh, revisions_path, ["channel_id", "ts", "revision"], ["observed_at"], "time")

    return write


def run_once(stream: DataFrame, sink: Sink, checkpoint: str):
    """Processes everything available and stops; the checkpoint makes it resumable."""
    query = (
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query
