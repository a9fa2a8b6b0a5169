"""Alert, page, deploy and chat payloads as typed rows; works on batches and streams alike.

Every reader takes JSON text in a column named `value`, one payload per row,
and keeps the payloads it cannot use as rows with a reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.functions.evidence import short_sha
from vigilake.functions.labels import dedup_key, fingerprint, severity_level, severity_rank
from vigilake.functions.text import strip
from vigilake.functions.times import parse_timestamp
from vigilake.schemas import ALERT_ENVELOPE_DDL, CHAT_EVENT_DDL

ALERT_COLUMNS = (
    "source", "status", "fingerprint", "dedup_key", "alertname", "service", "severity",
    "severity_rank", "starts_at", "ends_at", "labels", "annotations", "generator_url", "raw",
)


def read_payloads(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """JSON lines, or one payload per file."""
    return spark.read.text(path, wholetext=whole_files)


def _present(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def _is_object(text: Column) -> Column:
    return F.coalesce(F.ltrim(text).startswith("{"), F.lit(False))


def _unreadable(text: Column) -> Column:
    """Why a payload cannot be read as an object, or NULL."""
    return F.when(F.get_json_object(text, "$").isNull(), "malformed json").when(
        ~_is_object(text), "payload is not an object"
    )


def _status(raw: Column) -> Column:
    return F.when(F.lower(raw) == "resolved", "resolved").otherwise("firing")


def _no_nulls(values: Column) -> Column:
    empty = F.create_map().cast("map<string,string>")
    return F.coalesce(F.map_filter(values, lambda _, v: v.isNotNull()), empty)


def alert_entries(payloads: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Every alert of every envelope with its normalised columns and a `reject` reason.

    A payload that is no object or has no array of alerts is one rejected row;
    an empty array has nothing to reject. `carry` names payload columns to keep.
    """
    envelope = payloads.select(
        *carry, "value", F.from_json("value", ALERT_ENVELOPE_DDL).alias("e"), _unreadable(F.col("value")).alias("whole")
    ).withColumn("whole", F.coalesce("whole", F.when(F.col("e.alerts").isNull(), "payload has no alerts array")))
    alone = F.array(F.lit(None).cast(envelope.schema["e"].dataType["alerts"].dataType.elementType))
    entry = envelope.select(
        *carry, "value", "whole", F.explode(F.when(F.col("whole").isNull(), F.col("e.alerts")).otherwise(alone)).alias("a"),
        "e.groupKey", "e.status",
    )
    named = entry.select(
        *carry, "value", "whole", "a", "groupKey", "status", _no_nulls(F.col("a.labels")).alias("labels"),
        _no_nulls(F.col("a.annotations")).alias("annotations"),
        parse_timestamp(F.col("a.startsAt")).alias("starts_at"),
        parse_timestamp(F.col("a.endsAt")).alias("ends_at"),
    ).withColumn("fingerprint", fingerprint(F.col("labels")))
    label = lambda name: F.col("labels")[name]
    level = severity_level(label("severity"))
    reject = (
        F.when(F.col("whole").isNotNull(), F.col("whole"))
        .when(F.col("a").isNull(), "alert entry is not an object")
        .when(_present(label("alertname")).isNull(), "alert has no alertname label")
        .when(F.col("starts_at").isNull(), "alert has no parseable startsAt")
    )
    return named.select(
        *carry, F.lit("alertmanager").alias("source"),
        _status(F.coalesce(_present(F.col("a.status")), _present(F.col("status")))).alias("status"),
        "fingerprint", dedup_key(F.col("groupKey"), F.col("fingerprint")).alias("dedup_key"),
        label("alertname").alias("alertname"), label("service").alias("service"),
        level.alias("severity"), severity_rank(level).alias("severity_rank"), "starts_at", "ends_at",
        "labels", "annotations", _present(F.col("a.generatorURL")).alias("generator_url"),
        F.coalesce(F.to_json("a"), "value").alias("raw"), reject.alias("reject"),
    )


def paging_entries(payloads: DataFrame) -> DataFrame:
    """Paging events, nested or flat, in the same columns as alerts."""
    at = F.get_json_object
    data = at("value", "$.data")
    staged = payloads.withColumn("_data", F.when(_is_object(data), data).otherwise(F.col("value")))
    inner = at("_data", "$.incident")
    staged = staged.withColumn("_i", F.when(_is_object(inner), inner).otherwise(F.col("_data")))
    field = lambda name: _present(at("_i", "$." + name))
    service = F.when(_is_object(at("_i", "$.service")), at("_i", "$.service.summary")).otherwise(
        at("_i", "$.service")
    )
    read = staged.select(
        "value", _present(service).alias("service"),
        F.coalesce(field("title"), field("summary"), _present(at("value", "$.event"))).alias("alertname"),
        parse_timestamp(F.coalesce(field("created_at"), field("createdAt"), at("value", "$.occurred_at")))
        .alias("starts_at"),
        parse_timestamp(field("resolved_at")).alias("ends_at"), field("status").alias("status"),
        severity_level(F.coalesce(field("urgency"), field("priority"))).alias("severity"),
        field("id").alias("_id"), field("html_url").alias("_url"),
    )
    labels = F.map_filter(
        F.create_map(F.lit("alertname"), F.col("alertname"), F.lit("severity"), F.col("severity"),
                     F.lit("service"), F.col("service")), lambda _, v: v.isNotNull())
    urls = F.when(F.col("_url").isNotNull(), F.create_map(F.lit("html_url"), F.col("_url"))).otherwise(
        F.create_map().cast("map<string,string>")
    )
    reject = (
        F.when(~_is_object(F.col("value")), "paging event is not an object")
        .when(F.col("alertname").isNull(), "paging event has no title")
        .when(F.col("starts_at").isNull(), "paging event has no parseable timestamp")
    )
    marked = read.withColumn("labels", labels).withColumn("fingerprint", fingerprint(F.col("labels")))
    return marked.select(
        F.lit("paging").alias("source"), _status(F.col("status")).alias("status"), "fingerprint",
        F.coalesce("_id", "fingerprint").alias("dedup_key"), "alertname", "service", "severity",
        severity_rank(F.col("severity")).alias("severity_rank"), "starts_at", "ends_at", "labels",
        urls.alias("annotations"), F.lit(None).cast("string").alias("generator_url"),
        F.col("value").alias("raw"), reject.alias("reject"),
    )


def accepted(entries: DataFrame) -> DataFrame:
    return entries.where(F.col("reject").isNull()).drop("reject")


def rejected(entries: DataFrame) -> DataFrame:
    return entries.where(F.col("reject").isNotNull()).select("raw", "reject")


def deploy_entries(
    payloads: DataFrame, received_at: Column, repositories: list[str] | None = None
) -> DataFrame:
    """Deploy notices; an allowlist of repositories keeps invented deploys out."""
    at = lambda name: strip(F.coalesce(F.get_json_object("value", "$." + name), F.lit("")))
    sha = F.coalesce(_present(at("sha")), _present(at("commit")))
    repository = _present(at("repository"))
    refused = (
        ~F.coalesce(repository, F.lit("")).isin(*repositories) if repositories else F.lit(False)
    )
    reject = (
        F.when(~_is_object(F.col("value")), "payload must be an object")
        .when(sha.isNull() | _present(at("service")).isNull(), "sha and service are required")
        .when(refused, "repository not in the allowlist")
    )
    return payloads.select(
        short_sha(sha).alias("sha"), at("service").alias("service"),
        F.coalesce(_present(at("environment")), F.lit("production")).alias("environment"),
        repository.alias("repository"), _present(at("actor")).alias("actor"),
        _present(at("title")).alias("title"),
        F.coalesce(parse_timestamp(at("deployed_at")), received_at).alias("deployed_at"),
        F.col("value").alias("raw"), reject.alias("reject"),
    )


def chat_events(payloads: DataFrame) -> DataFrame:
    """Chat events in their declared columns."""
    return payloads.select(F.from_json("value", CHAT_EVENT_DDL).alias("e")).select("e.*")


def chat_rejects(payloads: DataFrame) -> DataFrame:
    """Chat payloads that are no JSON object: raw, reject."""
    return payloads.select(F.col("value").alias("raw"), _unreadable(F.col("value")).alias("reject")).where(
        F.col("reject").isNotNull()
    )


def split_chat(events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(messages, edits, deletes); edits and deletes lacking a channel or ts are dropped."""
    subtype = F.coalesce("subtype", F.lit(""))
    messages = events.where(~subtype.isin("message_changed", "message_deleted"))

    def revision(rows, kind, ts, text):
        return rows.select(
            F.col("channel").alias("channel_id"), ts.alias("ts"), F.lit(kind).alias("kind"),
            text.alias("text"), F.col("event_time").alias("observed_at"),
        ).where((F.coalesce("channel_id", F.lit("")) != "") & (F.coalesce("ts", F.lit("")) != ""))

    edits = revision(
        events.where((subtype == "message_changed") & F.col("message").isNotNull()), "edited",
        F.col("message.ts"), F.coalesce("message.text", F.lit("")),
    )
    deletes = revision(
        events.where(subtype == "message_deleted"), "deleted",
        F.coalesce(_present(F.col("deleted_ts")), F.col("previous_message.ts")),
        F.lit(None).cast("string"),
    )
    return messages, edits, deletes


def to_wire(alerts: DataFrame) -> DataFrame:
    """Alerts as flat string maps: NULL as empty text, nested values as JSON."""
    iso = lambda name: F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    texts = {
        **{c: F.col(c).cast("string") for c in ALERT_COLUMNS},
        "starts_at": iso("starts_at"), "ends_at": iso("ends_at"),
        "labels": F.to_json("labels"), "annotations": F.to_json("annotations"),
    }
    parts = [p for c in ALERT_COLUMNS for p in (F.lit(c), F.coalesce(texts[c], F.lit("")))]
    return alerts.select(F.create_map(*parts).alias("fields"))


def from_wire(records: DataFrame) -> DataFrame:
    """The inverse of `to_wire`."""
    text = lambda name: _present(F.col("fields")[name])
    typed = {
        "severity_rank": text("severity_rank").cast("int"),
        "starts_at": parse_timestamp(text("starts_at")), "ends_at": parse_timestamp(text("ends_at")),
        "labels": F.from_json(text("labels"), "map<string,string>"),
        "annotations": F.from_json(text("annotations"), "map<string,string>"),
    }
    return records.select(*[typed.get(c, text(c)).alias(c) for c in ALERT_COLUMNS])
