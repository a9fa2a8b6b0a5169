"""The incident model derived from the star-schema test tables, for checks and timing only.

The library's operators take their own tables (see `schemas.py`); these views
only give them real rows to work on. Each view is written once for Spark here
and once as SQL in `driver_sql.py`, from the same rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.functions.labels import fingerprint

ORDERS_AS_OF = "2001-08-02 00:00:00"
EVENTS_AS_OF = "2024-01-31 00:00:00"
REPORT_DAYS = 365
N_RUNBOOKS = 20
STEPS = tuple(f"step-{i}" for i in range(1, 8))


class Views:
    """Lazily derived views over one folder of test tables."""

    def __init__(self, spark: SparkSession, folder: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def events(self) -> DataFrame:
        return self.table("events").withColumn("ts", F.col("ts").cast("timestamp"))

    def services(self) -> DataFrame:
        return self.table("nation").select(
            F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"),
            (F.lit(1) + F.col("n_regionkey") % 3).alias("tier"),
        )

    def incidents(self) -> DataFrame:
        lines = self.table("lineitem").groupBy("l_orderkey").agg(
            F.count("*").alias("n"), F.min("l_quantity").alias("q_min"),
            F.max("l_quantity").alias("q_max"), F.sum("l_quantity").alias("q_sum"),
            F.min("l_partkey").alias("part"),
        )
        owner = self.table("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
        joined = (
            self.table("orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
            .join(owner, "o_custkey")
        )
        detected = F.col("o_orderdate").cast("timestamp")
        plus = lambda seconds: F.timestamp_micros(
            F.unix_micros(detected) + (seconds * 1_000_000).cast("bigint")
        )
        status, urgency = F.col("o_orderstatus"), F.substring("o_orderpriority", 1, 1)
        ttm = F.col("q_sum") * 60
        resolved = F.when(status == "F", plus(ttm + F.col("q_max") * 600))
        key = F.col("o_orderkey")
        return joined.select(
            key.alias("id"),
            F.concat(F.lit("inc-"), key.cast("string")).alias("public_key"),
            F.concat(F.lit("order "), key.cast("string")).alias("title"),
            F.concat(F.lit("cust-"), F.col("o_custkey").cast("string")).alias("dedup_key"),
            F.when(key % 7 == 0, key - 1).alias("parent_incident_id"),
            F.when(urgency == "1", "sev1").when(urgency == "2", "sev2")
            .when(urgency == "3", "sev3").otherwise("sev4").alias("severity"),
            F.when(status == "F", "closed").when(status == "P", "mitigated")
            .otherwise("engaged").alias("state"),
            F.when(key % 10 != 0, F.col("c_nationkey")).alias("primary_service_id"),
            detected.alias("detected_at"),
            plus(F.col("q_min") * 60).alias("acknowledged_at"),
            F.when(status.isin("P", "F"), plus(ttm)).alias("mitigated_at"),
            resolved.alias("resolved_at"), resolved.alias("closed_at"),
            detected.alias("last_alert_at"),
            F.col("n").alias("correlated_alert_count"),
            (F.col("part") % N_RUNBOOKS).cast("int").alias("runbook_id"),
            F.concat(F.lit("C"), (key % 997).cast("string")).alias("chat_channel_id"),
        )

    def runbooks(self) -> DataFrame:
        """One runbook per part residue; each declares the seven steps."""
        return self.table("part").select(
            (F.col("p_partkey") % N_RUNBOOKS).cast("int").alias("id")
        ).distinct().select(
            "id", F.concat(F.lit("runbook-"), F.col("id").cast("string")).alias("name"),
            F.array(*[F.lit(s) for s in STEPS]).alias("step_ids"),
        )

    def step_signals(self) -> DataFrame:
        used = self.incidents().select(F.col("id").alias("incident_id"), "runbook_id")
        lines = self.table("lineitem").where(F.col("l_returnflag") != "N").select(
            F.col("l_orderkey").alias("incident_id"),
            F.concat(F.lit("step-"), F.col("l_linenumber").cast("string")).alias("step_id"),
        )
        return lines.distinct().join(used, "incident_id")

    def action_items(self) -> DataFrame:
        shipped = self.table("lineitem").groupBy("l_orderkey").agg(
            F.max("l_shipdate").cast("timestamp").alias("shipped")
        )
        created = F.col("o_orderdate").cast("timestamp")
        urgency = F.substring("o_orderpriority", 1, 1)
        return self.table("orders").join(
            shipped, F.col("o_orderkey") == F.col("l_orderkey")
        ).select(
            F.col("o_orderkey").alias("incident_id"),
            F.when(urgency == "1", "P0").when(urgency == "2", "P1").otherwise("P2")
            .alias("priority"),
            F.when(F.col("o_orderstatus") == "O", "open").otherwise("done").alias("status"),
            created.alias("created_at"),
            F.when(F.col("shipped") >= created, F.col("shipped")).alias("completed_at"),
        )

    def documents(self) -> DataFrame:
        """Review documents: two consecutive documents are revisions of one incident."""
        quality = self.table("labels").select("doc_id", "quality")
        doc = F.col("doc_id")
        return self.table("documents").join(quality, "doc_id", "left").select(
            F.floor(doc / 2).alias("incident_id"),
            (doc % 2 + 1).cast("int").alias("revision"),
            F.when(F.col("source") == "src0", "skeleton").otherwise("primary")
            .alias("generation_layer"),
            F.concat(F.lit("model-"), F.col("lang")).alias("model"),
            F.concat(F.lit("2."), (doc % 3).cast("string")).alias("prompt_version"),
            (F.col("n_chars") / F.lit(1_000_000.0)).cast("decimal(10,6)").alias("cost_usd"),
            F.col("n_chars").cast("int").alias("generation_ms"),
            F.when(F.col("quality") == 1, 1.0).when(F.col("quality") == 0, 0.5)
            .cast("decimal(4,3)").alias("citation_coverage"),
            ((doc % 10) / 10.0).cast("decimal(4,3)").alias("human_edit_ratio"),
            F.timestamp_seconds(F.lit(1_704_067_200) + doc * 3600).alias("created_at"),
            F.col("text").alias("body"),
        )

    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(
            F.col("vec_id").alias("id"), "embedding",
            F.concat(F.lit("inc-"), F.col("vec_id").cast("string")).alias("public_key"),
            F.concat(F.lit("topic "), F.col("label").cast("string")).alias("title"),
            F.timestamp_seconds(F.lit(1_704_067_200) + F.col("vec_id") * 60).alias("detected_at"),
        )

    def vector_versions(self) -> DataFrame:
        """Every vector with two that lie near it, and a copy of each tenth."""
        shifted = lambda share: F.zip_with(
            F.col("embedding").cast("array<double>"), F.reverse("embedding").cast("array<double>"), lambda x, y: x + share * y)
        rows = self.table("embeddings").select(
            "vec_id", F.posexplode(F.array(*[shifted(F.lit(s)) for s in (0.0, 0.3, 0.5)])).alias("k", "embedding"))
        near = rows.select((F.col("vec_id") * 3 + F.col("k")).alias("id"), "embedding")
        copies = rows.where("vec_id % 10 = 0 and k = 0").select((F.lit(10_000_000) + F.col("vec_id")).alias("id"), "embedding")
        return near.unionByName(copies)

    def messages(self) -> DataFrame:
        """Chat transcript: one channel per conversation."""
        epoch = F.lit(1_700_000_000) + F.col("conv_id") * 3600 + F.col("turn") * 60
        return self.table("conversations").select(
            (F.col("conv_id") * 10_000 + F.col("turn")).alias("id"),
            F.col("conv_id").alias("incident_id"),
            F.concat(F.lit("C"), F.col("conv_id").cast("string")).alias("channel_id"),
            epoch.cast("string").alias("ts"), F.col("role").alias("user_id"), "text",
            F.timestamp_seconds(epoch).alias("received_at"), "turn",
        )

    def alerts(self) -> DataFrame:
        """Error events as alerts of twelve services; one dedup key per service and day."""
        number = F.col("user_id") % 12
        service = F.concat(F.lit("svc-"), number.cast("string"))
        labels = F.create_map(
            F.lit("alertname"), F.lit("ErrorRate"), F.lit("service"), service,
            F.lit("namespace"), F.concat(F.lit("ns-"), (number % 3).cast("string")),
            F.lit("severity"), F.lit("critical"),
        )
        named = self.events().where(F.col("event_type") == "error").select(
            F.col("event_id").alias("id"), F.lit("ErrorRate").alias("alertname"),
            service.alias("service"), labels.alias("labels"), F.lit("sev1").alias("severity"),
            F.lit(4).alias("severity_rank"), F.col("ts").alias("starts_at"),
        )
        print_ = fingerprint(F.col("labels"))
        day = F.date_format("starts_at", "yyyyMMdd")
        return named.withColumn("fingerprint", print_).withColumn(
            "dedup_key", F.concat_ws("-", "fingerprint", day)
        )

    def edges(self) -> DataFrame:
        """Service dependencies seen in the alerts' own services: three chains by residue."""
        number = F.col("user_id") % 12
        seen = self.events().where(F.col("event_type") == "error").select(number.alias("n"))
        name = lambda n: F.concat(F.lit("svc-"), n.cast("string"))
        return seen.distinct().where(F.col("n") < 9).select(
            name(F.col("n")).alias("service"), name(F.col("n") + 3).alias("depends_on")
        )

    def pages(self) -> DataFrame:
        zone = F.when(F.col("user_id") % 3 == 0, "UTC").when(
            F.col("user_id") % 3 == 1, "Asia/Kolkata"
        ).otherwise("America/Los_Angeles")
        return self.events().where(F.col("event_type").isin("error", "purchase")).select(
            F.col("ts").alias("time"),
            F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("responder"),
            F.when(F.col("event_type") == "error", "sev1").otherwise("sev3").alias("severity"),
            zone.alias("tz"), F.col("event_id").alias("incident_id"),
        )

    def page_incidents(self) -> DataFrame:
        end = F.timestamp_micros(
            F.unix_micros("ts") + F.round(F.col("value") * 60_000_000).cast("bigint")
        )
        return self.events().where(F.col("event_type").isin("error", "purchase")).select(
            F.col("event_id").alias("id"), F.col("ts").alias("detected_at"),
            end.alias("resolved_at"),
        )

    def llm_calls(self) -> DataFrame:
        """Documents again, as the model calls that wrote them."""
        return self.documents().select(
            F.col("created_at").alias("time"), "incident_id", F.lit("synthesize").alias("role"),
            "model", "prompt_version", "cost_usd", F.col("generation_ms").alias("latency_ms"),
        )

    def deploys(self) -> DataFrame:
        """Shipments as deploys by the supplier's nation."""
        owner = self.table("supplier").select(
            F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("service_id")
        )
        line = F.col("l_orderkey") * 10 + F.col("l_linenumber")
        return self.table("lineitem").join(owner, "l_suppkey").select(
            F.substring(F.sha2(line.cast("string"), 256), 1, 12).alias("sha"), "service_id",
            line.alias("line"), F.col("l_shipdate").cast("timestamp").alias("deployed_at"),
        )

    def samples(self) -> DataFrame:
        """A counter per user that counts events and resets with each day."""
        ordered = "PARTITION BY user_id, to_date(ts) ORDER BY ts, event_id"
        return self.events().select(
            F.col("ts").alias("time"), F.lit("events_total").alias("name"),
            F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("series"),
            F.col("event_type").alias("outcome"),
            F.expr(f"CAST(count(*) OVER ({ordered}) AS DOUBLE)").alias("value"), "event_id",
        )
