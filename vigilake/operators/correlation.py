"""Which alerts belong to one outage.

An alert attaches to the open incident that already holds its dedup key;
otherwise it joins the best-scoring open incident or opens a new one. That rule
depends on order, so the work is arranged to keep the ordered part small:

1. Above a threshold of 0.6 a scored merge needs a service within two hops *and*
   closeness in time, so only alerts of one connected component of the service
   graph (joined further by shared dedup keys) can ever meet.
2. A repeat of a key whose last alert is less than the closing time old cannot
   do anything but attach. All such repeats between two possible decisions of a
   component are reduced to one row per key, by hash aggregation per minute and
   then across minutes.
3. A component's timeline splits into islands wherever nothing could bridge the
   gap.

Each island's remaining rows then stream, sorted, through one loop whose memory
is the set of incidents open at that moment. Decisions are joined back to all
alerts on (key, hour), which spreads a hot key over its hours.
"""

from __future__ import annotations

import warnings
from collections import Counter
from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilake.constants import (
    CLOSE_AFTER_S,
    CORRELATION_WINDOW_S,
    LABEL_WEIGHT,
    MERGE_THRESHOLD,
    STABLE_LABELS,
    STORM_THRESHOLD,
    TIME_WEIGHT,
    TOPOLOGY_WEIGHT,
)
from vigilake.functions.skew import time_cell, with_running
from vigilake.session import cut_lineage
from vigilake.operators.graph import components, depths, graph_nodes, neighbours

HOUR = 3600
MINUTE = 60
DECISION_DDL = (
    "alert_id BIGINT, dedup_key STRING, incident_id BIGINT, decided_at TIMESTAMP, kind STRING, "
    "score DOUBLE, reasons ARRAY<STRING>"
)


def correlate(
    alerts: DataFrame, edges: DataFrame, *, window_s: int = CORRELATION_WINDOW_S,
    threshold: float = MERGE_THRESHOLD, close_after_s: int = CLOSE_AFTER_S,
    closures: DataFrame | None = None, order: str | None = None, tenant: str | None = None,
    declared: DataFrame | None = None,
) -> DataFrame:
    """Assigns every alert to an incident: incident_id, epoch, kind, score, reasons.

    `alerts` has id, dedup_key, service, severity_rank, labels, starts_at.
    `closures` (dedup_key, closed_at, and the tenant column if one is named) ends the incident holding that key; without
    them an incident ends after `close_after_s` of silence. `order` names an
    arrival column when alerts must be taken in another order than by start.
    `tenant` names a column whose values never share an incident. An incident is
    named by its first alert.
    """
    rows = _with_component(_scoped(alerts, closures, order, tenant), edges, declared, threshold)
    if order is None and close_after_s >= HOUR:
        return _correlate_reduced(rows, edges, declared, window_s, threshold, close_after_s, closures is not None)
    steps = _with_slack(_plain_steps(rows), window_s, threshold, close_after_s, order)
    decisions = _decide(steps, edges, declared, window_s, threshold, close_after_s, order is None)
    return _with_epoch(decisions, rows.where(~F.col("closing")).select("alert_id", "tenant"))


def _scoped(alerts, closures, order, tenant):
    """Alerts and closing events as rows of one shape."""
    scope = F.col(tenant).cast("string") if tenant else F.lit("")
    rows = alerts.select(
        F.col("id").alias("alert_id"), scope.alias("tenant"), "dedup_key", "service",
        F.col("severity_rank").cast("int").alias("severity_rank"),
        F.struct(*[F.col("labels")[name].alias(name) for name in STABLE_LABELS]).alias("labels"),
        "starts_at", (F.col(order) if order else F.col("starts_at")).alias("taken_at"),
        F.lit(False).alias("closing"),
    )
    if closures is None:
        return rows
    ends = closures.select("dedup_key", F.col("closed_at").alias("starts_at"), *([tenant] if tenant else []))
    return rows.unionByName(
        ends.withColumns({"taken_at": F.col("starts_at"), "closing": F.lit(True), "tenant": scope}).select(
            "tenant", "dedup_key", "starts_at", "taken_at", "closing"),
        allowMissingColumns=True,
    )


def _plain_steps(rows):
    return rows.select(
        "tenant", "component", "dedup_key", "service", "severity_rank", "labels",
        F.col("alert_id").alias("first_id"), F.col("starts_at").alias("first_at"),
        F.col("starts_at").alias("last_at"), "taken_at", "closing",
    )


def _with_slack(steps, window_s, threshold, close_after_s, order):
    if order is None:
        return _with_island(cut_lineage(steps), window_s, threshold, close_after_s)
    return steps.withColumn("island", F.concat_ws("|", "tenant", "component"))


def _with_component(rows, edges, declared, threshold):
    """Adds `component`; one for everything when the threshold makes no such bound hold."""
    if threshold <= 0.6:
        warnings.warn(
            "at a threshold of 0.6 or less any two alerts may merge: each tenant is one task",
            stacklevel=3,
        )
        return rows.withColumn("component", F.lit("all"))
    pairs = rows.where("service IS NOT NULL").select("dedup_key", "service").distinct()
    known = pairs.join(graph_nodes(edges, declared), "service", "left_semi")
    first = known.groupBy("dedup_key").agg(F.min("service").alias("_first"))
    bridges = known.join(first, "dedup_key").where(F.col("service") != F.col("_first")).select(
        "service", F.col("_first").alias("depends_on")
    )
    links = cut_lineage(edges.select("service", "depends_on").union(bridges.distinct()))
    by_service = components(links, declared)
    by_key = known.join(by_service, "service").groupBy("dedup_key").agg(
        F.min("component").alias("_by_key")
    )
    placed = rows.join(by_service, "service", "left")
    direct = placed.where(F.col("component").isNotNull())
    keyed = placed.where(F.col("component").isNull()).join(by_key, "dedup_key", "left").withColumn(
        "component", F.coalesce("_by_key", F.concat(F.lit("key:"), "dedup_key"))
    ).drop("_by_key")
    return direct.unionByName(keyed)


def _reduced(rows, close_after_s, closed=False):
    """(rows with their hour, run of each key and hour, steps left after repeats are reduced).

    With closing events in the rows, any of them may have ended the incident a key is in:
    time is cut at the component's closings, and the first repeat of a key after each of
    them is kept as a possible decision.
    """
    hour = time_cell(F.col("starts_at"), HOUR)
    minute = time_cell(F.col("starts_at"), MINUTE)
    rows = rows.withColumns({"hour": hour, "minute": minute})
    if closed:
        rows = cut_lineage(with_running(
            rows, ["tenant", "component"], hour, ["starts_at", "closing", "alert_id"], F.col("closing").cast("int"), "closings",
            before=True))
    else:
        rows = rows.withColumn("closings", F.lit(0))
    ends = rows.where("closing")
    rows = rows.where(~F.col("closing"))
    key = ["tenant", "dedup_key"]
    here = F.struct("starts_at", "alert_id")
    span = [*key, "hour", "closings"]
    hours = rows.groupBy(*span).agg(
        F.min(here).alias("first"), F.max("starts_at").alias("last")
    )
    by_hour = Window.partitionBy(*key).orderBy("hour", "closings")
    silence = F.unix_micros("first.starts_at") - F.unix_micros(F.lag("last").over(by_hour))
    parted = F.col("closings") != F.lag("closings").over(by_hour)
    opens = F.coalesce((silence > close_after_s * 1_000_000) | parted, F.lit(True))
    runs = (
        hours.withColumn("opens", opens)
        .withColumn("run", F.last(F.when(F.col("opens"), F.col("first.alert_id")), True).over(by_hour))
        .select(*span, "run")
    )
    marked = rows.join(runs, span).withColumn(
        "may_open", (F.col("alert_id") == F.col("run")).cast("int")
    )
    if closed:
        marked = marked.unionByName(ends.withColumn("may_open", F.lit(1)), allowMissingColumns=True)
    cell = ["tenant", "component", "minute"]
    in_cell = (
        Window.partitionBy(*cell).orderBy("starts_at", "closing", "alert_id")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    kind = ["dedup_key", "service", "severity_rank", "labels", "closing"]
    by_minute = cut_lineage(
        marked.withColumn("turn", F.sum("may_open").over(in_cell))
        .groupBy(*cell, "turn", *kind)
        .agg(F.min(here).alias("first"), F.max("starts_at").alias("last_at"))
    )
    earlier = (
        Window.partitionBy("tenant", "component").orderBy("minute")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = by_minute.groupBy(*cell).agg(F.max("turn").alias("n")).select(
        *cell, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset")
    )
    steps = (
        by_minute.join(offsets, cell)
        .groupBy("tenant", "component", (F.col("offset") + F.col("turn")).alias("turn"), *kind)
        .agg(F.min("first").alias("first"), F.max("last_at").alias("last_at"))
        .select(
            "tenant", "component", *kind, F.col("first.alert_id").alias("first_id"),
            F.col("first.starts_at").alias("first_at"), "last_at",
            F.col("first.starts_at").alias("taken_at"),
        )
    )
    return rows, runs, steps


def _correlate_reduced(rows, edges, declared, window_s, threshold, close_after_s, closed):
    rows, runs, steps = _reduced(rows, close_after_s, closed)
    steps = _with_island(steps, window_s, threshold, close_after_s)
    decisions = _decide(steps, edges, declared, window_s, threshold, close_after_s, True)
    starts = runs.select("tenant", F.col("run").alias("alert_id")).distinct()
    led = _with_epoch(decisions, starts).select(
        F.col("alert_id").alias("run"), "incident_id", "epoch",
        F.struct("kind", "score", "reasons").alias("decided"),
    )
    placed = runs.join(led, "run")
    own = F.col("alert_id") == F.col("run")
    return rows.join(placed, ["tenant", "dedup_key", "hour", "closings"]).select(
        "alert_id", "tenant", "dedup_key", "incident_id", "epoch",
        F.when(own, F.col("decided.kind")).otherwise("attached").alias("kind"),
        F.when(own, F.col("decided.score")).alias("score"),
        F.when(own, F.col("decided.reasons")).alias("reasons"),
    )


def _with_island(steps, window_s, threshold, close_after_s):
    """Adds `island`: rows in different islands cannot influence each other.

    A component's time line is cut at every silence longer than the closing time,
    and inside such a stretch wherever a gap is wider than the time bound and no
    key has alerts on both sides. Both cuts are found on one row per minute.
    """
    base = ["tenant", "component"]
    if threshold <= 0.6:
        return steps.withColumn("island", F.concat_ws("|", *base))
    slack = window_s * (1 - (threshold - 0.6) / 0.4) + 1
    micros = lambda start, end: F.unix_micros(end) - F.unix_micros(start)
    steps = steps.withColumn("minute", time_cell(F.col("first_at"), MINUTE))
    busy = steps.groupBy(*base, "minute", "dedup_key").agg(
        F.min("first_at").alias("lo"), F.max("last_at").alias("hi")
    )
    earlier = lambda keys: (
        Window.partitionBy(*keys).orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)
    )
    numbered = lambda keys, flag: F.sum(F.coalesce(flag, F.lit(True)).cast("int")).over(
        Window.partitionBy(*keys).orderBy("minute")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    silent = micros(F.max("hi").over(earlier(base)), F.col("lo")) > close_after_s * 1_000_000
    stretches = (
        busy.groupBy(*base, "minute").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .withColumn("silent", silent)
        .select(*base, "minute", numbered(base, F.col("silent")).alias("stretch"))
    )
    part = [*base, "stretch"]
    again = F.lead("lo").over(Window.partitionBy(*part, "dedup_key").orderBy("minute"))
    apart = micros(F.max("reach").over(earlier(part)), F.col("lo")) > int(slack * 1_000_000)
    islands = (
        busy.join(stretches, [*base, "minute"])
        .withColumn("reach", F.greatest("hi", again))
        .groupBy(*part, "minute")
        .agg(F.min("lo").alias("lo"), F.max("reach").alias("reach"))
        .withColumn("apart", apart)
        .withColumn("number", numbered(part, F.col("apart")))
        .select(
            *base, "minute",
            F.concat_ws("|", *base, F.col("stretch").cast("string"), F.col("number").cast("string"))
            .alias("island"),
        )
    )
    return steps.join(islands, [*base, "minute"]).drop("minute")


def _ordered(steps, edges, declared):
    """Each island's rows together and in order, with the neighbours of their service."""
    return (
        steps.join(neighbours(edges, declared), "service", "left")
        .repartition("island")
        .sortWithinPartitions("island", "taken_at", "closing", "first_id")
        .drop("taken_at")
    )


def _decide(steps, edges, declared, window_s, threshold, close_after_s, in_time_order):
    """Runs the ordered loop over each island's rows and returns one decision per row."""
    loop = Loop(window_s, threshold, close_after_s, in_time_order)
    return cut_lineage(_ordered(steps, edges, declared).mapInPandas(loop.run, DECISION_DDL))


def typed_rows(batch: pd.DataFrame):
    """Rows with neighbour sets and missing services as None."""
    batch["near"] = [None if v is None else frozenset(v) for v in batch["near"]]
    batch["service"] = [v if isinstance(v, str) else None for v in batch["service"]]
    return batch.itertuples(index=False)


def decisions(rows: list) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[part.split()[0] for part in DECISION_DDL.split(", ")])


class Incident:
    __slots__ = ("id", "rank", "lo", "hi", "services", "labels", "closed")

    def __init__(self, row):
        self.id, self.rank, self.closed = int(row.first_id), row.severity_rank, False
        self.lo = self.hi = row.first_at
        self.services, self.labels = {}, {}
        self.absorb(row)

    def plain(self):
        return tuple(getattr(self, name) for name in self.__slots__)

    @classmethod
    def of(cls, plain):
        incident = cls.__new__(cls)
        for name, value in zip(cls.__slots__, plain):
            setattr(incident, name, value)
        return incident

    def absorb(self, row):
        self.lo, self.hi = min(self.lo, row.first_at), max(self.hi, row.last_at)
        self.rank = max(self.rank, row.severity_rank)
        if row.service is not None:
            self.services[row.service] = row.near
        for name, value in row.labels.items():
            if value is not None:
                self.labels.setdefault(name, value)


class Loop:
    """Sequential part of the job: sees rows of one island after another, in order."""

    def __init__(self, window_s, threshold, close_after_s, in_time_order):
        self.window, self.threshold = window_s, threshold
        self.close_after, self.in_time_order = timedelta(seconds=close_after_s), in_time_order

    def run(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        island, holders, opened = None, {}, []
        for batch in batches:
            out = []
            for row in typed_rows(batch):
                if row.island != island:
                    island, holders, opened = row.island, {}, []
                if self.in_time_order:
                    self.forget(holders, opened, row)
                decision = self.step(holders, opened, row)
                if decision is not None:
                    out.append(decision)
            yield decisions(out)

    def step(self, holders: dict, opened: list, row):
        """Takes one row into the open incidents; returns its decision, None for a closure."""
        holder = holders.get(row.dedup_key)
        if row.closing:
            if holder is not None:
                holder.closed = True
            return None
        kind, score, why = "attached", None, None
        if holder is None or self.ended(holder, row):
            holder, score, why = self.best(opened, row)
            kind = "merged"
            if holder is None:
                kind, score, why = "new", None, None
                holder = Incident(row)
                opened.append(holder)
            holders[row.dedup_key] = holder
        holder.absorb(row)
        return row.first_id, row.dedup_key, holder.id, row.first_at, kind, score, why

    def forget(self, holders, opened, row):
        """Drops ended incidents before a row that may open one; rows come in time order."""
        holder = holders.get(row.dedup_key)
        if holder is None or self.ended(holder, row):
            opened[:] = [i for i in opened if not self.ended(i, row)]
            if len(holders) > 1000 + 4 * len(opened):
                for key in [k for k, i in holders.items() if self.ended(i, row)]:
                    del holders[key]

    def ended(self, incident, row):
        return incident.closed or row.first_at - incident.hi > self.close_after

    def best(self, opened, row):
        """Best-scoring incident at or above the threshold; the earlier one wins a tie."""
        found, top, reasons = None, 0.0, None
        for incident in opened:
            if incident.rank < row.severity_rank or self.ended(incident, row):
                continue
            score, why = self.score(incident, row)
            if score >= self.threshold and score > top:
                found, top, reasons = incident, score, why
        return found, top, reasons

    def score(self, incident, row):
        score, why, at = 0.0, [], row.first_at
        away = 0.0
        if not incident.lo <= at <= incident.hi:
            away = min(abs((at - end).total_seconds()) for end in (incident.lo, incident.hi))
        if away <= self.window:
            score += TIME_WEIGHT * (1 - away / self.window)
            place = f"{int(away)}s from" if away else "within"
            why.append(f"{place} the incident window")
        nearest = min(_reachable(row.service, row.near, incident.services), default=None)
        if nearest is not None:
            score += TOPOLOGY_WEIGHT * (1 - nearest[0] / 3)
            why.append(f"{nearest[0]} hop(s) from {nearest[1]}")
        mine = {(k, v) for k, v in row.labels.items() if v is not None}
        theirs = set(incident.labels.items())
        shared = len(mine & theirs)
        if shared:
            overlap = shared / len(mine | theirs)
            score += LABEL_WEIGHT * overlap
            why.append(f"label overlap {overlap:.2f}")
        return score, why


def _reachable(service, near, others):
    """(hops, service) for every service of the incident at most two hops away."""
    if near is None:
        return
    for other, beside in others.items():
        if beside is None:
            continue
        if other == service:
            yield 0, other
        elif other in near:
            yield 1, other
        elif near & beside:
            yield 2, other


def _with_epoch(decisions: DataFrame, tenants: DataFrame) -> DataFrame:
    """Adds `epoch`: how many incidents the opening alert's key had opened before.

    `tenants` (alert_id, tenant) also restricts the decisions to its alerts.
    """
    decisions = decisions.join(tenants, "alert_id")
    by_key = Window.partitionBy("tenant", "dedup_key").orderBy("decided_at", "alert_id")
    opened = decisions.where(F.col("kind") == "new").select(
        "incident_id", (F.row_number().over(by_key) - 1).alias("epoch")
    )
    return decisions.join(opened, "incident_id", "left").drop("decided_at")


def incidents_of(assigned: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row per incident with its extent, services and alert count."""
    facts = alerts.select(
        F.col("id").alias("alert_id"), "service", "severity_rank", "starts_at"
    )
    return assigned.join(facts, "alert_id").groupBy("incident_id").agg(
        F.count("*").alias("correlated_alert_count"), F.min("starts_at").alias("detected_at"),
        F.max("starts_at").alias("last_alert_at"), F.max("severity_rank").alias("severity_rank"),
        F.countDistinct("service").alias("services"),
        F.max("epoch").alias("dedup_epoch"),
    )


def root_signals(assigned: DataFrame, alerts: DataFrame, edges: DataFrame) -> DataFrame:
    """The alert each incident started from: deepest service first, then earliest."""
    depth = depths(edges)
    facts = alerts.select(F.col("id").alias("alert_id"), "service", "alertname", "fingerprint", "starts_at")
    ranked = assigned.select("alert_id", "incident_id").join(facts, "alert_id").join(
        depth, "service", "left"
    )
    order = F.struct(-F.coalesce("depth", F.lit(0)), "starts_at", "alert_id")
    chosen = F.struct("alert_id", "alertname", "service", "fingerprint", "starts_at")
    return ranked.groupBy("incident_id").agg(F.min_by(chosen, order).alias("root")).select(
        "incident_id", "root.*"
    )


def storm_flags(
    assigned: DataFrame, alerts: DataFrame, threshold: int = STORM_THRESHOLD
) -> DataFrame:
    """Running alert count per incident, whether it is a storm, and its banner number."""
    timed = assigned.select("alert_id", "incident_id").join(
        alerts.select(F.col("id").alias("alert_id"), "starts_at"), "alert_id"
    )
    counted = with_running(
        timed, ["incident_id"], time_cell(F.col("starts_at"), HOUR), ["starts_at", "alert_id"],
        F.lit(1), "running",
    )
    storm = F.col("running") > threshold
    return counted.withColumns(
        {"is_storm": storm, "banner": F.when(storm, F.floor(F.col("running") / 5))}
    )


def sweep(
    alerts: DataFrame, edges: DataFrame, settings: list[tuple[int, float]], *, close_after_s: int = CLOSE_AFTER_S,
    closures: DataFrame | None = None, order: str | None = None, tenant: str | None = None,
    declared: DataFrame | None = None,
) -> DataFrame:
    """Incidents and merges under each (window_s, threshold), on the same alerts.

    Components, reduction and islands are made once, the islands for the setting that
    reaches farthest, and one pass over an island's rows runs the loops of all settings
    side by side. Thresholds of 0.6 or less have one island per tenant and a pass of their own.
    """
    scoped = _scoped(alerts, closures, order, tenant)
    count = scoped.where(~F.col("closing")).agg(F.count("*").alias("alerts"))
    totals = None
    for bounded in (True, False):
        chosen = list(dict.fromkeys(s for s in settings if (s[1] > 0.6) == bounded))
        if not chosen:
            continue
        reach = max(chosen, key=lambda s: s[0] * (1 - (s[1] - 0.6) / 0.4))
        rows = _with_component(scoped, edges, declared, reach[1])
        if order is None and close_after_s >= HOUR:
            steps = _with_island(_reduced(rows, close_after_s, closures is not None)[2], *reach, close_after_s)
        else:
            steps = _with_slack(_plain_steps(rows), *reach, close_after_s, order)
        loops = [Loop(window_s, threshold, close_after_s, order is None) for window_s, threshold in chosen]
        names = _named_settings(alerts.sparkSession, chosen)
        found = _ordered(steps, edges, declared).mapInPandas(
            lambda batches, loops=loops: run_beside(loops, batches), "setting int, incidents long, merges long"
        ).groupBy("setting").agg(F.sum("incidents").alias("incidents"), F.sum("merges").alias("merges"))
        one = names.join(found, "setting", "left").select(
            "window_s", "threshold", F.coalesce("incidents", F.lit(0).cast("long")).alias("incidents"),
            F.coalesce("merges", F.lit(0).cast("long")).alias("merges"))
        totals = one if totals is None else totals.unionByName(one)
    return totals.withColumn("alerts", count.scalar()).select("window_s", "threshold", "alerts", "incidents", "merges")


def _named_settings(spark: SparkSession, settings: list[tuple[int, float]]) -> DataFrame:
    rows = [(n, int(w), float(t)) for n, (w, t) in enumerate(settings)]
    return spark.createDataFrame(rows, "setting int, window_s int, threshold double")


def run_beside(loops: list, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How many incidents each loop opens and how often it merges, over the same rows."""
    kinds = [Counter() for _ in loops]
    island, states = None, []
    for batch in batches:
        for row in typed_rows(batch):
            if row.island != island:
                island, states = row.island, [({}, []) for _ in loops]
            for loop, (holders, opened), seen in zip(loops, states, kinds):
                if loop.in_time_order:
                    loop.forget(holders, opened, row)
                decision = loop.step(holders, opened, row)
                if decision is not None:
                    seen[decision[4]] += 1
    yield pd.DataFrame({
        "setting": range(len(loops)), "incidents": [k["new"] for k in kinds], "merges": [k["merged"] for k in kinds]})


def island_sizes(
    alerts: DataFrame, edges: DataFrame, window_s: int = CORRELATION_WINDOW_S,
    threshold: float = MERGE_THRESHOLD, close_after_s: int = CLOSE_AFTER_S,
) -> DataFrame:
    """Alerts per island: the largest is the longest sequential piece of the job."""
    rows = alerts.select(
        F.lit("").alias("tenant"), "dedup_key", "service", F.col("starts_at").alias("first_at"),
        F.col("starts_at").alias("last_at"),
    )
    placed = _with_component(rows, edges, None, threshold)
    return _with_island(placed, window_s, threshold, close_after_s).groupBy("island").agg(
        F.count("*").alias("alerts")
    )


def correlation_feedback(splits: DataFrame, assigned: DataFrame) -> DataFrame:
    """Human splits with the score and reasons the merge was made on."""
    made = assigned.select(
        "alert_id", F.col("score").alias("original_score"), F.col("reasons").alias("original_reasons")
    )
    return splits.join(made, "alert_id", "left").select(
        "incident_id", "alert_id", F.coalesce("action", F.lit("split")).alias("action"), "actor",
        "original_score", F.coalesce("original_reasons", F.array().cast("array<string>"))
        .alias("original_reasons"),
    )


def feedback_by_reason(feedback: DataFrame) -> DataFrame:
    """How the disputed merges scored, per kind of reason."""
    reason = F.explode("original_reasons")
    kind = (
        F.when(F.col("reason").contains("incident window"), "time")
        .when(F.col("reason").contains("hop(s)"), "topology").otherwise("labels")
    )
    return feedback.select("original_score", reason.alias("reason")).groupBy(
        kind.alias("reason")
    ).agg(F.count("*").alias("splits"), F.avg("original_score").alias("mean_score"))
