"""Streaming correlation: the batch rule with its open incidents kept as typed state.

State is keyed by component, as in the batch job. A map holds the open incidents, another
one which incident holds a dedup key. An alert of a known key reads and writes two entries;
the component's other incidents are read only if an alert of an unknown key has to be
scored. Rows of one micro-batch are taken in arrival order, and an alert older than others
is scored by its absolute distance. A timer sweeps the component: incidents that nothing
can join any more leave with their keys, and an idle component leaves as a whole.

The stream needs the RocksDB state store (`use_typed_state`).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from vigilake.constants import (
    CLOSE_AFTER_S,
    CORRELATION_WINDOW_S,
    MERGE_THRESHOLD,
    STABLE_LABELS,
)
from vigilake.operators.correlation import DECISION_DDL, Incident, Loop, decisions, typed_rows
from vigilake.operators.graph import components, neighbours

ARRIVAL_SLACK = "1 minute"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
INCIDENT_DDL = (
    "opened_as BIGINT, severity_rank INT, lo BIGINT, hi BIGINT, names ARRAY<STRING>, known ARRAY<BOOLEAN>, "
    "near ARRAY<ARRAY<STRING>>, labels ARRAY<STRING>, held ARRAY<STRING>"
)


def use_typed_state(spark: SparkSession) -> None:
    """Maps and timers per key need this state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _micros(at: pd.Timestamp) -> int:
    return pd.Timestamp(at).value // 1000


class OpenIncidents(StatefulProcessor):
    """The batch job's loop over state: entries are read when the loop asks for them."""

    def __init__(self, loop: Loop, close_after_s: int):
        self.loop, self.close_after_s = loop, close_after_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.incidents = handle.getMapState("incidents", "id BIGINT", INCIDENT_DDL)
        self.holders = handle.getMapState("holders", "dedup_key STRING", "id BIGINT")
        self.clock = handle.getValueState("clock", "opened BIGINT, latest BIGINT, arrived_ms BIGINT")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["taken_at", "first_id"])
        seen = self.clock.get() if self.clock.exists() else (0, None, 0)
        view = _View(self, seen[0])
        out = [self.loop.step(view, view, row) for row in typed_rows(batch)]
        view.write_back({decision[2] for decision in out})
        latest = max(_micros(batch["last_at"].max()), seen[1] if seen[1] is not None else 0)
        arrived = max(int(batch["arrived_at"].max().timestamp() * 1000), seen[2])
        if not self.clock.exists():
            self.handle.registerTimer(arrived + self.close_after_s * 1000)
        self.clock.update((view.opened, latest, arrived))
        yield decisions(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        opened, latest, arrived = self.clock.get()
        due = arrived + self.close_after_s * 1000
        if due <= expiredTimerInfo.getExpiryTimeInMs():
            for state in (self.incidents, self.holders, self.clock):
                state.clear()
        else:
            ended = [
                (number[0], kept[8]) for number, kept in self.incidents.iterator()
                if latest - kept[3] > self.close_after_s * 1_000_000
            ]
            for number, held in ended:
                self.incidents.removeKey((number,))
                for dedup in held:
                    if self.holders.containsKey((dedup,)) and self.holders.getValue((dedup,))[0] == number:
                        self.holders.removeKey((dedup,))
            self.handle.registerTimer(due)
        return iter([])

    def close(self) -> None:
        pass


class _View:
    """One key's state as the loop wants it: a mapping of holders and a sequence of incidents."""

    def __init__(self, state: OpenIncidents, opened: int):
        self.state, self.opened = state, opened
        self.loaded: dict[int, Incident] = {}
        self.order: dict[int, int] = {}
        self.held: dict[int, list[str]] = {}
        self.by_key: dict[str, int | None] = {}
        self.whole = False

    def _take(self, number: int, kept) -> Incident:
        if number not in self.loaded:
            order, rank, lo, hi, names, known, near, labels, held = kept
            services = {n: frozenset(beside) if k else None for n, k, beside in zip(names, known, near)}
            pairs = list(labels)
            self.loaded[number] = Incident.of((
                number, rank, pd.Timestamp(lo, unit="us"), pd.Timestamp(hi, unit="us"), services,
                dict(zip(pairs[::2], pairs[1::2])), False))
            self.order[number], self.held[number] = order, list(held)
        return self.loaded[number]

    def get(self, dedup: str) -> Incident | None:
        if dedup not in self.by_key:
            found = self.state.holders.getValue((dedup,))[0] if self.state.holders.containsKey((dedup,)) else None
            if found is not None and not self.state.incidents.containsKey((found,)):
                found = None
            self.by_key[dedup] = found
        number = self.by_key[dedup]
        if number is None:
            return None
        return self.loaded[number] if number in self.loaded else self._take(number, self.state.incidents.getValue((number,)))

    def __setitem__(self, dedup: str, incident: Incident) -> None:
        self.by_key[dedup] = incident.id
        self.held[incident.id].append(dedup)
        self.state.holders.updateValue((dedup,), (incident.id,))

    def append(self, incident: Incident) -> None:
        self.loaded[incident.id] = incident
        self.order[incident.id], self.held[incident.id] = self.opened, []
        self.opened += 1

    def __iter__(self) -> Iterator[Incident]:
        if not self.whole:
            for number, kept in self.state.incidents.iterator():
                self._take(number[0], kept)
            self.whole = True
        return iter(sorted(self.loaded.values(), key=lambda i: self.order[i.id]))

    def write_back(self, touched: set[int]) -> None:
        for number in touched:
            i = self.loaded[number]
            names = list(i.services)
            self.state.incidents.updateValue((number,), (
                self.order[number], int(i.rank), _micros(i.lo), _micros(i.hi), names,
                [i.services[n] is not None for n in names], [sorted(i.services[n] or ()) for n in names],
                [text for pair in i.labels.items() for text in pair], self.held[number]))


def correlate_stream(
    alerts: DataFrame, edges: DataFrame, *, window_s: int = CORRELATION_WINDOW_S,
    threshold: float = MERGE_THRESHOLD, close_after_s: int = CLOSE_AFTER_S,
    order: str = "starts_at", bridges: DataFrame | None = None,
) -> DataFrame:
    """One decision per arriving alert: alert_id, incident_id, kind, score, reasons.

    `bridges` (service, depends_on) joins components that share dedup keys; in a
    stream such keys are not known beforehand. The watermark follows arrival, not
    the alerts' own time: an alert gets its decision however late it comes, and
    state of a component leaves once no alert of it has arrived for the closing time.
    A component's rows of one micro-batch are sorted in memory, so triggers bound them.
    """
    use_typed_state(alerts.sparkSession)
    links = edges.select("service", "depends_on")
    graph = components(links if bridges is None else links.union(bridges))
    placed = (
        alerts.withColumn("arrived_at", F.current_timestamp()).withWatermark("arrived_at", ARRIVAL_SLACK)
        .join(graph, "service", "left")
        .join(neighbours(edges), "service", "left")
        .select(
            F.coalesce("component", F.concat(F.lit("key:"), "dedup_key")).alias("component"),
            F.col("id").alias("first_id"), "dedup_key", "service", "near",
            F.col("severity_rank").cast("int").alias("severity_rank"),
            F.struct(*[F.col("labels")[n].alias(n) for n in STABLE_LABELS]).alias("labels"),
            F.col("starts_at").alias("first_at"), F.col("starts_at").alias("last_at"),
            F.col(order).alias("taken_at"), F.lit(False).alias("closing"), "arrived_at",
        )
    )
    loop = Loop(window_s, threshold, close_after_s, False)
    return placed.groupBy("component").transformWithStateInPandas(
        OpenIncidents(loop, close_after_s), DECISION_DDL, "append", "eventTime"
    )
