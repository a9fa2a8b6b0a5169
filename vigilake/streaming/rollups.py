"""Daily rollups and burn-rate monitoring over streams, in append mode behind a watermark."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from vigilake.operators.metrics import BURN_WINDOWS
from vigilake.streaming.correlate import use_typed_state


def _daily(rows: DataFrame, late: str):
    return rows.withWatermark("time", late)


def incident_daily_stream(timeline: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events and distinct incidents per day and intent: counted per incident, then per day."""
    day = F.window("time", "1 day")
    per_incident = _daily(timeline, late).groupBy(day, "intent", "incident_id").agg(
        F.count("*").alias("n")
    )
    return per_incident.groupBy(F.window("window", "1 day"), "intent").agg(
        F.sum("n").alias("events"), F.count("incident_id").alias("incidents")
    ).select(F.col("window.start").alias("day"), "intent", "events", "incidents")


def llm_cost_daily_stream(calls: DataFrame, late: str = "1 hour") -> DataFrame:
    return _daily(calls, late).groupBy(F.window("time", "1 day"), "role", "model", "prompt_version").agg(
        F.sum("cost_usd").alias("cost"), F.count("*").alias("calls"), F.avg("latency_ms").alias("avg_ms")
    ).select(F.col("window.start").alias("day"), "role", "model", "prompt_version", "cost", "calls", "avg_ms")


def llm_latency_daily_stream(calls: DataFrame, late: str = "1 hour", shards: int = 1) -> DataFrame:
    """Latency sketches per day, role and model as streaming state: a sketch takes rows of any batch.

    A busy group may be dealt over `shards` states; `rollups.latency_quantile` merges the
    sketches of shards and days alike.
    """
    keys = ["role", "model"]
    rows = _daily(calls, late)
    if shards > 1:
        rows = rows.withColumn("shard", F.pmod(F.xxhash64(*calls.columns), F.lit(shards)).cast("int"))
        keys.append("shard")
    return rows.groupBy(F.window("time", "1 day"), *keys).agg(
        F.kll_sketch_agg_double(F.col("latency_ms").cast("double")).alias("latency_sketch"),
        F.count("latency_ms").alias("calls"),
    ).select(F.col("window.start").alias("day"), *keys, "latency_sketch", "calls")


def page_load_daily_stream(pages: DataFrame, late: str = "1 hour") -> DataFrame:
    return _daily(pages, late).groupBy(F.window("time", "1 day"), "responder").agg(
        F.count("*").alias("pages"), F.count_if(F.col("severity") == "sev1").alias("sev1_pages")
    ).select(F.col("window.start").alias("day"), "responder", "pages", "sev1_pages")


class PaneSums(StatefulProcessor):
    """Ratios of every window width from one set of panes, and how long alerts have held.

    State per key: the panes of the widest window, and since when each alert's condition
    has been true. Panes arrive whole and in order, since the watermark has passed them.
    """

    def __init__(self, by: Sequence[str], windows_s: Mapping[str, int], step_s: int, rules: Sequence[tuple]):
        self.by, self.windows, self.step, self.rules = list(by), dict(windows_s), step_s, list(rules)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.panes = handle.getMapState("panes", "at BIGINT", "bad DOUBLE, total DOUBLE")
        self.since = handle.getMapState("since", "alert STRING", "at BIGINT")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values("at_s")
        kept = sorted((at[0], *sums) for at, sums in self.panes.iterator())
        at = np.array([k[0] for k in kept] + new["at_s"].tolist(), dtype=np.int64)
        bad = np.array([k[1] for k in kept] + new["bad"].tolist())
        total = np.array([k[2] for k in kept] + new["total"].tolist())
        fresh = np.arange(len(kept), len(at))
        out = {name: [value] * len(fresh) for name, value in zip(self.by, key)}
        out["at"] = pd.to_datetime(at[fresh], unit="s")
        for label, width in self.windows.items():
            first = np.searchsorted(at, at[fresh] - (width - self.step))
            sums = [np.array([v[a:b + 1].sum() for a, b in zip(first, fresh)]) for v in (bad, total)]
            out[f"ratio_{label}"] = (sums[0] / width) / np.maximum(sums[1] / width, 1e-9)
        for name, long, short, limit, minutes in self.rules:
            on = (out[f"ratio_{long}"] > limit) & (out[f"ratio_{short}"] > limit)
            out[name] = self._held(name, at[fresh], on, minutes * 60)
        oldest = at[-1] - max(self.windows.values())
        for k in kept:
            if k[0] <= oldest:
                self.panes.removeKey((k[0],))
        for n in fresh:
            if at[n] > oldest:
                self.panes.updateValue((int(at[n]),), (float(bad[n]), float(total[n])))
        yield pd.DataFrame(out)

    def _held(self, name: str, at: np.ndarray, on: np.ndarray, least_s: int) -> list[bool]:
        since = self.since.getValue((name,))[0] if self.since.containsKey((name,)) else None
        fires = []
        for when, hit in zip(at.tolist(), on.tolist()):
            since = (when if since is None else since) if hit else None
            fires.append(hit and when - since >= least_s)
        if since is None:
            self.since.removeKey((name,))
        else:
            self.since.updateValue((name,), (since,))
        return fires

    def close(self) -> None:
        pass


def burn_alert_stream(
    grown: DataFrame, by: Sequence[str], failed: Column, objective: float = 0.001,
    windows_s: Mapping[str, int] = BURN_WINDOWS, step_s: int = 30, late: str = "5 minutes",
) -> DataFrame:
    """Error ratios of all burn windows at every step with samples, and the alerts on them.

    The stream twin of `metrics.error_ratios` and `metrics.burn_alerts`; `grown` has time,
    increase and the string columns `by`. Samples are first summed into panes of one step, with map-side
    combining; all widths are then read from the same panes, so a sample counts once
    whatever the widths. A window covers `(at - width, at]`.
    """
    use_typed_state(grown.sparkSession)
    step = F.ceil(F.unix_micros("time") / F.lit(step_s * 1_000_000)) * step_s
    bad = F.sum(F.when(failed, F.col("increase")).otherwise(0.0))
    panes = (
        grown.withColumn("pane", F.timestamp_seconds(step)).withWatermark("pane", late).groupBy(*by, "pane")
        .agg(bad.alias("bad"), F.sum("increase").alias("total"))
        .select(*by, F.unix_seconds("pane").alias("at_s"), "bad", "total")
    )
    rules = [("fast_burn_firing", "1h", "5m", 14.4 * objective, 2), ("slow_burn_firing", "6h", "30m", 6 * objective, 15)]
    schema = ", ".join([
        *[f"{name} STRING" for name in by], "at TIMESTAMP", *[f"ratio_{w} DOUBLE" for w in windows_s],
        *[f"{rule[0]} BOOLEAN" for rule in rules],
    ])
    return panes.groupBy(*by).transformWithStateInPandas(PaneSums(by, windows_s, step_s, rules), schema, "append", "none")
