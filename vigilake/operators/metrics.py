"""Metric series: increments, trailing rates, histograms, alert states and impact."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilake.functions.intervals import cover_runs, meet_runs, sums_per_run
from vigilake.functions.labels import series_key
from vigilake.functions.skew import time_cell, with_previous
from vigilake.functions.times import as_of_literal, interval, seconds_between, window_minutes

DAY = 86_400
INFINITE = float("inf")


def with_series(samples: DataFrame) -> DataFrame:
    return samples.withColumn("series", series_key(F.col("name"), F.col("labels")))


def instant_values(samples: DataFrame, at, lookback_min: int = 5) -> DataFrame:
    """Latest value of each series in the lookback before `at`; no sample, no row."""
    now = as_of_literal(at)
    recent = samples.where((F.col("time") <= now) & (F.col("time") > now - interval(lookback_min, "MINUTE")))
    return recent.groupBy("series").agg(F.max_by("value", "time").alias("value"))


def range_values(samples: DataFrame, start, end) -> DataFrame:
    return samples.where(F.col("time").between(as_of_literal(start), as_of_literal(end)))


def increments(samples: DataFrame, keys: Sequence[str] = ("series",), tie: Sequence[str] = ()):
    """Counter growth at each sample: the difference, or the value itself after a reset.

    The first sample of a series has grown by nothing known. Unlike the
    reference monitoring language, nothing is extrapolated to window edges.
    """
    cell = time_cell(F.col("time"), DAY)
    seen = with_previous(samples, list(keys), cell, ["time", *tie], ["value"], "_prev")
    last, value = F.col("_prev.value"), F.col("value")
    grown = F.when(last.isNull(), 0.0).when(value < last, value).otherwise(value - last)
    return seen.withColumn("increase", grown).drop("_prev")


def trailing_increase(
    grown: DataFrame, by: Sequence[str], measures: Mapping[str, Column],
    windows_s: Mapping[str, int], step_s: int = 30,
) -> DataFrame:
    """Sums of each measure over trailing windows at every evaluation step with samples.

    Series are first summed into steps with map-side combining; the window then
    runs over at most one row per step and group. A window covers `(at - w, at]`.
    """
    at = (F.ceil(F.unix_micros("time") / F.lit(step_s * 1_000_000)) * step_s).alias("at")
    stepped = grown.groupBy(*by, at).agg(*[F.sum(m).alias(n) for n, m in measures.items()])
    columns = []
    for label, width in windows_s.items():
        trailing = Window.partitionBy(*by).orderBy("at").rangeBetween(-(width - step_s), 0)
        columns += [F.sum(n).over(trailing).alias(f"{n}_{label}") for n in measures]
    return stepped.select(*by, F.timestamp_seconds("at").alias("at"), *columns)


def ratio(part: Column, whole: Column, width_s: int) -> Column:
    """Quotient of two rates whose denominator is kept away from zero."""
    return (part / width_s) / F.greatest(whole / width_s, F.lit(1e-9))


BURN_WINDOWS = {"5m": 300, "30m": 1800, "1h": 3600, "6h": 21_600}


def error_ratios(grown: DataFrame, by: Sequence[str], failed: Column, step_s: int = 30):
    """Error ratio per burn-rate window at each step."""
    sums = trailing_increase(
        grown, by, {"bad": F.when(failed, F.col("increase")).otherwise(0.0), "all": F.col("increase")},
        BURN_WINDOWS, step_s,
    )
    return sums.select(
        *by, "at",
        *[ratio(F.col(f"bad_{w}"), F.col(f"all_{w}"), s).alias(f"ratio_{w}")
          for w, s in BURN_WINDOWS.items()],
    )


def held_for(
    series: DataFrame, by: Sequence[str], flag: str, minutes: int | Column, name: str, cell_s: int = DAY,
):
    """Adds `name`: the flag has been true at every step for at least `minutes`; NULL is false.

    A series is cut into cells of time. Inside a cell runs are found as usual; a run that
    comes in from earlier cells is known from one summary row per cell (does a run reach its
    end, since when, is it on throughout), which combine in any grouping. So a busy series is
    many units of work, and what is ordered per series is its cells.
    """
    here = [*by, "_cell"]
    order = ["at", "_on"]
    so_far = Window.partitionBy(*here).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = Window.partitionBy(*here, "_offs").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    celled = (
        series.withColumns({"_cell": time_cell(F.col("at"), cell_s), "_on": F.coalesce(F.col(flag), F.lit(False))})
        .withColumn("_offs", F.count_if(~F.col("_on")).over(so_far))
        .withColumn("_since", F.min(F.when(F.col("_on"), F.col("at"))).over(run))
    )
    ends = celled.groupBy(*here).agg(
        F.bool_and("_on").alias("_all"), F.max_by(F.when(F.col("_on"), F.col("_since")), F.struct(*order)).alias("_tail")
    )
    cells = Window.partitionBy(*by).orderBy("_cell")
    through = cells.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # a stretch: a cell with a break and the unbroken ones after it
    stretch = Window.partitionBy(*by, "_stretch").orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = (
        ends.withColumn("_stretch", F.count_if(~F.col("_all")).over(through))
        .withColumn("_end", F.min("_tail").over(stretch))
        .withColumn("_carry", F.lag("_end").over(cells))
        .where(F.col("_carry").isNotNull())
        .select(*[F.col(c).alias(f"_k{n}") for n, c in enumerate(here)], "_carry")
    )
    same = F.lit(True)
    for n, c in enumerate(here):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{n}"))
    since = F.when(F.col("_offs") == 0, F.coalesce("_carry", "_since")).otherwise(F.col("_since"))
    held = F.col("_on") & (seconds_between(since, F.col("at")) >= minutes * 60)
    return celled.join(carried, same, "left").withColumn(name, held).select(*series.columns, name)


def burn_alerts(ratios: DataFrame, by: Sequence[str], objective: float = 0.001) -> DataFrame:
    """Fast and slow burn alerts over two windows each, with their holding times."""
    fast, slow = F.lit(14.4 * objective), F.lit(6 * objective)
    flagged = ratios.withColumns(
        {
            "fast": (F.col("ratio_1h") > fast) & (F.col("ratio_5m") > fast),
            "slow": (F.col("ratio_6h") > slow) & (F.col("ratio_30m") > slow),
        }
    )
    held = held_for(flagged, by, "fast", 2, "fast_burn_firing")
    return held_for(held, by, "slow", 15, "slow_burn_firing").drop("fast", "slow")


def delivery_fast_burn(ratios: DataFrame, by: Sequence[str], objective: float = 0.005):
    """Document delivery alert: the hourly and the six-hourly burn together, for ten minutes."""
    both = (F.col("ratio_1h") > 14.4 * objective) & (F.col("ratio_6h") > 6 * objective)
    return held_for(ratios.withColumn("_both", both), by, "_both", 10, "firing").drop("_both")


# Scalar objectives (alert, series, comparison, threshold, minutes held).
SCALAR_ALERTS = (
    ("ingest_latency", "webhook_latency_p99_5m", ">", 0.25, 10),
    ("citation_coverage", "citation_coverage", "<", 1.0, 1),
    ("validation_rejections", "validation_failures_rate30m", ">", 0.05, 15),
    ("everything_is_a_skeleton", "skeleton_ratio_1h", ">", 0.5, 20),
    ("degradation_elevated", "degradation_level", ">=", 2.0, 5),
    ("degradation_degraded", "degradation_level", "==", 1.0, 30),
    ("budget_tripping", "budget_trips_increase1h", ">", 3.0, 5),
    ("cost_per_incident", "cost_per_incident_24h", ">", 0.50, 60),
    ("transcript_completeness", "transcript_completeness", "<", 0.9999, 15),
    ("history_off_reconciler", "history_calls_increase10m", ">", 0.0, 1),
    ("service_down", "up", "==", 0.0, 1),
    ("stream_backlog", "stream_pending", ">", 1000.0, 10),
)


def scalar_alerts(series: DataFrame, by: Sequence[str] = (), rules=SCALAR_ALERTS) -> DataFrame:
    """Threshold alerts over (name, at, value, *by); an unmeasured value never fires.

    The series is read once: a row meets all rules of its name, and one window per
    (alert, series) looks how long each has held.
    """
    value = F.col("value")
    usable = value.isNotNull() & ~F.isnan(value)
    tests = {">": lambda v, t: v > t, "<": lambda v, t: v < t, ">=": lambda v, t: v >= t,
             "==": lambda v, t: v == t}
    of_name: dict[str, list[Column]] = {}
    for alert, name, comparison, threshold, minutes in rules:
        of_name.setdefault(name, []).append(F.struct(
            F.lit(alert).alias("alert"), F.lit(minutes).alias("minutes"),
            (usable & tests[comparison](value, F.lit(threshold))).alias("hit"),
        ))
    own = F.when(F.lit(False), F.array(*next(iter(of_name.values()))))
    for name, own_rules in of_name.items():
        own = own.when(F.col("name") == name, F.array(*own_rules))
    tested = series.where(F.col("name").isin(*of_name)).select(*by, "at", "value", F.explode(own).alias("_rule")).select(
        *by, "at", "value", "_rule.*"
    )
    return held_for(tested, ["alert", *by], "hit", F.col("minutes"), "firing").select(
        "alert", *by, "at", "value", "firing"
    )


def histogram_counts(
    rows: DataFrame, value: str, bounds: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """Cumulative bucket counts per group, the unbounded bucket included, in one pass."""
    edges = [*bounds, INFINITE]
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by).agg(
        *[F.count_if(F.col(value) <= F.lit(le)).alias(f"_{i}") for i, le in enumerate(edges)]
    )
    buckets = F.array(
        *[F.struct(F.lit(le).alias("le"), F.col(f"_{i}").alias("count")) for i, le in enumerate(edges)]
    )
    return counted.select(*by, F.explode(buckets).alias("b")).select(*by, "b.le", "b.count")


def histogram_quantile(
    buckets: DataFrame, q: float, by: Sequence[str] = (), count: str = "count"
) -> DataFrame:
    """Quantile by linear interpolation inside the bucket that holds the rank.

    `by` groups have one row per bound. A rank in the unbounded bucket gives the
    highest finite bound; a group without observations gives NULL.
    """
    keys = list(by)
    if not keys:
        return histogram_quantile(buckets.withColumn("_g", F.lit(1)), q, ["_g"], count).drop("_g")
    order = Window.partitionBy(*keys).orderBy("le")
    total = F.max(F.when(F.col("le") == INFINITE, F.col(count))).over(Window.partitionBy(*keys))
    finite = F.max(F.when(F.col("le") < INFINITE, F.col("le"))).over(Window.partitionBy(*keys))
    placed = buckets.withColumns(
        {
            "_total": total, "_finite": finite,
            "_below": F.coalesce(F.lag(count).over(order), F.lit(0)),
            "_low": F.lag("le").over(order),
        }
    ).withColumn("_rank", F.lit(q) * F.col("_total"))
    low = F.coalesce("_low", F.when(F.col("le") > 0, 0.0).otherwise(F.col("le")))
    share = (F.col("_rank") - F.col("_below")) / F.nullif(F.col(count) - F.col("_below"), F.lit(0))
    value = F.when(F.col("le") == INFINITE, F.col("_finite")).otherwise(
        low + (F.col("le") - low) * F.coalesce(share, F.lit(0.0))
    )
    hit = (F.col("_total") > 0) & (F.col(count) >= F.col("_rank"))
    return placed.groupBy(*keys).agg(
        F.min_by(F.when(hit, value), F.when(hit, F.col("le"))).alias("value")
    )


def time_to_war_room(incidents: DataFrame, channels: DataFrame) -> DataFrame:
    """Seconds from detection to the incident's first channel; the start of a timing report."""
    first = channels.groupBy("incident_id").agg(F.min("created_at").alias("_opened"))
    return incidents.join(first, F.col("id") == F.col("incident_id")).select(
        "id", seconds_between(F.col("detected_at"), F.col("_opened")).alias("seconds")
    )


# Query templates of the impact report; their text makes the citation id.
IMPACT_QUERIES = {
    "failed_requests": 'sum(increase(http_requests_total{service="%s",status=~"5.."}[%s]))',
    "total_requests": 'sum(increase(http_requests_total{service="%s"}[%s]))',
    "p99_latency_ms": (
        "histogram_quantile(0.99, sum by (le) "
        '(rate(http_request_duration_seconds_bucket{service="%s"}[%s]))) * 1000'
    ),
    "pods_unready": 'count(kube_pod_status_ready{condition="false",namespace="%s"})',
}


def impact(
    incidents: DataFrame, samples: DataFrame, as_of, failures: DataFrame | None = None
) -> DataFrame:
    """Failed and total requests, p99 latency, unready pods and error rate per incident.

    `incidents` has id, service, namespace, detected_at, resolved_at; `samples`
    has time, name, labels, value. A series' growth is summed per service and
    cell of several sizes; an incident's window is covered by runs of such cells
    and reads their sums only. A recorded query failure (incident_id,
    reason) makes the whole report unavailable.
    """
    span = incidents.select(
        F.col("id").alias("incident_id"), F.coalesce("service", F.lit("unknown")).alias("service"),
        F.coalesce("namespace", F.lit("default")).alias("namespace"), "detected_at",
        F.coalesce("resolved_at", as_of_literal(as_of)).alias("end_at"),
    ).withColumn("minutes", window_minutes(F.col("detected_at"), F.col("end_at")))
    start = F.timestamp_micros(F.unix_micros("end_at") - F.col("minutes").cast("bigint") * 60_000_000)
    span = span.withColumn("start_at", start)

    named = with_series(samples.where(F.col("name").isin(
        "http_requests_total", "http_request_duration_seconds_bucket")))
    grown = increments(named).select(
        "time", "increase", F.col("labels")["service"].alias("service"),
        F.when(F.col("name") == "http_requests_total",
               F.when(F.col("labels")["status"].rlike("^5..$"), "failed").otherwise("passed"))
        .otherwise("bucket").alias("measure"),
        F.when(F.col("labels")["le"] == "+Inf", INFINITE)
        .otherwise(F.col("labels")["le"].cast("double")).alias("le"),
        F.unix_micros("time").alias("_us"),
    )
    summed = sums_per_run(grown, "_us", ["service", "measure", "le"], "increase")
    runs = cover_runs(span.select("incident_id", "service", "start_at", "end_at"),
                      F.unix_micros("start_at") + 1, F.unix_micros("end_at")).drop("start_at", "end_at")
    growth = meet_runs(runs, summed, ["service"]).groupBy("incident_id", "measure", "le").agg(
        F.sum("increase").alias("increase")
    )
    counts = growth.where(F.col("measure") != "bucket").groupBy("incident_id").agg(
        F.sum(F.when(F.col("measure") == "failed", F.col("increase"))).alias("failed_requests"),
        F.sum("increase").alias("total_requests"),
    )
    p99 = histogram_quantile(
        growth.where(F.col("measure") == "bucket"), 0.99, ["incident_id"], "increase"
    ).select("incident_id", (F.col("value") * 1000).alias("p99_latency_ms"))
    pods = _unready(span, samples)
    report = (
        span.join(counts, "incident_id", "left").join(p99, "incident_id", "left")
        .join(pods, "incident_id", "left")
        .withColumn(
            "error_rate_pct",
            F.when(F.col("total_requests") > 0,
                   F.bround(F.col("failed_requests") / F.col("total_requests") * 100, 2)),
        )
        .withColumns({"status": F.lit("computed"), "reason": F.lit(None).cast("string")})
    )
    if failures is None:
        return report
    why = failures.groupBy("incident_id").agg(F.min("reason").alias("_why"))
    gone = F.col("_why").isNotNull()
    values = (*IMPACT_QUERIES, "error_rate_pct")
    return report.join(why, "incident_id", "left").withColumns(
        {
            **{name: F.when(~gone, F.col(name)) for name in values},
            "status": F.when(gone, "unavailable").otherwise("computed"), "reason": F.col("_why"),
        }
    ).drop("_why")


def _unready(span: DataFrame, samples: DataFrame, lookback_min: int = 5) -> DataFrame:
    """How many unready-pod series were reporting when the window ended."""
    minute = 60
    reported = samples.where(
        (F.col("name") == "kube_pod_status_ready") & (F.col("labels")["condition"] == "false")
    )
    pods = with_series(reported).select(
        "series", F.col("labels")["namespace"].alias("namespace"), "time",
        time_cell(F.col("time"), minute).alias("minute"),
    )
    end = time_cell(F.col("end_at"), minute)
    minutes = span.withColumn("minute", F.explode(F.sequence(end - lookback_min, end)))
    seen = minutes.join(pods, ["namespace", "minute"]).where(
        (F.col("time") <= F.col("end_at"))
        & (F.col("time") > F.col("end_at") - interval(lookback_min, "MINUTE"))
    )
    return seen.groupBy("incident_id").agg(F.countDistinct("series").alias("pods_unready"))


def impact_windows(report: DataFrame) -> DataFrame:
    """(incident_id, key, query, value, start_at, end_at) behind an available report."""
    window = F.concat(F.col("minutes").cast("string"), F.lit("m"))
    rows = []
    for key, template in IMPACT_QUERIES.items():
        arguments = [F.col("namespace")] if key == "pods_unready" else [F.col("service"), window]
        rows.append(
            F.struct(
                F.lit(key).alias("key"), F.format_string(template, *arguments).alias("query"),
                F.col(key).cast("double").alias("value"),
            )
        )
    return report.where(F.col("status") == "computed").select(
        "incident_id", F.explode(F.array(*rows)).alias("w"), F.col("detected_at").alias("start_at"),
        "end_at",
    ).select("incident_id", "w.*", "start_at", "end_at")
