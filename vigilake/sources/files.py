"""Recordings, runbook files, rating files and graph exports."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, MapType, StringType

from vigilake.constants import FRONT_MATTER_PATTERN, STEP_MARKER_PATTERN
from vigilake.functions.text import strip
from vigilake.functions.times import parse_timestamp
from vigilake.sources.front_matter import NotAMapping, read_front_matter

RECORDING_FORMAT = 1
DEFAULT_START = "2026-09-01 00:00:00"


def read_recordings(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(headers, entries, labels) of incident recordings, one JSON-lines file each.

    A file of another format, or an entry without a kind, fails the job: scoring
    a misread recording would be worse than no score.
    """
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.split("value", r"\r?\n").alias("lines")
    )
    lines = files.select("file", F.posexplode("lines").alias("seq", "line")).where(strip(F.col("line")) != "")
    at = lambda name: F.get_json_object("line", "$." + name)
    first = lines.groupBy("file").agg(F.min_by("line", "seq").alias("line"), F.min("seq").alias("first"))
    supported = F.coalesce(at("format").cast("int") == RECORDING_FORMAT, F.lit(False))
    checked = first.withColumn(
        "recording",
        F.when(supported, F.coalesce(at("incident").cast("bigint"), F.lit(0))).otherwise(
            F.raise_error(F.concat(F.lit("unsupported recording format: "), "file")).cast("bigint")
        ),
    )
    headers = checked.select(
        "recording", F.coalesce(at("bucket"), F.lit("unspecified")).alias("bucket"),
        F.coalesce(at("title"), F.lit("")).alias("title"),
        F.coalesce(parse_timestamp(at("start")), F.lit(DEFAULT_START).cast("timestamp")).alias("start"),
    )
    body = lines.join(checked.select("file", "recording", "first"), "file").where(
        F.col("seq") > F.col("first")
    )
    kind = F.coalesce(at("kind"), F.lit(""))
    kinds = body.withColumn(
        # names `first` so that a filter on the kind cannot be moved before the header is known
        "kind", F.when((kind != "") | (F.col("seq") <= F.col("first")), kind).otherwise(
            F.raise_error(F.concat(F.lit("entry has no kind: "), "file", F.lit(" line "), F.col("seq").cast("string")))
        ),
    )
    truth = F.col("kind") == "ground_truth"
    entries = kinds.where(~truth).select(
        "recording", "seq", F.coalesce(at("t").cast("double"), F.lit(0.0)).alias("t"), "kind",
        F.col("line").alias("body"),
    )
    labels = kinds.where(truth).groupBy("recording").agg(
        F.max_by(at("labels"), F.col("seq")).alias("labels")
    )
    return headers, entries, labels


@F.pandas_udf(BooleanType())
def compiles(patterns: pd.Series) -> pd.Series:
    """Whether each text is a usable regular expression."""

    def usable(pattern):
        try:
            re.compile(pattern)
        except (re.error, TypeError):
            return False
        return True

    return patterns.map(usable)


@F.pandas_udf(MapType(StringType(), StringType()))
def _front_values(heads: pd.Series) -> pd.Series:
    """Values of a file's head by key; null if it is no mapping."""

    def values(head):
        try:
            return read_front_matter(head)
        except NotAMapping:
            return None

    return heads.map(values)


def _meta(name: str) -> Column:
    text = strip(F.col("meta")[name])
    return F.when(~text.isin("", "null", "None"), text)


def read_runbooks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(runbooks, steps, problems) of markdown runbooks with marked steps.

    A file with a problem contributes neither a runbook nor steps.
    """
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("file"), F.col("value").alias("text")
    )
    parsed = files.withColumn("front", F.regexp_extract("text", FRONT_MATTER_PATTERN, 1)).withColumn(
        "body", F.regexp_replace("text", FRONT_MATTER_PATTERN, "")
    ).withColumn("meta", _front_values("front")).select(
        "file", "body", (F.regexp_count("text", F.lit(FRONT_MATTER_PATTERN)) > 0).alias("fronted"),
        F.col("meta").isNotNull().alias("mapped"),
        *[_meta(n).alias(n) for n in ("name", "alert_pattern", "severity_filter", "service_filter")],
        F.coalesce(_meta("version"), F.lit("1.0.0")).alias("version"),
        F.regexp_extract_all("body", F.lit(STEP_MARKER_PATTERN), F.lit(1)).alias("step_ids"),
        F.split("body", STEP_MARKER_PATTERN, -1).alias("pieces"),
    ).withColumn("usable", compiles(F.coalesce("alert_pattern", F.lit("("))))
    problem = (
        F.when(~F.col("fronted"), "no YAML front matter")
        .when(~F.col("mapped"), "front matter is not a mapping")
        .when(F.col("name").isNull(), "front matter has no name")
        .when(F.col("alert_pattern").isNull(), "front matter has no alert_pattern")
        .when(~F.col("usable"), "alert_pattern is not valid regex")
        .when(F.size("step_ids") == 0, "no step markers")
        .when(F.size(F.array_distinct("step_ids")) < F.size("step_ids"), "duplicate step id")
    )
    judged = parsed.withColumn("problem", problem)
    good = judged.where(F.col("problem").isNull())
    runbooks = good.select(
        "file", "name", "alert_pattern", "severity_filter", "service_filter", "version", "step_ids"
    )
    marked = good.select("name", "pieces", F.posexplode("step_ids").alias("position", "step_id"))
    steps = marked.select(
        "name", "step_id", "position", strip(F.get("pieces", F.col("position") + 1)).alias("body")
    ).withColumn("title", _step_title())
    return runbooks, steps, judged.where(F.col("problem").isNotNull()).select("file", "problem")


def _step_title() -> Column:
    """The step's first non-empty line without heading marks, at most 120 characters of prose."""
    first = F.regexp_extract("body", r"(?m)^\s*(\S.*?)\s*$", 1)
    heading = strip(F.regexp_replace(first, r"^#+", ""))
    return F.when(first == "", F.col("step_id")).when(first.startswith("#"), heading).otherwise(
        F.substring(first, 1, 120)
    )


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """(item, dimension, human, judge) from a rating file; dimensions both sides rated."""
    schema = "labels MAP<STRING, STRUCT<human: MAP<STRING,INT>, judge: MAP<STRING,INT>>>"
    rated = spark.read.schema(schema).json(path, multiLine=True)
    pairs = rated.select(F.explode("labels").alias("item", "r")).select(
        "item", "r.judge", F.explode("r.human").alias("dimension", "human")
    )
    return pairs.select("item", "dimension", "human", F.col("judge")[F.col("dimension")].alias("judge")).where(
        F.col("judge").isNotNull()
    )


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """(service, depends_on) from a JSON export `{"services": {name: [dependency, ...]}}`."""
    raw = spark.read.schema("services MAP<STRING, ARRAY<STRING>>").json(path, multiLine=True)
    return raw.select(F.explode("services").alias("service", "needs")).select(
        "service", F.explode("needs").alias("depends_on")
    ).distinct()
