"""What a chat message says is happening: ordered rules, then the nearest example."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from vigilake.constants import (
    EXEMPLAR_MAX_CONFIDENCE,
    EXEMPLAR_THRESHOLD,
    INTENT_RULES,
    SNAPSHOT_INTENTS,
    SUMMARY_CHARS,
)
from vigilake.functions.evidence import timeline_ref
from vigilake.functions.text import exemplar_matrix, lexical_features, strip
from vigilake.functions.times import chat_timestamp

MIN_CHARS = 3


def with_rule_intent(messages: DataFrame, name: str = "rule") -> DataFrame:
    """Adds struct (intent, confidence, summary) from the first rule `text` matches.

    Very short or emoji-only messages are noise for certain; text no rule knows
    is noise with half confidence.
    """
    staged = messages.withColumn("_body", strip(F.coalesce("text", F.lit(""))))
    return staged.withColumn(name, _rule_intent(F.col("_body"))).drop("_body")


def _rule_intent(body: Column) -> Column:
    summary = F.substring(body, 1, SUMMARY_CHARS)
    said = lambda intent, sure, words: F.struct(
        F.lit(intent).alias("intent"), F.lit(sure).alias("confidence"), words.alias("summary")
    )
    chosen = F.when(
        (F.length(body) < MIN_CHARS) | body.startswith(":"), said("noise", 1.0, F.lit(""))
    )
    for intent, pattern, confidence in INTENT_RULES:
        chosen = chosen.when(body.rlike("(?iU)" + pattern), said(intent, confidence, summary))
    return chosen.otherwise(said("noise", 0.5, summary))


@F.pandas_udf(StructType().add("intent", StringType()).add("score", DoubleType()))
def _nearest_exemplar(texts: pd.Series) -> pd.DataFrame:
    """The example phrase closest to each text by cosine of word and trigram counts.

    Stays beside the scan: exploding the features into a join re-groups several
    hundred rows per message and measured several times slower.
    """
    intents, features, weights = exemplar_matrix()

    def nearest(text):
        found, n = lexical_features(text or "")
        place = np.minimum(np.searchsorted(features, found), len(features) - 1)
        known = features[place] == found
        dots = weights[:, place[known]] @ n[known]
        best = int(dots.argmax())
        return (intents[best], dots[best] / np.linalg.norm(n)) if dots[best] > 0.0 else (None, None)

    return pd.DataFrame([nearest(t) for t in texts], columns=["intent", "score"])


# Declared non-deterministic so that a filter on the result is not moved below
# it, which would run it, and the rules feeding it, once more.
nearest_exemplar = _nearest_exemplar.asNondeterministic()


def classify(messages: DataFrame, threshold: float = EXEMPLAR_THRESHOLD) -> DataFrame:
    """Adds `intent`, `confidence` and `summary`; examples only speak where no rule did."""
    ruled = with_rule_intent(messages, "_rule")
    unsure = (F.col("_rule.intent") == "noise") & (F.col("_rule.confidence") < 1.0)
    scored = ruled.withColumn("_near", nearest_exemplar(F.when(unsure, F.col("text"))))
    speaks = unsure & F.coalesce(F.col("_near.score") >= threshold, F.lit(False))
    sure = F.least(F.bround("_near.score", 2), F.lit(EXEMPLAR_MAX_CONFIDENCE))
    return scored.select(
        *messages.columns,
        F.when(speaks, F.col("_near.intent")).otherwise(F.col("_rule.intent")).alias("intent"),
        F.when(speaks, sure).otherwise(F.col("_rule.confidence")).alias("confidence"),
        F.col("_rule.summary").alias("summary"),
    )


def timeline(classified: DataFrame) -> DataFrame:
    """Timeline rows of the messages that say something."""
    return classified.where(F.col("intent") != "noise").select(
        chat_timestamp(F.col("ts")).alias("time"), "incident_id", "intent", "confidence",
        F.col("summary").alias("description"), F.col("user_id").alias("author_user_id"),
        F.col("ts").alias("source_message_ts"),
    )


def snapshot_requests(events: DataFrame) -> DataFrame:
    """Messages that call for a metric snapshot."""
    return events.where(F.col("intent").isin(*SNAPSHOT_INTENTS)).select(
        "incident_id", F.col("intent").alias("reason"), F.col("source_message_ts").alias("at")
    )


def timeline_id(events: DataFrame) -> DataFrame:
    """Timeline rows with the id citations use: epoch second and intent."""
    entry = F.concat_ws("-", F.unix_seconds("time").cast("string"), "intent")
    return events.withColumn("timeline_id", entry).withColumn("ref", timeline_ref(entry))
