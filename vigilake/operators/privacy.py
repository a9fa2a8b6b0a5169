"""Personal data replaced by tokens that stay the same within one incident."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from vigilake.constants import PII_RULES, SECRET_KEYS, SECRET_MASK
from vigilake.functions.skew import with_running
from vigilake.functions.text import is_card_number, is_private_ip
from vigilake.session import cut_lineage

SPAN = (
    StructType().add("start", IntegerType()).add("end", IntegerType()).add("class", StringType())
    .add("priority", IntegerType()).add("value", StringType())
)


# Text every match of a rule contains.
NEEDS = {"SLACK_TOKEN": "xox", "JWT": "eyJ", "EMAIL": "@", "UPI": "@"}
NEEDS_DIGIT = ("CARD", "PHONE", "IP")


@F.pandas_udf(ArrayType(SPAN))
def _find_candidates(texts: pd.Series) -> pd.Series:
    rules = [(name, re.compile(pattern), weight) for name, pattern, weight in PII_RULES]
    digit = re.compile(r"\d")

    def possible(name, text, digits):
        """A rule is skipped when text lacks a character every match of it contains."""
        return digits if name in NEEDS_DIGIT else NEEDS.get(name, "") in text

    def spans(text):
        text = text or ""
        digits = digit.search(text) is not None
        return [
            {"start": m.start(), "end": m.end(), "class": name, "priority": weight, "value": m.group()}
            for name, pattern, weight in rules if possible(name, text, digits)
            for m in pattern.finditer(text)
        ]

    return texts.map(spans)


# Non-deterministic by declaration: the filter on its result must not run it twice.
_candidates = _find_candidates.asNondeterministic()


def _resolve(candidates: Column) -> Column:
    """Drops false cards and private addresses, then keeps the stronger of overlapping spans."""
    real = F.filter(
        candidates,
        lambda s: ~((s["class"] == "CARD") & ~F.coalesce(is_card_number(s["value"]), F.lit(False)))
        & ~((s["class"] == "IP") & is_private_ip(s["value"])),
    )
    ranked = F.array_sort(
        F.transform(
            real,
            lambda s: F.struct(
                (-s["priority"]).alias("weight"), s["start"].alias("start"),
                (s["start"] - s["end"]).alias("size"), s["end"].alias("end"),
                s["class"].alias("class"), s["value"].alias("value"),
            ),
        )
    )
    kept = F.aggregate(
        ranked, F.filter(ranked, lambda s: F.lit(False)),
        lambda taken, s: F.when(
            F.exists(taken, lambda t: (s["start"] < t["end"]) & (s["end"] > t["start"])), taken
        ).otherwise(F.array_append(taken, s)),
    )
    return F.array_sort(
        F.transform(
            kept,
            lambda s: F.struct(
                s["start"].alias("start"), s["end"].alias("end"), s["class"].alias("class"),
                s["value"].alias("value"),
            ),
        )
    )


def pii_spans(texts: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per personal value: keys, order, class, value, start, end (0-based)."""
    matched = texts.select(*keys, *order, _candidates("text").alias("_c")).where(F.size("_c") > 0)
    found = matched.select(*keys, *order, F.explode_outer(_resolve(F.col("_c"))).alias("s"))
    return found.where(F.col("s").isNotNull()).select(*keys, *order, "s.class", "s.value", "s.start", "s.end")


def token_map(spans: DataFrame, group: str, order: list[str]) -> DataFrame:
    """(group, value, class, token): numbered per class by first occurrence.

    Only first occurrences are numbered, and a busy incident's are spread over
    cells of the leading order column.
    """
    place = F.struct(*order, "start")
    first = spans.groupBy(group, "value").agg(
        F.min(place).alias("first"), F.min_by("class", place).alias("class")
    )
    ordered = first.select(group, "value", "class", "first.*")
    lead = F.col(order[0])
    cell = F.floor(lead.cast("double") / 3600)
    numbered = with_running(
        ordered, [group, "class"], cell, [*order, "start"], F.lit(1), "ordinal"
    )
    token = F.concat(F.lit("<"), "class", F.lit("_"), F.col("ordinal").cast("string"), F.lit(">"))
    return numbered.select(group, "value", "class", token.alias("token"))


def redact(texts: DataFrame, keys: list[str], group: str, order: list[str]):
    """Returns (texts with `redacted`, token map).

    `keys` identify a text, `group` is the incident whose tokens it shares, and
    `order` its place in the incident, leading with a number or timestamp.
    """
    # written once: the scan of the texts feeds both the numbering and the splicing
    spans = cut_lineage(pii_spans(texts, sorted({*keys, group}), [c for c in order if c not in (*keys, group)]))
    mapping = token_map(spans, group, order)
    marked = spans.join(mapping.select(group, "value", "token"), [group, "value"])
    per_text = marked.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("start", "end", "token"))).alias("_spans")
    )
    joined = texts.join(per_text, keys, "left")
    nothing = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    text = F.col("text")
    piece = lambda start, length: text.substr(start, length)
    spliced = F.aggregate(
        "_spans", nothing,
        lambda acc, s: F.struct(
            F.concat(acc["out"], piece(acc["at"] + 1, s["start"] - acc["at"]), s["token"]).alias("out"),
            s["end"].alias("at"),
        ),
        lambda acc: F.concat(acc["out"], piece(acc["at"] + 1, F.length(text) - acc["at"])),
    )
    redacted = F.when(F.col("_spans").isNull(), text).otherwise(spliced)
    return joined.withColumn("redacted", redacted).drop("_spans"), mapping


def restore(texts: DataFrame, keys: list[str], group: str, mapping: DataFrame) -> DataFrame:
    """Adds `restored`: every known token of `redacted` back to its value."""
    pattern = r"<[A-Z_]+_\d+>"
    tokens = F.regexp_extract_all("redacted", F.lit(pattern), F.lit(0))
    used = texts.select(*keys, group, F.posexplode(tokens).alias("at", "token")) if group not in keys \
        else texts.select(*keys, F.posexplode(tokens).alias("at", "token"))
    values = used.join(mapping.select(group, "token", "value"), [group, "token"], "left").groupBy(
        *keys
    ).agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("value", "token").alias("v")))).alias("_v"))
    pieces = F.zip_with(
        F.split("redacted", pattern, -1), F.coalesce("_v", F.array().cast("array<struct<at:int,v:string>>")),
        lambda gap, token: F.concat(gap, F.coalesce(token["v"], F.lit(""))),
    )
    return texts.join(values, keys, "left").withColumn("restored", F.array_join(pieces, "")).drop("_v")


def redaction_audit(spans: DataFrame, by: list[str] | None = None) -> DataFrame:
    """How many values of each class were replaced; never the values."""
    return spans.groupBy(*(by or []), F.lower("class").alias("class")).agg(F.count("*").alias("count"))


@F.pandas_udf(StringType())
def blank_secrets(documents: pd.Series) -> pd.Series:
    """JSON text with the values of secret keys masked at any depth."""

    def masked(node):
        if isinstance(node, dict):
            return {k: SECRET_MASK if k.lower() in SECRET_KEYS else masked(v) for k, v in node.items()}
        if isinstance(node, list):
            return [masked(v) for v in node]
        return node

    return documents.map(lambda d: None if d is None else json.dumps(masked(json.loads(d)), sort_keys=True))
