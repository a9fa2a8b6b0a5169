"""Reference ids, numbers, tokens and entities in claim text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigilake.constants import (
    CLAIM_STOPWORDS,
    CLAIM_TOKEN_PATTERN,
    ENTITY_PATTERN,
    NUMBER_PATTERN,
    REFERENCE_PATTERN,
    REFERENCE_PREFIX,
    TRIVIAL_NUMBER_MAX,
)
from vigilake.functions.labels import literal_map


def _prefixed(kind: str, body: Column) -> Column:
    return F.concat(F.lit(REFERENCE_PREFIX[kind] + ":"), body)


def message_ref(ts: Column) -> Column:
    return _prefixed("message", ts)


def timeline_ref(entry_id: Column) -> Column:
    return _prefixed("timeline", entry_id.cast("string"))


def alert_ref(fingerprint: Column) -> Column:
    return _prefixed("alert", fingerprint)


def short_sha(sha: Column) -> Column:
    return F.substring(F.lower(F.trim(sha)), 1, 12)


def deploy_ref(sha: Column) -> Column:
    return _prefixed("deploy", short_sha(sha))


def runbook_ref(runbook_id: Column, step_id: Column) -> Column:
    return _prefixed("runbook", F.concat(runbook_id.cast("string"), F.lit("#"), step_id))


def metric_ref(query: Column, start: Column, end: Column) -> Column:
    digest = F.substring(F.sha2(query, 256), 1, 8)
    span = F.concat_ws("-", F.unix_seconds(start), F.unix_seconds(end))
    return _prefixed("metric", F.concat(digest, F.lit("@"), span))


def is_reference(ref: Column) -> Column:
    return F.trim(ref).rlike(REFERENCE_PATTERN)


def reference_kind(ref: Column) -> Column:
    prefix = F.regexp_extract(F.trim(ref), REFERENCE_PATTERN, 1)
    return literal_map({v: k for k, v in REFERENCE_PREFIX.items()})[prefix]


def reference_body(ref: Column) -> Column:
    return F.nullif(F.regexp_extract(F.trim(ref), REFERENCE_PATTERN, 2), F.lit(""))


def _all_matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(0))


def numbers_in(text: Column) -> Column:
    """Distinct numeric literals without thousands commas; bare integers up to 10 are ignored."""
    plain = F.transform(_all_matches(text, NUMBER_PATTERN), lambda m: F.replace(m, F.lit(",")))
    telling = F.filter(
        plain, lambda n: n.contains(".") | (n.cast("double") > F.lit(TRIVIAL_NUMBER_MAX))
    )
    return F.array_distinct(telling)


def claim_tokens(text: Column) -> Column:
    """Distinct content words: longer than two characters and not a stop word."""
    words = F.regexp_extract_all(F.lower(text), F.lit(CLAIM_TOKEN_PATTERN), F.lit(0))
    kept = F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*CLAIM_STOPWORDS))
    return F.array_distinct(kept)


def entities(text: Column) -> Column:
    """Names that carry meaning on their own: hyphenated ids, versions, hashes, user ids."""
    return F.array_distinct(F.transform(_all_matches(text, ENTITY_PATTERN), F.lower))
