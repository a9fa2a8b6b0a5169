"""Alert labels, fingerprints, severities and public keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigilake.constants import SEVERITY_ALIASES, SEVERITY_RANK, STABLE_LABELS, TERMINAL_STATES


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(part) for pair in values.items() for part in pair])


def stable_labels(labels: Column) -> Column:
    """Only the labels that identify an alert; pods and instances come and go."""
    return F.map_filter(labels, lambda key, _: key.isin(*STABLE_LABELS))


def fingerprint(labels: Column) -> Column:
    """32 hex characters over the stable labels; a missing label counts as empty text."""
    parts = [
        F.concat(F.lit(f"{name}="), F.coalesce(labels[name], F.lit(""))) for name in STABLE_LABELS
    ]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32)


def dedup_key(group_key: Column, fingerprint_col: Column) -> Column:
    """The sender's group key when it has one, else the fingerprint."""
    return F.coalesce(F.nullif(group_key, F.lit("")), fingerprint_col)


def severity_level(raw: Column) -> Column:
    """Any known spelling to sev1..sev4; the unknown is sev3."""
    spelling = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    return F.coalesce(literal_map(SEVERITY_ALIASES)[spelling], F.lit("sev3"))


def severity_rank(level: Column) -> Column:
    """4 for sev1 down to 1 for sev4, 2 when the level is unknown."""
    return F.coalesce(literal_map(SEVERITY_RANK)[level], F.lit(2))


def severity_of_rank(rank: Column) -> Column:
    return literal_map({v: k for k, v in SEVERITY_RANK.items()})[rank.cast("int")]


def is_open(state: Column) -> Column:
    """Everything not known to be terminal is open, including states added later."""
    return ~state.isin(*TERMINAL_STATES)


def label_pairs(labels: Column) -> Column:
    return F.transform(
        F.map_entries(labels), lambda entry: F.concat(entry["key"], F.lit("="), entry["value"])
    )


def jaccard(left: Column, right: Column) -> Column:
    """Overlap of two label maps on `key=value` pairs; two empty maps give 0."""
    a, b = label_pairs(left), label_pairs(right)
    union = F.size(F.array_union(a, b))
    shared = F.size(F.array_intersect(a, b))
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def public_key(alertname: Column, service: Column, at: Column, epoch: Column) -> Column:
    """Readable incident key, at most 120 characters before the repeat suffix."""
    owner = F.regexp_replace(F.lower(F.coalesce(service, F.lit("unknown"))), "_", "-")
    slug = F.regexp_replace(F.lower(alertname), r"[^\p{L}\p{N}]", "-")
    slug = F.regexp_replace(slug, r"^-+|-+$", "")
    base = F.substring(
        F.concat_ws("-", F.lit("inc"), F.date_format(at, "yyyy-MM-dd"), owner, slug), 1, 120
    )
    return F.when(epoch > 0, F.concat(base, F.lit("-"), epoch.cast("string"))).otherwise(base)


def series_key(name: Column, labels: Column) -> Column:
    """One text per metric series, independent of the order labels were written in."""
    ordered = F.array_sort(label_pairs(labels))
    return F.concat(name, F.lit("{"), F.concat_ws(",", ordered), F.lit("}"))
