"""Text similarity, number spelling and span checks."""

from __future__ import annotations

import math
import re
from collections import Counter
from difflib import SequenceMatcher
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StringType

from vigilake.constants import EXEMPLAR_STOPWORDS, EXEMPLARS, PRIVATE_IP_PATTERN

NGRAM = 3
WORD_BASE = 1 << 50


def strip(text: Column) -> Column:
    """Removes leading and trailing white space of any kind."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


@F.pandas_udf(DoubleType())
def sequence_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Matching-block similarity of two short texts, trimmed and lower-cased."""
    matcher = SequenceMatcher
    return pd.Series(
        [
            None if a is None or b is None else
            matcher(None, a.strip().lower(), b.strip().lower()).ratio()
            for a, b in zip(left, right)
        ]
    )


def ratio_at_least(left: Column, right: Column, least: float) -> Column:
    """Whether `sequence_ratio` reaches `least`, at the cost of the ratio only where it may.

    Matching blocks cannot hold more characters than the shorter text (compared in the
    plan), nor more of any character than both texts do (compared on counts); only what
    passes both bounds is compared in full.
    """
    a, b = F.length(F.lower(strip(left))), F.length(F.lower(strip(right)))
    may = F.coalesce(2 * F.least(a, b) >= F.lit(least) * (a + b) - 1e-9, F.lit(False))
    return may & F.coalesce(_reaches(left, right, F.lit(least)), F.lit(False))


@F.pandas_udf(BooleanType())
def _reaches(left: pd.Series, right: pd.Series, least: pd.Series) -> pd.Series:
    counts: dict[str, Counter] = {}

    def one(a: str | None, b: str | None, limit: float) -> bool | None:
        if a is None or b is None:
            return None
        a, b = a.strip().lower(), b.strip().lower()
        for text in (a, b):
            if text not in counts:
                counts[text] = Counter(text)
        total = len(a) + len(b)
        shared = sum((counts[a] & counts[b]).values())
        if total and 2.0 * shared / total < limit:
            return False
        return SequenceMatcher(None, a, b).ratio() >= limit

    return pd.Series([one(*row) for row in zip(left, right, least)], dtype=object)


@F.pandas_udf(ArrayType(StringType()))
def number_spellings(values: pd.Series) -> pd.Series:
    """The ways a computed figure may be written in a document."""

    def spell(value):
        if value is None or math.isnan(value):
            return []
        forms = {format(value, ".1f"), format(value, ".2f"), format(value, "g")}
        if math.isfinite(value):
            forms.add(str(round(value)))
        return sorted(forms)

    return values.map(spell)


def lexical_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of a text and how often each occurs.

    Features are content words and the trigrams seen by a window sliding over the
    words joined by blanks. A trigram is numbered by its three bytes, a word by a
    48-bit hash above all trigrams.
    """
    content = [w for w in re.findall("[a-z0-9]+", text.lower()) if w not in EXEMPLAR_STOPWORDS]
    stream = np.frombuffer(" ".join(content).encode("ascii"), dtype=np.uint8).astype(np.int64)
    grams = np.zeros(0, dtype=np.int64)
    if len(stream) >= NGRAM:
        window = np.lib.stride_tricks.sliding_window_view(stream, NGRAM)
        grams = window @ np.array([1 << 16, 1 << 8, 1])
    named = [WORD_BASE + int.from_bytes(blake2b(w.encode(), digest_size=6).digest(), "big") for w in content]
    return np.unique(np.concatenate([np.array(named, dtype=np.int64), grams]), return_counts=True)


def exemplar_matrix() -> tuple[list[str], np.ndarray, np.ndarray]:
    """(intent of each example phrase, sorted features of all, their weights by phrase as unit rows)."""
    intents = [kind for kind, phrases in EXEMPLARS.items() for _ in phrases]
    counted = [lexical_features(phrase) for phrases in EXEMPLARS.values() for phrase in phrases]
    features = np.unique(np.concatenate([found for found, _ in counted]))
    weights = np.zeros((len(counted), len(features)))
    for row, (found, n) in zip(weights, counted):
        row[np.searchsorted(features, found)] = n / np.linalg.norm(n)
    return intents, features, weights


def is_private_ip(value: Column) -> Column:
    return value.rlike(PRIVATE_IP_PATTERN)


def is_card_number(value: Column) -> Column:
    """13 to 19 digits, ignoring separators, passing the Luhn check."""
    digits = F.regexp_replace(value, r"\D", "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def saturating_ratio(value: Column, ceiling: float) -> Column:
    if ceiling <= 0:
        return F.lit(0.0)
    return F.least(value / F.lit(float(ceiling)), F.lit(1.0))
