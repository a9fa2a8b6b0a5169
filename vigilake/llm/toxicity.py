"""Toxicity scores: boosted trees over dense text features, calibrated isotonically.

Three things are learned from labelled rows only, all on Spark: a lexicon (words
far likelier in toxic than in other documents, with obfuscated spellings undone),
gradient-boosted trees over the features below, and an isotonic map from the trees'
probability to the observed rate on a fold the trees have not seen.

Features of a whole text: densities and counts of lexicon words (strong and mild),
lexicon words near the second person, lexicon words found only after undoing
obfuscation, shares of capitals, of words in capitals, of exclamation and question
marks, of repeated marks, of words mixing letters with other signs, and length.

Fitting uses at most about `rows_per_label` labelled documents of either label, chosen
by hash; scoring reads every document.

Defined cases. Null and empty texts have all features 0 and a score like others.
Rows without a label, and labels other than 0 and 1, teach nothing. A repeated label
teaches its document once; if its labels differ, the larger one. With one label only
(or none) every score is the smoothed share of label 1. Without rows in the
calibration fold, scores are the trees' own.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.llm.common import stored

# Second person in the languages at hand, signs that stand for letters.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur tu toi te ton ta tes vous votre vos du dich dir dein deine ihr euch euer "
    "sie tú ti usted ustedes vosotros vuestro su sus".split()
)
LOOKALIKES = str.maketrans("01345789@$!|", "oieastbgasil")
WORD = re.compile(r"[^\W_]+(?:['*@$!|.\-_][^\W_]+)*")
SPACED = re.compile(r"['*@$!|.\-_]")
REPEATED_MARKS = re.compile(r"[!?]{2,}")
STRETCHED = re.compile(r"(.)\1{2,}")
NEAR = 4
N_FEATURES = 14


def plain_spelling(word: str) -> str:
    """The word with look-alike signs read as letters, separators dropped, stretches shortened."""
    return STRETCHED.sub(r"\1", SPACED.sub("", word.translate(LOOKALIKES)))


def text_features(text: str | None, strong: set[str], mild: set[str]) -> list[float]:
    if not text:
        return [0.0] * N_FEATURES
    words = WORD.findall(text)
    low = [w.lower() for w in words]
    n = max(len(words), 1)
    hits = [i for i, w in enumerate(low) if w in strong]
    some = sum(1 for w in low if w in mild)
    odd = [i for i, w in enumerate(low) if not w.isalpha()]
    hidden = sum(1 for i in odd if low[i] not in strong and plain_spelling(low[i]) in strong)
    mixed = sum(1 for i in odd if any(c.isalpha() for c in low[i]) and not low[i].isdigit())
    near = sum(
        1 for i in hits if any(w in SECOND_PERSON for w in low[max(0, i - NEAR):i + NEAR + 1])
    )
    letters = max(sum(map(len, words)), 1)
    capitals = len(re.findall(r"[A-ZÀ-ÖØ-Þ]", text))
    shouted = sum(1 for w in words if len(w) > 2 and w.isupper())
    marks = text.count("!") + text.count("?")
    return [
        len(hits) / n, math.log1p(len(hits)), some / n, math.log1p(some), len(set(low[i] for i in hits)) / 1.0,
        near / n, math.log1p(near), hidden / n, math.log1p(hidden), capitals / letters, shouted / n,
        marks / len(text), len(REPEATED_MARKS.findall(text)) / n + mixed / n, math.log1p(n),
    ]


def _features(strong: set[str], mild: set[str]):
    @F.pandas_udf("array<double>")
    def features(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([text_features(text, strong, mild) for text in batch])

    return features


def _sample(labelled: DataFrame, rows_per_label: int) -> DataFrame:
    """About `rows_per_label` of each label, by hash of id."""
    counts = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}  # labels 0 and 1
    share = F.create_map(*[
        F.lit(x) for label in (0, 1) for x in (label, min(1.0, rows_per_label / max(1, counts.get(label, 0))))
    ])
    place = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("label")), F.lit(1 << 20))
    return labelled.where(place < share[F.col("label")] * (1 << 20))


def learn_lexicon(sample: DataFrame, size: int, min_docs: int) -> tuple[set[str], set[str]]:
    """Strong and mild words by smoothed log-odds of document counts; at most `size` words."""
    both = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    toxic, other = both.get(1, 0), both.get(0, 0)
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))
    odds = F.log((F.col("in_toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("in_other") + 0.5) / (other + 1.0))
    top = (
        sample.select("label", F.explode(words).alias("word"))
        .groupBy("word").agg(F.sum("label").alias("in_toxic"), F.sum(1 - F.col("label")).alias("in_other"))
        .where(F.col("in_toxic") >= min_docs).select("word", odds.alias("odds")).where(F.col("odds") >= 2.0)
        .orderBy(F.col("odds").desc(), "word").limit(size).collect()
    )
    return {r["word"] for r in top if r["odds"] >= 4.0}, {r["word"] for r in top if r["odds"] < 4.0}


def score_toxicity(
    docs: DataFrame, labels: DataFrame, learn: Column, calibrate: Column, id_col: str = "doc_id",
    text_col: str = "text", label_col: str = "toxic", rows_per_label: int = 12_000,
    lexicon_size: int = 2_000, min_docs: int = 4, trees: int = 20, depth: int = 4,
) -> DataFrame:
    """`doc_id, score` for every document.

    `learn` and `calibrate` are conditions on the id column: the rows trees and
    lexicon may learn from, and the rows of the calibration fold.
    """
    teachers = (
        labels.where(F.col(label_col).isin(0, 1) & (learn | calibrate))
        .groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    )
    fold = F.coalesce(calibrate, F.lit(False)).alias("calibrate")
    sampled = stored(_sample(stored(teachers), rows_per_label))
    texts = (
        docs.where(learn | calibrate).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), fold)
        .join(F.broadcast(sampled), "id")  # two labels, `rows_per_label` ids each
        .select("id", "text", "calibrate", "label").dropDuplicates(["id"])
    )
    texts = stored(texts)
    fitting = texts.where(~F.col("calibrate"))
    strong, mild = learn_lexicon(fitting, lexicon_size, min_docs)
    features = _features(strong, mild)
    table = stored(texts.select("label", "calibrate", features("text").alias("values")))
    table = table.select("label", "calibrate", array_to_vector("values").alias("features"))
    counts = {
        (r["calibrate"], r["label"]): r["count"] for r in table.groupBy("calibrate", "label").count().collect()
    }
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    positive, negative = counts.get((False, 1), 0), counts.get((False, 0), 0)
    if not positive or not negative:
        prior = (positive + 0.1) / (positive + negative + 1.0)
        return out.select("doc_id", F.lit(prior).alias("score"))
    boosted = GBTClassifier(
        featuresCol="features", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=7,
    ).fit(table.where(~F.col("calibrate")).select(F.col("label").cast("double"), "features"))
    probability = vector_to_array("probability")[1]
    scored = boosted.transform(
        out.select("doc_id", array_to_vector(features("text")).alias("features"))
    ).select("doc_id", probability.alias("p"))
    if not any(counts.get((True, label), 0) for label in (0, 1)):
        return scored.select("doc_id", F.col("p").alias("score"))
    seen = boosted.transform(table.where("calibrate")).select(probability.alias("p"), F.col("label").cast("double"))
    isotonic = IsotonicRegression(featuresCol="p", labelCol="label", predictionCol="score").fit(seen)
    return isotonic.transform(scored).select("doc_id", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "score")).alias("score"))
