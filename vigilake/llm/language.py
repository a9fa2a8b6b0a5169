"""Language identification by language-bitmask n-gram filters.

One Bloom filter per language, stored bit-sliced: row `i` of the table is a bitmask
with one bit per language, so the `AND` of the rows an n-gram hashes to names all
languages that may contain it. A text's n-grams are counted per language
(population counts by bit), each count is corrected for the false positives its
filter must give at its measured fill, and the largest corrected share decides.

The filters are fitted on a bounded sample (about `docs_per_lang` distinct whole
documents of each language, chosen by hash); prediction reads every whole text.

Defined cases. Null texts and texts without a letter are `und` with score 0. Texts
with letters get the language with the most corrected hits, ties and texts without
any hit the first language by code point. With nothing to learn from, all is `und`.
Letters are those of Unicode's letter categories; case is folded.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.llm.common import stored

UNDETERMINED = "und"
GRAM = 3
PROBES = 2
SLOTS = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD1342543DE82EF95)


def letter_table() -> np.ndarray:
    """Per code point: its lower-case code point if it is a letter, else 0."""
    table = np.zeros(sys.maxunicode + 1, dtype=np.uint32)
    for code in range(sys.maxunicode + 1):
        char = chr(code)
        if char.isalpha():
            low = char.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


def gram_hashes(text: str, letters: np.ndarray) -> np.ndarray | None:
    """Hashes of all n-grams of letters, words padded with one boundary; None without a letter."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    chars = letters[codes].astype(np.uint64)
    if not chars.any():
        return None
    padded = np.concatenate((np.zeros(1, np.uint64), chars, np.zeros(1, np.uint64)))
    a, b, c = padded[:-2], padded[1:-1], padded[2:]
    packed = ((a << np.uint64(42)) | (b << np.uint64(21)) | c)[b != 0]
    mixed = packed * _MIX
    return (mixed ^ (mixed >> np.uint64(29))) * _STEP


def slots(hashes: np.ndarray, n_slots: int, probe: int) -> np.ndarray:
    """Table rows of one of the hash functions; `n_slots` is a power of two up to 2**21."""
    return ((hashes >> np.uint64(64 - 21 * (probe + 1))) & np.uint64(n_slots - 1)).astype(np.int64)


class Filters:
    """Bit-sliced filters: `rows[slot, word]` holds 64 languages' bits."""

    def __init__(self, languages: list[str], rows: np.ndarray, letters: np.ndarray):
        self.languages, self.rows, self.letters = languages, rows, letters
        filled = [
            ((rows[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(languages))
        ]
        self.false_rate = np.minimum(np.array(filled) ** PROBES, 0.999)

    def counts(self, hashes: np.ndarray) -> np.ndarray:
        """Per language, how many of the n-grams its filter holds."""
        mask = self.rows[slots(hashes, len(self.rows), 0)]
        for probe in range(1, PROBES):
            mask = mask & self.rows[slots(hashes, len(self.rows), probe)]
        return np.array([
            np.count_nonzero(mask[:, i // 64] & np.uint64(1 << (i % 64))) for i in range(len(self.languages))
        ])

    def decide(self, text: str | None) -> tuple[str, float]:
        hashes = gram_hashes(text, self.letters) if text else None
        if hashes is None or not self.languages:
            return UNDETERMINED, 0.0
        rate = self.false_rate
        true = np.clip((self.counts(hashes) - len(hashes) * rate) / (1 - rate), 0, len(hashes))
        best, total = int(true.argmax()), float(true.sum())
        return self.languages[best], float(true[best] / total) if total else 0.0


def fit(
    docs: DataFrame, id_col: str, text_col: str, lang_col: str, allowed: Column,
    docs_per_lang: int = 1500, n_slots: int = SLOTS, min_ratio: float = 0.1, min_docs: int = 3,
) -> Filters:
    """Filters of the languages of rows where `allowed` holds.

    Rows are taken by hash at a rate that gives `docs_per_lang` per language. An
    n-gram belongs to a language if `min_docs` of its sampled documents hold it (a tenth
    of them where that is less, at least one), and at `min_ratio` or more of the rate of the language that uses it most. The driver
    gets the masks of the table, `n_slots` words for 64 languages.
    """
    letters = letter_table()
    shared = docs.sparkSession.sparkContext.broadcast(letters)

    @F.pandas_udf("array<long>")
    def distinct_grams(texts: pd.Series) -> pd.Series:
        hashed = (gram_hashes(text, shared.value) for text in texts)
        return pd.Series([[] if h is None else np.unique(h).view(np.int64) for h in hashed])

    labelled = docs.where(allowed & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    place = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))
    shares = {
        row[lang_col]: min(1.0, docs_per_lang / row["count"]) for row in labelled.groupBy(lang_col).count().collect()
    }
    if not shares:
        return Filters([], np.zeros((n_slots, 1), dtype=np.uint64), letters)
    share = F.create_map(*[F.lit(x) for pair in sorted(shares.items()) for x in pair])[F.col(lang_col)]
    sample = (
        labelled.where(F.pmod(place, F.lit(1 << 20)) < share * (1 << 20))
        .select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).dropDuplicates()
    )
    sample = stored(sample.select("lang", distinct_grams("text").alias("grams")))
    sizes = {row["lang"]: row["n"] for row in sample.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Filters([], np.zeros((n_slots, 1), dtype=np.uint64), letters)
    number = F.create_map(*[F.lit(x) for pair in enumerate(languages) for x in reversed(pair)])
    size = F.create_map(*[F.lit(x) for lang in languages for x in (lang, sizes[lang])])
    needed = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(min_docs, -(-sizes[lang] // 10)))])
    users = (
        sample.select("lang", F.explode("grams").alias("gram"))
        .groupBy("gram", "lang").agg(F.count("*").alias("n"))
        .select("gram", "n", number[F.col("lang")].alias("place"), (F.col("n") / size[F.col("lang")]).alias("rate"),
                needed[F.col("lang")].alias("least"))
        .groupBy("gram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("place", "n", "rate", "least")).alias("users"))
        .select("gram", "top", F.explode("users").alias("u"))
        .where((F.col("u.n") >= F.col("u.least")) & (F.col("u.rate") >= F.col("top") * min_ratio))
        .select("gram", "u.place")
    )

    def to_slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hashes = batch["gram"].to_numpy(dtype=np.int64).view(np.uint64)
            for probe in range(PROBES):
                yield pd.DataFrame({"slot": slots(hashes, n_slots, probe), "place": batch["place"]})

    masks = (
        users.mapInPandas(to_slots, "slot long, place int")
        .groupBy("slot", (F.col("place") / 64).cast("int").alias("word"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place") % 64)).alias("mask"))
        .toPandas()
    )
    rows = np.zeros((n_slots, -(-len(languages) // 64)), dtype=np.uint64)
    rows[masks["slot"], masks["word"]] = masks["mask"].to_numpy(dtype=np.int64).view(np.uint64)
    return Filters(languages, rows, letters)


def predict(docs: DataFrame, filters: Filters, text: Column) -> DataFrame:
    """`docs` with `lang_pred` and `lang_score`; the filter table (`n_slots` words) is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast((filters.languages, filters.rows, filters.letters))

    @F.pandas_udf("lang_pred string, lang_score double")
    def decide(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = Filters(*shared.value)
        for batch in texts:
            answers = [known.decide(text) for text in batch]
            yield pd.DataFrame(answers, columns=["lang_pred", "lang_score"])

    return docs.withColumn("_language", decide(text)).select(
        *docs.columns, F.col("_language.lang_pred").alias("lang_pred"),
        F.col("_language.lang_score").alias("lang_score"),
    )
