"""Benchmark decontamination as a prefix-filtered set join over shingles of words.

Every item is cut into windows of `window` words (a shorter item is one window), and
a window is the set of its shingles at fixed offsets. A document contains a window
only if it contains all its shingles, so joining one necessary shingle is enough
(the prefix of a containment of 1): the one that is rarest in the documents. The
prefix match gives the place a window must start at, which has to lie inside the
document (length and position bounds); the window's words are then compared there.

DataFrame functions only. Documents are read twice: once for the shingles that any
item has, once to compare words and to give every document its row.

Defined cases. Null and empty texts have no words, no hits and no items. Items
without words have no window. Words differ by case of A-Z only through lower-casing,
other letters are compared as they are. Repeated items and rows count once per id
and once per row. An item with a null id marks words but is not listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.llm.common import ascii_lower, stored

# What separates words, before and after lower-casing. Single characters are one
# table look-up for the pattern matcher, ranges are one test each.
GAP = "[" + "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum()) + "]+"
SMALL_ROWS = 200_000


def _cased_words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def words(text: Column) -> Column:
    return _cased_words(ascii_lower(text))


def _loose_words(text: Column) -> Column:
    """Words in full lower case: cheaper, and equal wherever `words` are equal."""
    return F.transform(_cased_words(text), F.lower)


def _shingles(tokens: Column, size: int) -> Column:
    """Hash of the `size` words from each position on, in order of position."""
    last = F.size(tokens) - size
    return F.when(last < 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get(tokens, i + k) for k in range(size)]))
    )


def _sized(df: DataFrame) -> DataFrame:
    """Broadcast up to a counted number of narrow rows; a shuffle join beyond it."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def find_contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text", window: int = 10, shingle: int = 5,
) -> DataFrame:
    """`doc_id, row_key, n_words, n_hit, item_ids`: hit words and the sorted items behind them.

    `row_key` is the hash of the text, to tell rows of one id apart.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn(
        "row_key", F.xxhash64("text")
    )
    exact = F.col("words")
    item_windows = stored(
        items.select(F.col(item_id_col).cast("string").alias("item_id"), words(F.col(item_text_col)).alias("words"))
        .where(F.size("words") > 0)
        .withColumn("start", F.explode(F.sequence(F.lit(1), F.greatest(F.size("words") - window, F.lit(0)) + 1)))
        .select("item_id", F.slice(exact, F.col("start"), window).alias("words"))
        .distinct()
    )
    windows = item_windows.select("words").distinct().withColumn("length", F.size("words"))
    tokens = F.transform("words", F.lower)
    by_size = [
        windows.where(F.size("words") >= shingle if size == shingle else F.size("words") == size)
        .select("words", "length", F.lit(size).alias("size"),
                F.posexplode(_shingles(tokens, size)).alias("offset", "hash"))
        for size in range(1, shingle + 1)
    ]
    parts = by_size[0]
    for more in by_size[1:]:
        parts = parts.unionByName(more)
    parts = stored(parts)
    known = stored(parts.select("size", "hash").distinct())
    sizes = sorted(row["size"] for row in known.select("size").distinct().collect())  # at most `shingle`

    loose = base.select("doc_id", "row_key", _loose_words(F.col("text")).alias("tokens"))
    found = None
    for size in sizes:
        there = loose.select(
            "doc_id", "row_key", F.size("tokens").alias("n_words"),
            F.posexplode(_shingles(F.col("tokens"), size)).alias("pos", "hash"),
        ).join(_sized(known.where(F.col("size") == size)), "hash")
        found = there if found is None else found.unionByName(there)
    if found is None:
        found = loose.select(
            "doc_id", "row_key", F.lit(0).alias("n_words"), F.lit(0).alias("pos"), F.lit(0).cast("long").alias("hash"),
            F.lit(0).alias("size"),
        ).where(F.lit(False))
    found = stored(found)

    rarity = found.groupBy("size", "hash").agg(F.count("*").alias("seen"))
    order = F.struct(F.coalesce("seen", F.lit(0)), "hash", "offset")
    prefix = stored(
        parts.join(rarity, ["size", "hash"], "left")
        .groupBy("words", "length", "size")
        .agg(F.min_by(F.struct("hash", "offset", "seen"), order).alias("rarest"))
        .where(F.col("rarest.seen") > 0)
        .select("words", "length", "size", "rarest.hash", "rarest.offset")
    )
    start = F.col("pos") - F.col("offset")
    candidates = (
        found.join(_sized(prefix), ["size", "hash"])
        .where((start >= 0) & (start + F.col("length") <= F.col("n_words")))
        .groupBy("doc_id", "row_key")
        .agg(F.collect_set(F.struct(start.alias("start"), "length", F.col("words").alias("window"))).alias("windows"))
        .select(F.col("doc_id").alias("of"), F.col("row_key").alias("of_key"), "windows")
    )
    same = F.col("doc_id").eqNullSafe(F.col("of")) & F.col("row_key").eqNullSafe(F.col("of_key"))
    checked = base.join(candidates, same, "left").select(
        "doc_id", "row_key", F.size(_cased_words(F.col("text"))).cast("long").alias("n_words"),
        F.when(F.col("windows").isNotNull(), words(F.col("text"))).alias("words"), "windows",
    ).withColumn(
        "windows",
        F.filter("windows", lambda w: F.slice(F.col("words"), w["start"] + 1, w["length"]) == w["window"]),
    )
    places = F.flatten(F.transform("windows", lambda w: F.sequence(w["start"], w["start"] + w["length"] - 1)))
    checked = stored(checked.select(
        "doc_id", "row_key", "n_words",
        F.coalesce(F.size(F.array_distinct(places)), F.lit(0)).cast("long").alias("n_hit"),
        F.array_distinct(F.transform("windows", lambda w: w["window"])).alias("windows"),
    ))
    listed = (
        checked.where(F.col("n_hit") > 0).select("doc_id", "row_key", F.explode("windows").alias("words"))
        .join(_sized(item_windows), "words")
        .groupBy("doc_id", "row_key").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
        .select(F.col("doc_id").alias("of"), F.col("row_key").alias("of_key"), "item_ids")
    )
    return checked.join(listed, same, "left").select(
        "doc_id", "row_key", "n_words", "n_hit",
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
    )

