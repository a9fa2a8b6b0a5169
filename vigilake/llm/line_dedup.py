"""Line deduplication: hash normalised lines, count documents per hash, drop, reassemble.

Only hashes and positions are shuffled for the counting; the text moves once, to
meet the positions its lines lose.

Defined cases. A null or empty text is one empty line. A null id is no document:
it adds nothing to a count, and its lines are dropped like those of a smaller id.
Rows that repeat an id are one document for the count and are each rewritten. Lines
that are shorter than `min_chars` code points after trimming always stay.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.llm.common import BLANKS, ascii_lower, stored, text_key


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    min_chars: int = 20, min_docs: int = 3, carry: Sequence[str] = (),
) -> DataFrame:
    """One row per document: `doc_id, text, n_lines, n_dropped` and the columns of `carry`.

    A line found in `min_docs` documents or more stays in the largest id that
    holds it and goes from all others.
    """
    base = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.struct(F.lit(0).alias("_none"), *carry).alias("carried"),
    ).withColumn("row_key", F.xxhash64("text"))
    lines = (
        base.select("doc_id", "row_key", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .withColumn("line", ascii_lower(F.btrim("line", F.lit(BLANKS))))
        .where(F.char_length("line") >= min_chars)
        .withColumn("hashes", F.struct(*[h.alias(f"h{i}") for i, h in enumerate(text_key(F.col("line")))]))
        .select("doc_id", "row_key", "pos", "hashes.h0", "hashes.h1")
    )
    lines = stored(lines)
    repeated = stored(
        lines.groupBy("h0", "h1", "doc_id").agg(F.lit(1).alias("one"))
        .groupBy("h0", "h1").agg(F.count("doc_id").alias("n_docs"), F.max("doc_id").alias("keeper"))
        .where(F.col("n_docs") >= min_docs)
    )
    dropped = (
        lines.join(repeated, ["h0", "h1"])
        .where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy("doc_id", "row_key").agg(F.collect_set("pos").alias("dropped"))
        .select(F.col("doc_id").alias("drop_id"), F.col("row_key").alias("drop_key"), "dropped")
    )
    parts = F.split("text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "dropped")
    rewritten = F.array_join(F.transform(kept, lambda i: F.get(F.col("parts"), i)), "\n")
    joined = base.join(
        dropped,
        F.col("doc_id").eqNullSafe(F.col("drop_id")) & (F.col("row_key") == F.col("drop_key")),
        "left",
    ).withColumn("parts", parts)
    return joined.select(
        "doc_id",
        F.when(F.col("dropped").isNull(), F.col("text")).otherwise(rewritten).alias("text"),
        F.size("parts").cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        *[F.col("carried")[name].alias(name) for name in carry],
    )
