"""From raw documents to a mixed training corpus: five stages over the llm operators.

Each stage takes (spark, docs, folder of tables) and returns a frame that is written
as Parquet and read again as the next one's documents. All stages but the last
return the columns of documents; the last returns the mixing plan, one row per
document with the number of copies the mix takes of it.

Rows without an id stay in the near-duplicate stage, since no group can name them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.llm import decontaminate, language, line_dedup, mixing, near_copies
from vigilake.llm.common import held_out, stored, table


def _packed(docs: DataFrame) -> DataFrame:
    """All columns in one, so that no name of theirs meets an operator's."""
    return docs.select(F.struct(*docs.columns).alias("row"))


def identify_language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without a language (no letter) go."""
    filters = language.fit(docs, "doc_id", "text", "lang", allowed=~held_out(F.col("doc_id")))
    known = language.predict(_packed(docs), filters, F.col("row.text"))
    return known.where(F.col("lang_pred") != language.UNDETERMINED).select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Lines of three documents or more stay in one of them; lengths follow the text."""
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))
    done = line_dedup.dedup_lines(rows.withColumn("row", F.col("row").dropFields("text")), carry=["row"])
    changed = F.col("n_dropped") > 0
    length = F.when(changed, F.char_length("text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    new = {"text": F.col("text"), "n_chars": length}
    return done.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each component of five-word similarity 0.8 stays: the one with the smallest id.

    Components come from SimHash links of five-word shingles, completed by MinHash bands for the
    links that SimHash cannot reach; all are confirmed on whole sets.

    Rows of one id but different texts are told apart by text: of one component the
    row with the smallest text hash stays, of different components each has its own.
    """
    groups = near_copies.near_copies(docs).where(F.col("doc_id").isNotNull())
    keepers = groups.groupBy("root").agg(F.min(F.struct("doc_id", "row_key")).alias("k")).select("k.*")
    rows = _packed(docs.where(F.col("doc_id").isNotNull())).select(
        "row", F.col("row.doc_id").alias("doc_id"), F.xxhash64("row.text").alias("row_key")
    )
    kept = rows.join(keepers, ["doc_id", "row_key"], "left_semi").dropDuplicates(["doc_id", "row_key"]).select("row.*")
    return kept.unionByName(docs.where(F.col("doc_id").isNull())).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    found = decontaminate.find_contamination(docs, table(spark, folder, "benchmark")).where(F.col("n_hit") > 0)
    dirty = found.select("doc_id", "row_key")
    same = F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.xxhash64("row.text") == F.col("row_key"))
    return _packed(docs).join(dirty, same, "left_anti").select("row.*")


def mix(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Copies of every document that bring sources near their target weights."""
    return mixing.mix_sources(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("simhash_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("source_mixing", mix),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
