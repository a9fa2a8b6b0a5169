"""Small helpers the training-data operators share."""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.session import ensure_checkpoint_dir

# Fixed values of the operators' contracts.
BLANKS = " \t\n\x0b\x0c\r"
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and leaves every other letter as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def held_out(doc_id: Column) -> Column:
    """True for the quarter of ids no model may learn from; a null id is not in it."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def text_key(text: Column) -> list[Column]:
    """128 bits of a string: two hashes with independent seeds."""
    return [F.xxhash64(text), F.xxhash64(F.lit(7), text)]


def stored(df: DataFrame) -> DataFrame:
    """Writes a frame once to the shared checkpoint folder and reads it back.

    Later plans start from the files, so nothing above is computed twice and a
    lost executor costs no recomputation. Parquet keeps it smaller than a
    checkpoint of rows.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
