"""Rows told apart by what they hold, for stages that judge every row whatever its id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_key(docs: DataFrame) -> Column:
    """A 64-bit hash of a row's doc_id, text, lang and source, as far as it has them; null and empty are told apart.

    Rows that are equal in all of them share a key, and any verdict on it.
    """
    names = [c for c in ("doc_id", "text", "lang", "source") if c in docs.columns]
    return F.xxhash64(*[F.col(c) for c in names], F.concat(*[F.col(c).isNull().cast("int").cast("string") for c in names]))


#: Keys of 8 bytes that are sent to the executors; more of them meet the documents by key.
SENT = 2_000_000


def without_rows(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The documents whose key isn't among the keys (one column, doc_id; a written table, which is counted first)."""
    gone = keys.select(F.col("doc_id").alias("_row"))
    gone = F.broadcast(gone) if keys.count() <= SENT else gone
    return docs.withColumn("_row", row_key(docs)).join(gone, "_row", "left_anti").select(docs.columns)
