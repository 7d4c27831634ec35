"""Exact histogram of encoded lengths, with the suffix sums that answer every context limit.

Documents are aggregated by their number of tokens.  A row of the histogram also
has how many documents, and how many tokens of them, are at least that long.  From
those alone follow, for any limit c, the truncated total (the tokens of shorter
documents, and c for each other) and any quantile.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodesieve.llm.memory import tidy
from lodesieve.llm.pretokens import loaded
from lodesieve.sources.scratch import Scratch

#: Lengths of one block of the two-level suffix sum: the most rows that one window's task holds of a block.
BLOCK = 1024


def _lengths(path: str):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(x) for x in encoder.encoded(batch.column(0))], pa.int64())], ["n_tokens"])

    return run


def token_lengths(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """``n_tokens`` for every row; a null or empty text has 0.

    Repeated rows count each; very long texts are encoded whole; an empty table gives no rows; further columns are ignored.
    """
    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_lengths(tokenizer), "n_tokens long")


def length_histogram(lengths: DataFrame, scratch: Scratch) -> DataFrame:
    """``n_tokens, n_docs, docs_at_least, tokens_at_least, total_if_truncated`` for each length that occurs.

    ``total_if_truncated`` is the total if every document were cut to this length.
    Null lengths are left out; an empty table gives no rows.  Suffix sums are taken
    within blocks of lengths and over the blocks' totals, so no task sees every length.
    """
    counts = lengths.select("n_tokens").where("n_tokens is not null").groupBy("n_tokens").agg(F.count("*").alias("n_docs"))
    counts = scratch.save(counts.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)), "counts")
    within = Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    tokens = F.col("n_docs") * F.col("n_tokens")
    inner = counts.withColumns({"docs_in": F.sum("n_docs").over(within), "tokens_in": F.sum(tokens).over(within)})
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(tokens).alias("t"), F.sum(F.sum("n_docs")).over(Window.partitionBy()).alias("all_d"), F.sum(F.sum(tokens)).over(Window.partitionBy()).alias("all_t"))
    blocks = blocks.select("block", "all_t", F.coalesce(F.sum("d").over(above), F.lit(0)).alias("d_above"), F.coalesce(F.sum("t").over(above), F.lit(0)).alias("t_above"))
    out = inner.join(blocks, "block").select("n_tokens", "n_docs", (F.col("docs_in") + F.col("d_above")).alias("docs_at_least"), (F.col("tokens_in") + F.col("t_above")).alias("tokens_at_least"), "all_t")
    return out.withColumn("total_if_truncated", F.col("all_t") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).drop("all_t")


def truncated_total(histogram: DataFrame, limit: int) -> DataFrame:
    """One row ``total``: tokens left if every document were cut to ``limit``; 0 for an empty histogram."""
    return histogram.agg(F.coalesce(F.sum(F.least("n_tokens", F.lit(limit)) * F.col("n_docs")), F.lit(0)).alias("total"))


def length_quantile(histogram: DataFrame, q: float | str | Fraction) -> DataFrame:
    """One row ``length``: the least length that at least a share q of the documents doesn't exceed; null if empty.

    q counts as the decimal that it is written as, so that 0.9 of ten documents are nine.
    """
    n = histogram.agg(F.max("docs_at_least")).first()[0] or 0
    longer = n - math.ceil((q if isinstance(q, Fraction) else Fraction(str(q))) * n)
    return histogram.where(F.col("docs_at_least") - F.col("n_docs") <= longer).agg(F.min("n_tokens").alias("length"))
