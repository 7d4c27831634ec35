"""Joins of many rows with one row a key, where a few keys may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a key must have more than for its rows to be spread.
HOT = 50_000
#: Most keys whose rows are spread: any other key has at most a HOT_KEYS-th of all rows.
HOT_KEYS = 1000


def join_one(many: DataFrame, one: DataFrame, keys: list[str], most: int | None = None) -> DataFrame:
    """``many`` joined (inner) with ``one``, which has at most one row a key.

    The rows of a hot key stay where they are and get their partner by a broadcast of at most
    HOT_KEYS rows; all others meet by key.  The result is the same without hot keys.
    ``most``: a bound on the rows of ``many``, if known; with no more than HOT there is no hot key to look for.
    """
    if most is not None and most <= HOT:
        return many.join(one, keys)
    hot = many.groupBy(*keys).agg(F.count("*").alias("_rows")).where(F.col("_rows") > HOT).orderBy(F.desc("_rows")).limit(HOT_KEYS).select(*keys).collect()
    if not hot:
        return many.join(one, keys)
    names = many.sparkSession.createDataFrame(hot, many.select(*keys).schema)
    partners = F.broadcast(one.join(F.broadcast(names), keys, "left_semi"))
    return many.join(partners, keys).unionByName(many.join(F.broadcast(names), keys, "left_anti").join(one, keys))
