"""Top-k per query: k smallest or largest, with or without ties at the k-th place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_k(rows: DataFrame, k: int, by: str = "distance", group: str = "query_id", tie: str = "id", largest: bool = False, keep_ties: bool = False) -> DataFrame:
    """Adds place from 1. Catalyst limits each group before the exchange, so a task sends k rows a group; ties of the k-th place stay with keep_ties."""
    key = F.col(by).desc() if largest else F.col(by).asc()
    if keep_ties:
        return rows.withColumn("place", F.rank().over(Window.partitionBy(group).orderBy(key))).filter(F.col("place") <= k)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(key, tie))).filter(F.col("place") <= k)


def sorted_order(rows: DataFrame, *keys, tie: str = "id") -> DataFrame:
    """Rows in the order of keys, ties by the unique `tie`; binary keys compare byte by byte, unsigned."""
    return rows.orderBy(*keys, tie)
