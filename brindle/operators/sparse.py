"""Sparse matrices in long form: row_id, col, val."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sparsify(rows: DataFrame, least: float = 0.0) -> DataFrame:
    """Entries of features beyond `least` in absolute value."""
    long = rows.select(F.col("id").alias("row_id"), F.posexplode("features").alias("col", "val"))
    return long.filter(F.abs("val") > least)


def row_pointers(entries: DataFrame) -> DataFrame:
    """row_id, nnz and begin: where the row begins in compressed storage. Counts are summed over groups of rows first."""
    nnz = entries.groupBy("row_id").agg(F.count(F.lit(1)).alias("nnz")).withColumn("part", F.expr("row_id div 65536"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = nnz.groupBy("part").agg(F.sum("nnz").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier(Window.orderBy("part"))), F.lit(0)).alias("before"))
    own = F.coalesce(F.sum("nnz").over(earlier(Window.partitionBy("part").orderBy("row_id"))), F.lit(0))
    return nnz.withColumn("own", own).join(parts, "part").select("row_id", "nnz", (F.col("own") + F.col("before")).alias("begin"))


def multiply(entries: DataFrame, vector: DataFrame) -> DataFrame:
    """row_id and y = sum of val * x; vector: col, x. Rows without entries are absent."""
    return entries.join(vector, "col").groupBy("row_id").agg(F.sum(F.col("val") * F.col("x")).alias("y"))


def positive_column_sums(entries: DataFrame) -> DataFrame:
    """col and the sum of its positive entries."""
    return entries.groupBy("col").agg(F.sum(F.when(F.col("val") > 0, F.col("val")).otherwise(0.0)).alias("total"))


def dot_products(entries: DataFrame, weights: DataFrame) -> DataFrame:
    """row_id, class and dot; weights: class, col, w."""
    return entries.join(weights, "col").groupBy("row_id", "class").agg(F.sum(F.col("val") * F.col("w")).alias("dot"))
