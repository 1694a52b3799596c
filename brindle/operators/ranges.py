"""Ranges of features: whole tables, subsets, and updates by one row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocked import matrix


def feature_ranges(rows: DataFrame, dim: int, subset: DataFrame | None = None) -> DataFrame:
    """One row: low and high, arrays of each feature's least and largest value. subset: ids that count, if not all.

    A few features are one aggregate each; of many each task sends one row, from its Arrow batches."""
    if subset is not None:
        rows = rows.join(subset.select("id").distinct(), "id", "left_semi")
    if dim <= 8:
        return grouped_ranges(rows, dim).select("low", "high")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full(dim, np.nan), np.full(dim, np.nan)
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0), dim)
                low, high = np.fmin(low, np.fmin.reduce(x)), np.fmax(high, np.fmax.reduce(x))
        yield pa.RecordBatch.from_arrays([pa.array([low], pa.list_(pa.float64())), pa.array([high], pa.list_(pa.float64()))], names=["low", "high"])

    each = rows.select("features").mapInArrow(partial, "low array<double>, high array<double>").select(F.posexplode(F.arrays_zip("low", "high")).alias("attr", "b"))
    known = lambda c: F.nanvl(c, F.lit(None).cast("double"))
    each = each.groupBy("attr").agg(F.min(known(F.col("b.low"))).alias("l"), F.max(known(F.col("b.high"))).alias("h"))
    out = each.groupBy().agg(F.sort_array(F.collect_list(F.struct("attr", "l", "h"))).alias("all_"))
    return out.select(F.col("all_.l").alias("low"), F.col("all_.h").alias("high"))


def grouped_ranges(rows: DataFrame, dim: int, *keys: str) -> DataFrame:
    """keys, n, low and high, for each value of the keys (or one row). Missing values do not count."""
    if dim <= 8:
        x = [F.nanvl(F.col("features")[i], F.lit(None).cast("double")) for i in range(dim)]
        out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.min(x[i]).alias(f"l{i}") for i in range(dim)], *[F.max(x[i]).alias(f"h{i}") for i in range(dim)])
        return out.select(*keys, "n", F.array(*[f"l{i}" for i in range(dim)]).alias("low"), F.array(*[f"h{i}" for i in range(dim)]).alias("high"))
    long = rows.select(*keys, F.posexplode("features").alias("attr", "x")).withColumn("x", F.nanvl("x", F.lit(None).cast("double"))).groupBy(*keys, "attr").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("l"), F.max("x").alias("h"))
    out = long.groupBy(*keys).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("attr", "l", "h"))).alias("all_"))
    return out.select(*keys, "n", F.col("all_.l").alias("low"), F.col("all_.h").alias("high"))


def widen(ranges: DataFrame, row: DataFrame) -> DataFrame:
    """Ranges after one more row (or several: each is one more)."""
    one = row.select(F.col("features").alias("x"))
    both = ranges.join(F.broadcast(one.groupBy().agg(F.collect_list("x").alias("xs"))))
    return both.select(
        F.aggregate("xs", F.col("low"), lambda s, x: F.zip_with(s, x, lambda a, b: F.least(a, b))).alias("low"),
        F.aggregate("xs", F.col("high"), lambda s, x: F.zip_with(s, x, lambda a, b: F.greatest(a, b))).alias("high"),
    )


def with_ranges(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """Adds low and high to each row; ranges is one row of 2 * dim doubles, so it is broadcast."""
    return rows.crossJoin(F.broadcast(ranges))
