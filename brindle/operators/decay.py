"""Running statistics that forget: the n-th value of a key counts 1 / min(n, decay) in its mean.

The means have a closed form, so they are one weighted sum by key. The histogram puts each value in a bin of the means and
deviations at its time, so it is a fold in order: a task goes over its keys' rows batch by batch and holds one state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rptree import SMALL, TAILS, Stats
from .windows import as_number, range_bounds, range_place


def numbered(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """Adds n, the number of a row among its key's from 1, and total, that of the last. Rows are counted within ranges of seq and offset, so a key may have any number."""
    number = as_number(rows, seq)
    rows = rows.withColumn("_range", range_place(number, range_bounds(rows, number)))
    counts = rows.groupBy(key, "_range").agg(F.count(F.lit(1)).alias("_c"))
    before = F.sum("_c").over(Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # a row a key and range
    counts = counts.withColumn("_before", F.coalesce(before, F.lit(0))).withColumn("total", F.sum("_c").over(Window.partitionBy(key))).drop("_c")
    inside = F.row_number().over(Window.partitionBy(key, "_range").orderBy(seq))
    return rows.withColumn("_in", inside).join(counts, [key, "_range"]).withColumn("n", F.col("_in") + F.col("_before")).drop("_range", "_in", "_before")


def decayed_means(rows: DataFrame, key: str, seq: str, value: str, decay: int) -> DataFrame:
    """key, n, mean, square and sum: decayed means of the values and their squares, and the plain sum, after all rows of the key."""
    n, total, d = F.col("n"), F.col("total"), float(decay)
    kept = F.pow(F.lit(1 - 1 / d), (total - F.greatest(n, F.lit(decay))).cast("double"))  # what later values left of it
    weight = F.when(total <= decay, 1 / total).otherwise(kept / d)
    x = F.col(value)
    return numbered(rows, key, seq).groupBy(key).agg(F.max("total").alias("n"), F.sum(weight * x).alias("mean"), F.sum(weight * x * x).alias("square"), F.sum(x).alias("sum"))


def decaying_histogram(rows: DataFrame, key: str, seq: str, value: str, decay: int) -> DataFrame:
    """key, bin, weight: 8 bins within one deviation of the mean (0 to 7), then 6 pairs of bins, left and right, of one deviation each (8 to 19)."""
    schema = T.StructType([rows.schema[key], T.StructField("bin", T.IntegerType()), T.StructField("weight", T.DoubleType())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, stats = None, None

        def line() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([own] * (SMALL + 2 * TAILS), kind), pa.array(range(SMALL + 2 * TAILS), pa.int32()), pa.array(np.concatenate([stats.small[0], stats.tail[0].ravel()]))], names=schema.names)

        for batch in batches:
            kind = batch.schema.field(0).type
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if stats is None or k != own:
                    if stats is not None:
                        yield line()
                    own, stats = k, Stats(1, decay)
                if x is not None:
                    stats.add(np.array([x]))
        if stats is not None:
            yield line()

    return rows.repartition(key).sortWithinPartitions(key, seq).select(key, F.col(value).cast("double").alias("x")).mapInArrow(fold, schema)
