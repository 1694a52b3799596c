"""The data model: instances are rows of id, features, label and weight; a header names and types the features."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMERIC, NOMINAL = 0, 1


@dataclass(frozen=True)
class Header:
    """Types of the features, 0 numeric and anything else nominal; number of classes, 0 for a numeric class."""

    types: tuple[int, ...]
    n_classes: int = 0

    @property
    def dim(self) -> int:
        return len(self.types)

    @classmethod
    def numeric(cls, dim: int, n_classes: int = 0) -> Header:
        return cls((NUMERIC,) * dim, n_classes)


def instances(df: DataFrame, id_col: str, features: str | Column, label: str | Column | None = None, weight: str | Column | None = None) -> DataFrame:
    """id, features (array of double), label, weight. A missing value (null or NaN) stays NaN."""
    col = lambda x: F.col(x) if isinstance(x, str) else x
    return df.select(
        F.col(id_col).alias("id"),
        col(features).cast("array<double>").alias("features"),
        (col(label) if label is not None else F.lit(None).cast("double")).alias("label"),
        (col(weight) if weight is not None else F.lit(1.0)).cast("double").alias("weight"),
    )


def dense_index(df: DataFrame, value: str, out: str) -> DataFrame:
    """Adds out, the dense index from 0 of a nominal value in its own order. The list of distinct values is what is sorted, not the rows."""
    from pyspark.sql import Window

    names = df.select(value).distinct().withColumn(out, (F.row_number().over(Window.orderBy(value)) - 1).cast("int"))
    return df.join(names, value)
