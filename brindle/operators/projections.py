"""Random projections: sparse sign matrices, Walsh-Hadamard transforms, and their use on rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as V
from .blocked import matrix


def sign_matrix(k: int, n: int, seed: int = 1) -> np.ndarray:
    """k x n: +-sqrt(3) with probability 1/6 each, else 0 (Achlioptas); scaled by 1 / sqrt(k)."""
    u = np.random.default_rng(seed).random((k, n))
    return np.where(u < 1 / 6, math.sqrt(3), np.where(u < 1 / 3, -math.sqrt(3), 0.0)) / math.sqrt(k)


def uniform_vectors(k: int, n: int, seed: int = 1) -> np.ndarray:
    return np.random.default_rng(seed).random((k, n))


def project(rows: DataFrame, matrix: np.ndarray, out: str = "projected") -> DataFrame:
    """Adds matrix x features (missing values as 0). The matrix is part of the generated code: k * n constants."""
    terms = [" + ".join(["0.0D", *[f"{float(w)!r}D * _x[{i}]" for i, w in enumerate(row) if w]]) for row in matrix]
    return rows.withColumn("_x", V.nan_to_zero(F.col("features"))).withColumn(out, F.expr(f"array({', '.join(terms)})")).drop("_x")


def projected(x: np.ndarray, matrix_: np.ndarray) -> np.ndarray:
    """The products of project(), the same sums, of a block of rows; a missing value is NaN."""
    x = np.nan_to_num(x, nan=0.0, posinf=0.0, neginf=0.0).T
    y = np.zeros((len(matrix_), x.shape[1]))
    for r, row in enumerate(matrix_):
        for i in np.flatnonzero(row):
            y[r] += row[i] * x[i]
    return y.T


def project_all(rows: DataFrame, matrix_: np.ndarray) -> DataFrame:
    """The features, a missing one as NaN, followed by their products, from Arrow batches, as so many terms would not compile."""
    dim = matrix_.shape[1] + len(matrix_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(0), matrix_.shape[1])
            both = np.concatenate([x, projected(x, matrix_)], 1)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * dim), pa.array(both.ravel()))], names=["features"])

    return rows.select("features").mapInArrow(run, "features array<double>")


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows of x, whose length is a power of two; unscaled."""
    x, h = x.copy(), 1
    n = x.shape[1]
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.concatenate([(y[:, :, 0] + y[:, :, 1])[:, :, None], (y[:, :, 0] - y[:, :, 1])[:, :, None]], 2).reshape(len(x), n)
        h *= 2
    return x


def fjlt_parts(n: int, k: int, seed: int = 1) -> tuple[int, np.ndarray, np.ndarray]:
    """Padded length, random signs, and k places drawn without replacement."""
    rng, padded = np.random.default_rng(seed), 1 << max(0, (n - 1).bit_length())
    return padded, rng.choice([-1.0, 1.0], padded), np.sort(rng.choice(padded, k, replace=False))


def fjlt(rows: DataFrame, n: int, k: int, seed: int = 1, single: bool = False, out: str = "projected") -> DataFrame:
    """Adds the fast Johnson-Lindenstrauss transform of features: missing as 0, padded, random signs, Walsh-Hadamard, k sampled places, scaled by 1 / sqrt(k).

    Rows are independent of each other; they pass through Arrow batches."""
    padded, signs, places = fjlt_parts(n, k, seed)
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.ArrayType(T.FloatType() if single else T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.zeros((batch.num_rows, padded))
            if batch.num_rows:
                values = np.array([[0.0 if v is None else v for v in row] for row in batch.column("features").to_pylist()], float)
                x[:, :n] = np.nan_to_num(values, nan=0.0, posinf=0.0, neginf=0.0)
            y = (hadamard(x * signs)[:, places] / math.sqrt(k)).astype(np.float32 if single else np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(y), pa.list_(pa.float32() if single else pa.float64()))], names=schema.names)

    return rows.mapInArrow(run, schema)
