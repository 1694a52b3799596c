"""Instance generators over spark.range: every value is a hash of seed, row and place, so streams restart and split at will."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(row: Column, place: int, seed: int) -> Column:
    """U[0, 1) of a row and a place, as multiples of 2^-52, from an md5; the same in any engine."""
    text = F.concat(F.lit(f"{seed}:{place}:"), row.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / float(2**52)


def tree_nodes(nominals: int = 5, values: int = 5, numerics: int = 5, classes: int = 2, depth: int = 5, seed: int = 1) -> tuple | int:
    """A random tree: (feature, value, below, above) or the class of a leaf."""
    rng = np.random.default_rng(seed)

    def node(level: int) -> tuple | int:
        if level == depth:
            return int(rng.integers(classes))
        i = int(rng.integers(nominals + numerics))
        at = float(rng.integers(1, values)) if i < nominals else float(rng.random())
        return i, at, node(level + 1), node(level + 1)

    return node(0)


def tree_sql(**options) -> str:
    """The label of features x (from 1) by the same tree."""
    def text(node: tuple | int) -> str:
        return str(node) if isinstance(node, int) else f"CASE WHEN x[{node[0] + 1}] < {node[1]!r}::DOUBLE THEN {text(node[2])} ELSE {text(node[3])} END"

    return text(tree_nodes(**options))


def random_tree(spark: SparkSession, n: int, nominals: int = 5, values: int = 5, numerics: int = 5, classes: int = 2, depth: int = 5, seed: int = 1) -> DataFrame:
    """Nominal features first, then numeric ones in [0, 1); the label is that of the leaf of a random tree. id, features, label."""
    row = F.col("id")
    x = [F.floor(uniform(row, i, seed) * values).cast("double") for i in range(nominals)] + [uniform(row, nominals + i, seed) for i in range(numerics)]

    def label(node: tuple | int) -> Column:
        if isinstance(node, int):
            return F.lit(node)
        return F.when(F.col("features")[node[0]] < node[1], label(node[2])).otherwise(label(node[3]))

    return spark.range(n).select("id", F.array(*x).alias("features")).withColumn("label", label(tree_nodes(nominals, values, numerics, classes, depth, seed)))


def two_clusters(spark: SparkSession, n: int, dim: int = 7, seed: int = 1) -> DataFrame:
    """Rows around all-zeros or all-ones, each feature off by U[0, 1) / 10; the label is the cluster."""
    row = F.col("id")
    label = F.floor(uniform(row, 1000, seed) * 2).cast("int")
    return spark.range(n).select("id", label.alias("label")).select("id", F.array(*[F.col("label") + uniform(row, i, seed) / 10 for i in range(dim)]).alias("features"), "label")


def mappings(n_mappings: int, base: int, width: int, seed: int = 1) -> np.ndarray:
    """For each mapping, the column of each base feature; columns of different mappings are disjoint."""
    if n_mappings * base > width:
        raise ValueError("the attributes run out")
    return np.random.default_rng(seed).permutation(width)[: n_mappings * base].reshape(n_mappings, base)


def sparse_mapped(rows: DataFrame, base: int, width: int = 1024, n_mappings: int = 10, seed: int = 1) -> DataFrame:
    """id, label, mapping, entries: an array of (col, val) sorted by col; each row takes one mapping. The mapping table has n_mappings * base constants."""
    table = F.array(*[F.array(*[F.lit(int(c)) for c in m]) for m in mappings(n_mappings, base, width, seed)])
    pick = F.floor(uniform(F.col("id"), 2000, seed) * n_mappings).cast("int")
    cols = table[F.col("mapping")]
    entries = F.array_sort(F.transform("features", lambda v, i: F.struct(F.get(cols, i).alias("col"), v.alias("val"))))
    return rows.withColumn("mapping", pick).select("id", "label", "mapping", entries.alias("entries"))


def centres(dim: int, n: int, classes: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places, deviations, classes and cumulated weights of random centres."""
    rng = np.random.default_rng(seed)
    at, spread, label, weight = rng.random((n, dim)), rng.random(n), rng.integers(classes, size=n), rng.random(n)
    return at, spread, label, np.cumsum(weight) / weight.sum()


def radial_basis(spark: SparkSession, n: int, dim: int = 10, n_centres: int = 50, classes: int = 2, seed: int = 1) -> DataFrame:
    """Random radial basis functions: a weighted random centre, a random direction, a normal distance of the centre's own deviation."""
    at, spread, label, edge = centres(dim, n_centres, classes, seed)
    row = F.col("id")
    u = uniform(row, 0, seed)
    pick = F.lit(n_centres - 1)
    for c in reversed(range(n_centres - 1)):
        pick = F.when(u < float(edge[c]), F.lit(c)).otherwise(pick)
    arrays = spark.createDataFrame([(c, at[c].tolist(), float(spread[c]), int(label[c])) for c in range(n_centres)], "c int, centre array<double>, spread double, label int")
    direction = F.array(*[uniform(row, 1 + i, seed) * 2 - 1 for i in range(dim)])
    normal = F.sqrt(-2 * F.log(1 - uniform(row, 500, seed))) * F.cos(2 * np.pi * uniform(row, 501, seed))
    rows = spark.range(n).select("id", pick.alias("c"), direction.alias("direction"), normal.alias("normal")).join(F.broadcast(arrays), "c")
    length = F.sqrt(F.aggregate("direction", F.lit(0.0), lambda s, v: s + v * v))
    return rows.withColumn("length", length).select("id", F.zip_with("centre", "direction", lambda a, d: a + d / F.col("length") * F.col("normal") * F.col("spread")).alias("features"), "label")


def cached_test(rows: DataFrame, test_size: int, seq: str = "seq") -> DataFrame:
    """The first test_size rows, kept for every checkpoint."""
    return rows.filter(F.col(seq) < test_size).persist()
