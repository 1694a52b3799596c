"""KD trees: level-wise building as grouped minima and maxima, and exact search by bounding boxes.

A tree is a table of splits in heap numbering, held as arrays of bounded size. A row's node follows from the arrays, so a
level is one scan of the source that sends one row a node and task: no row is assigned by a join, and no level repeats
the work of those before. The search scans the window twice, each time with every query only against the leaves it needs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import Header
from .blocked import MOST_BROADCAST, Metric, Nearest, matrix
from .knn import known_ranges
from .ranges import feature_ranges
from .topk import top_k

#: Bytes of the boxes of one level, which bound the depth.
MOST_BOXES = 64 << 20
_BOXES = "node long, n long, low array<double>, high array<double>"


@dataclass
class Tree:
    """Splits by node: the feature (-1: a leaf) and the value; what is above goes right. Features are those that `metric` has scaled."""

    metric: Metric
    feature: dict[int, int] = field(default_factory=dict)
    value: dict[int, float] = field(default_factory=dict)
    boxes: dict[int, tuple[int, np.ndarray, np.ndarray]] = field(default_factory=dict)  # leaves: rows, low, high

    def nodes(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each scaled row, descending all rows level by level."""
        node = np.zeros(len(x), np.int64)
        if not self.feature:
            return node
        size = max(self.feature) + 1
        feature, value = np.full(size, -1), np.zeros(size)
        feature[list(self.feature)], value[list(self.value)] = list(self.feature.values()), list(self.value.values())
        live = np.arange(len(x))
        while len(live):
            at = node[live]
            live = live[(at < size) & (feature[np.minimum(at, size - 1)] >= 0)]
            at = node[live]
            node[live] = 2 * at + 1 + (x[live, feature[at]] > value[at])
        return node

    def gaps(self, q: np.ndarray, leaves: list[int]) -> np.ndarray:
        """Squared distances of scaled rows to the boxes of leaves."""
        out = np.zeros((len(q), len(leaves)))
        for i, leaf in enumerate(leaves):
            _, low, high = self.boxes[leaf]
            gap = np.maximum(np.maximum(low - q, q - high), 0.0)
            for f in range(q.shape[1]):
                out[:, i] += gap[:, f] * gap[:, f]
        return out


def node_boxes(rows: DataFrame, tree: Tree) -> DataFrame:
    """node, n, low, high of the rows' scaled features: grouped in each task first."""
    dim = len(tree.metric.types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = tree.metric.scaled(matrix(batch.column(0), dim))
            node = tree.nodes(x)
            order = np.argsort(node, kind="stable")
            cut = np.flatnonzero(np.diff(node[order], prepend=-1))
            low, high, n = np.fmin.reduceat(x[order], cut), np.fmax.reduceat(x[order], cut), np.diff([*cut, len(order)])
            for i, at in enumerate(node[order][cut].tolist()):
                own = held.get(at)
                held[at] = [int(n[i]), low[i], high[i]] if own is None else [own[0] + int(n[i]), np.fmin(own[1], low[i]), np.fmax(own[2], high[i])]
        lists = pa.list_(pa.float64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.int64()), pa.array([v[0] for v in held.values()], pa.int64()), pa.array([v[1] for v in held.values()], lists), pa.array([v[2] for v in held.values()], lists)],
            names=["node", "n", "low", "high"],
        )

    parts = rows.select("features").mapInArrow(run, _BOXES)
    bound = lambda f, c: [f(F.col(c)[i]).alias(f"{c}{i}") for i in range(dim)]
    if dim <= 8:
        out = parts.groupBy("node").agg(F.sum("n").alias("n"), *bound(F.min, "low"), *bound(F.max, "high"))
        return out.select("node", "n", F.array(*[f"low{i}" for i in range(dim)]).alias("low"), F.array(*[f"high{i}" for i in range(dim)]).alias("high"))
    long = parts.select("node", "n", F.posexplode(F.arrays_zip("low", "high")).alias("attr", "b"))
    long = long.groupBy("node", "attr").agg(F.sum("n").alias("n"), F.min("b.low").alias("l"), F.max("b.high").alias("h"))
    out = long.groupBy("node").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("attr", "l", "h"))).alias("all_"))
    return out.select("node", "n", F.col("all_.l").alias("low"), F.col("all_.h").alias("high"))


def most_depth(dim: int) -> int:
    """Levels whose boxes fit in MOST_BOXES."""
    return max(1, int(np.log2(MOST_BOXES / (16 * dim + 32))))


def build(rows: DataFrame, metric: Metric, leaf: int = 256, depth: int | None = None) -> Tree:
    """Splits nodes of more than `leaf` rows at the middle of the feature that is widest as a share of its whole range, lower ones first.

    depth: levels of splits at most; if not given, as many as `leaf` needs and the boxes of a level allow. One scan a level."""
    dim, total = len(metric.types), None
    tree, most = Tree(metric), most_depth(dim) if depth is None else min(depth, most_depth(dim))
    for level in range(most + 1):
        found = node_boxes(rows, tree).toArrow()  # at most 2^level rows
        grown = False
        for node, n, low, high in zip(found["node"].to_pylist(), found["n"].to_pylist(), matrix(found["low"], dim), matrix(found["high"], dim)):
            total = high - low if total is None else total
            tree.boxes[node] = (n, low, high)
            share = np.divide(high - low, total, out=np.zeros(dim), where=total > 0)
            best = int(np.argmax(np.nan_to_num(share)))
            if n > leaf and share[best] > 0 and level < most:
                tree.feature[node], tree.value[node] = best, float((low[best] + high[best]) / 2)
                grown = True
        if not grown:
            break
    tree.boxes = {node: box for node, box in tree.boxes.items() if node not in tree.feature}
    return tree


def split_table(spark, tree: Tree) -> DataFrame:
    """node, split_dim, split_val."""
    return spark.createDataFrame([(n, f, tree.value[n]) for n, f in sorted(tree.feature.items())], "node long, split_dim int, split_val double")


def visiting(window: DataFrame, queries: tuple[pa.Array, np.ndarray], visits: np.ndarray, leaves: list[int], tree: Tree, k: int) -> DataFrame:
    """At least the k nearest of each query among the rows of the leaves that it visits (queries x leaves), those of each task."""
    ids, q = queries
    carry, dim = ("id", "label", "weight"), len(tree.metric.types)
    place = {leaf: i for i, leaf in enumerate(leaves)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Nearest(ids, q, tree.metric, k)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("features"), dim)
            node = tree.nodes(tree.metric.scaled(x))
            order = np.argsort(node, kind="stable")
            cut = np.flatnonzero(np.diff(node[order], prepend=-1))
            for begin, end in zip(cut, [*cut[1:], len(order)]):
                own = order[begin:end]
                which = np.flatnonzero(visits[:, place[int(node[own[0]])]])
                if len(which):
                    best.add(batch.select(list(carry)).take(pa.array(own)), x[own], which)
        if out := best.table("distance"):
            yield from out.combine_chunks().to_batches()

    schema = T.StructType([T.StructField("query_id", T.LongType()), *[window.schema[c] for c in carry], T.StructField("distance", T.DoubleType())])
    return window.select(*carry, "features").mapInArrow(run, schema)


def _search(queries: pa.Table, window: DataFrame, tree: Tree, k: int) -> tuple[DataFrame, np.ndarray, list[int]]:
    dim, leaves = len(tree.metric.types), sorted(tree.boxes)
    ids, raw = queries.column("id").combine_chunks(), matrix(queries.column("features"), dim)
    gaps = tree.gaps(tree.metric.scaled(raw), leaves)
    # the nearest leaves that hold k rows together
    order = np.argsort(gaps, axis=1, kind="stable")
    held = np.cumsum(np.array([tree.boxes[leaf][0] for leaf in leaves])[order], axis=1)
    enough = np.minimum((held < k).sum(1), len(leaves) - 1)
    near = np.zeros(gaps.shape, bool)
    np.put_along_axis(near, order, np.arange(len(leaves)) <= enough[:, None], 1)
    found = top_k(visiting(window, (ids, raw), near, leaves, tree, k), k)
    bounds = found.groupBy("query_id").agg(F.max("distance").alias("bound"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k).toArrow()  # a row a query
    bound = dict(zip(bounds["query_id"].to_pylist(), bounds["bound"].to_pylist()))
    limit = np.array([bound.get(i, np.inf) for i in ids.to_pylist()])
    visits = ~(gaps > (limit * (1 + 1e-9))[:, None])
    return top_k(visiting(window, (ids, raw), visits, leaves, tree, k), k), visits, leaves


def prepared(window: DataFrame, header: Header, leaf: int = 256, depth: int | None = None) -> Tree:
    """The tree of a window, scaled by its ranges."""
    low, high = known_ranges(feature_ranges(window, header.dim))
    return build(window, Metric(header.types, *((low, high) if len(low) else (np.zeros(header.dim),) * 2)), leaf, depth)


def knn_kdtree(queries: DataFrame, window: DataFrame, header: Header, k: int = 10, leaf: int = 256, tree: Tree | None = None, most: int = MOST_BROADCAST) -> DataFrame:
    """The exact k nearest, in two scans: the nearest leaves that hold k rows together bound the k-th distance; then all leaves
    whose box is not beyond it. Queries (a stated set) go to the tasks in blocks of `most`."""
    tree = tree or prepared(window, header, leaf)
    q, out = queries.select(F.col("id").cast("long").alias("id"), "features"), None
    blocks = max(1, -(-q.count() // most))
    for block in range(blocks):
        part = q.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).toArrow()  # about `most` rows
        found = _search(part, window, tree, k)[0] if part.num_rows else None
        out = found if out is None else out if found is None else out.unionByName(found)
    if out is None:
        return top_k(visiting(window, (pa.array([], pa.int64()), np.zeros((0, header.dim))), np.zeros((0, len(tree.boxes)), bool), sorted(tree.boxes), tree, k), k)
    return out


def work_log(queries: DataFrame, window: DataFrame, header: Header, k: int = 10, leaf: int = 256) -> DataFrame:
    """What the search does for each query: query_id, compared (distances), leaf_size (mean of the leaves visited), leaves."""
    tree = prepared(window, header, leaf)
    part = queries.select(F.col("id").cast("long").alias("id"), "features").limit(MOST_BROADCAST).toArrow()
    _, visits, leaves = _search(part, window, tree, k)
    sizes = np.array([tree.boxes[x][0] for x in leaves], float)
    rows = [(i, int(v @ sizes), float(sizes[v].mean()), int(v.sum())) for i, v in zip(part["id"].to_pylist(), visits)]
    return queries.sparkSession.createDataFrame(rows, "query_id long, compared long, leaf_size double, leaves long")
