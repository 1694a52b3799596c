"""Online random-projection trees: learnt row by row from a bounded window, then used as a leaf column.

A node keeps decaying means and histograms of the projections of the rows that pass it. It first splits where the means
of the two sides are furthest apart; from time to time it is tried whether a projection has heavy tails, and then rows
near the mean are parted from those far away, which is the node's last split.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as V
from .blocked import matrix
from .projections import uniform_vectors
from .topk import top_k

# Fixed values of the learning rules.
WARM, SETTLED, AGAIN, DECAY = 50, 100, 250, 65_536  # rows before histograms, before the first split, between tries of a centre split; decay
SMALL, TAILS = 8, 6  # bins within one deviation of the mean; bins of one deviation on each side
LEAST_TAIL, TAIL_FACTOR = 0.05, 10.0

_erf = np.vectorize(math.erf, otypes=[float])
_ROOT2 = math.sqrt(2)


def decayed(n: int, decay: int = DECAY) -> float:
    """The share of the n-th row in a running mean."""
    return 1 / min(n, decay)


@dataclass
class Stats:
    """Running means, square means and histograms of p projections. small: bins within one deviation of the mean; tail: bins of
    one deviation beyond, left and right, the last one open."""

    p: int
    decay: int = DECAY
    n: int = 0
    mean: np.ndarray = field(default=None)
    square: np.ndarray = field(default=None)
    small: np.ndarray = field(default=None)
    tail: np.ndarray = field(default=None)

    def __post_init__(self):
        self.mean, self.square = np.zeros(self.p), np.zeros(self.p)
        self.small, self.tail = np.zeros((self.p, SMALL)), np.zeros((self.p, TAILS, 2))

    @property
    def deviation(self) -> np.ndarray:
        return np.sqrt(np.abs(self.square - self.mean**2))

    def add(self, x: np.ndarray) -> None:
        self.n += 1
        a = decayed(self.n, self.decay)
        self.mean, self.square = self.mean * (1 - a) + x * a, self.square * (1 - a) + x * x * a
        if self.n <= WARM:
            return
        a, dev, off = decayed(self.n - WARM + 1, self.decay), self.deviation, x - self.mean
        self.small *= 1 - a
        self.tail *= 1 - a
        inside = (np.abs(off) < dev) | (dev == 0)
        wide = np.where(dev > 0, dev, 1.0)
        at = np.minimum(np.where(dev > 0, (off + dev) * SMALL / (2 * wide), 0).astype(int), SMALL - 1)
        far = np.clip((np.abs(off) / wide).astype(int) - 1, 0, TAILS - 1)
        k = np.arange(self.p)
        self.small[k[inside], at[inside]] += a
        self.tail[k[~inside], far[~inside], (off[~inside] >= 0).astype(int)] += a

    def first_split(self) -> tuple[int, float] | None:
        """Projection and threshold, a bin's edge, that part rows best: weights of the sides times the squared gap of their means; earlier ones first."""
        mean, dev = self.mean[:, None], self.deviation[:, None]
        centre = mean - dev + 2 * (np.arange(SMALL) + 0.5) / SMALL * dev
        reach = (np.arange(TAILS) + 1.5) * dev
        weight = np.concatenate([np.zeros((self.p, 1)), np.cumsum(self.small, 1)], 1)
        moment = np.concatenate([np.zeros((self.p, 1)), np.cumsum(self.small * centre, 1)], 1)
        left = weight + self.tail[:, :, 0].sum(1, keepdims=True)
        right = weight[:, -1:] - weight + self.tail[:, :, 1].sum(1, keepdims=True)
        m_left = moment + (self.tail[:, :, 0] * (mean - reach)).sum(1, keepdims=True)
        m_right = moment[:, -1:] - moment + (self.tail[:, :, 1] * (mean + reach)).sum(1, keepdims=True)
        with np.errstate(invalid="ignore", divide="ignore"):
            gain = np.nan_to_num(left * right * (m_left / left - m_right / right) ** 2, nan=0.0, posinf=0.0)
        k = int(np.argmax(gain.max(1)))
        edge = int(np.argmax(gain[k]))
        return (k, float(self.mean[k] - self.deviation[k] + edge * self.deviation[k] * 2 / SMALL)) if gain[k, edge] > 0 else None

    def heavy_tail(self) -> int | None:
        """The first projection with more beyond some deviation than a normal one could have, by the fixed factor."""
        beyond = np.cumsum(self.tail.sum(2)[:, ::-1], 1)[:, ::-1]
        allowed = np.maximum(LEAST_TAIL, TAIL_FACTOR * (1 - _erf(np.arange(TAILS) / _ROOT2)))
        found = np.flatnonzero((beyond > allowed).any(1))
        return int(found[0]) if len(found) else None

    def likelihood(self, k: int, step: int) -> float | None:
        """Log-likelihood of two normals, one for bins within `step` of the middle and one for the others; None where one has no spread."""
        mean, dev, middle = self.mean[k], self.deviation[k], SMALL // 2
        j, t = np.arange(SMALL), np.arange(TAILS)
        weight = np.concatenate([self.small[k], self.tail[k, :, 0], self.tail[k, :, 1]])
        reach = (t // 2 + 1.5) * dev  # fixed: two tail bins share a middle here
        centre = np.concatenate([mean - dev + 2 * (j + 0.5) / SMALL * dev, mean - reach, mean + reach])
        low = np.concatenate([mean + (-1 + j * 2 / SMALL) * dev, mean - (t + 2) * dev, mean + (t + 1) * dev])
        high = np.concatenate([mean + (-1 + (j + 1) * 2 / SMALL) * dev, mean - (t + 1) * dev, mean + (t + 2) * dev])
        outer = t >= step - middle - 0.5
        outside = np.concatenate([np.abs(j - middle + 0.5) > step, outer, outer])
        total = 0.0
        for part in (~outside, outside):
            w = weight[part]
            if w.sum() <= 0:
                return None
            m = (w @ centre[part]) / w.sum()
            spread = math.sqrt(max(0.0, (w @ centre[part] ** 2) / w.sum() - m * m))
            if spread == 0:
                return None
            share = (_erf((high[part] - m) / spread / _ROOT2) - _erf((low[part] - m) / spread / _ROOT2)) / 2
            seen = w > 0
            with np.errstate(divide="ignore"):
                gained = w[seen] * np.log(share[seen])
            small = (np.flatnonzero(part) < SMALL)[seen]
            total += float(gained[small | (share[seen] > 0)].sum())
        return total

    def centre_split(self) -> tuple[int, float] | None:
        """Projection and distance from the mean, in steps of bins, with the best likelihood below 0."""
        k = self.heavy_tail()
        if k is None:
            return None
        middle = SMALL // 2
        tried = [(score, -step) for step in range(1, middle + TAILS - 2) if (score := self.likelihood(k, step)) is not None and score < 0]
        if not tried:
            return None
        step = -max(tried)[1]
        return k, float(((step - middle + 1) if step > middle else step * 2 / SMALL) * self.deviation[k])


class RpTree:
    """depth levels of nodes in heap numbering. A node splits at a threshold (above goes right), later at a distance from its running mean (inside goes right)."""

    def __init__(self, dim: int, depth: int = 8, projections: int = 20, seed: int = 1, vectors: np.ndarray | None = None):
        self.vectors, self.depth = uniform_vectors(projections, dim, seed) if vectors is None else vectors, depth
        self.stats: dict[int, Stats] = {}
        self.split: dict[int, tuple[str, int, float]] = {}

    def learn(self, row: np.ndarray) -> None:
        x, node = self.vectors @ np.nan_to_num(row), 0
        for _ in range(self.depth - 1):
            s = self.stats.setdefault(node, Stats(len(self.vectors)))
            s.add(x)
            if s.n == SETTLED and (first := s.first_split()):
                self.split[node] = ("median", *first)
            central = self.split.get(node, ("",))[0] == "centre"
            if s.n > SETTLED and not central and (s.n - SETTLED + 1) % AGAIN == 0 and (centre := s.centre_split()):
                self.forget(node)
                self.split[node] = ("centre", *centre)
            if node not in self.split:
                return
            kind, k, at = self.split[node]
            right = x[k] > at if kind == "median" else abs(x[k] - s.mean[k]) < at
            node = 2 * node + 1 + int(right)

    def forget(self, node: int) -> None:
        """What the descendants of a node have learnt."""
        todo = [2 * node + 1, 2 * node + 2]
        while todo:
            child = todo.pop()
            if (self.stats.pop(child, None), self.split.pop(child, None)) != (None, None):
                todo += [2 * child + 1, 2 * child + 2]

    def _arrays(self) -> tuple[np.ndarray, ...]:
        """By node: 0 leaf, 1 median, 2 centre; projection; threshold; mean."""
        kind, k, at, mean = (np.zeros(2**self.depth, t) for t in (int, int, float, float))
        for node, (name, p, threshold) in self.split.items():
            kind[node], k[node], at[node], mean[node] = 1 if name == "median" else 2, p, threshold, self.stats[node].mean[p]
        return kind, k, at, mean

    def leaves(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row, descending all rows level by level."""
        x, node, rows_ = np.nan_to_num(rows) @ self.vectors.T, np.zeros(len(rows), np.int64), np.arange(len(rows))
        kind, k, at, mean = self._arrays()
        for _ in range(self.depth):
            value = x[rows_, k[node]]
            right = np.where(kind[node] == 1, value > at[node], np.abs(value - mean[node]) < at[node])
            node = np.where(kind[node] > 0, 2 * node + 1 + right, node)
        return node

    def reach(self, rows: np.ndarray, radius: np.ndarray) -> list[list[int]]:
        """Leaves that rows within `radius` of each row can be in: a projection moves by at most the vector's length times it."""
        x, lengths = np.nan_to_num(rows) @ self.vectors.T, np.linalg.norm(self.vectors, axis=1)
        kind, k, at, mean = self._arrays()
        open_ = {0: np.ones(len(rows), bool)}
        for node in range(2 ** (self.depth - 1)):
            if kind[node] and node in open_:
                own, room = open_.pop(node), radius * lengths[k[node]] * (1 + 1e-9)
                value = x[:, k[node]]
                gap = value - at[node] if kind[node] == 1 else at[node] - np.abs(value - mean[node])
                open_[2 * node + 1], open_[2 * node + 2] = own & ~(gap > room), own & ~(gap < -room)
        nodes = np.array(sorted(open_))
        seen = np.array([open_[n] for n in nodes]).T
        return [nodes[own].tolist() for own in seen]


def fit(rows: DataFrame, dim: int, window: int = 65535, seq: str = "seq", **options) -> RpTree:
    """Learns from the first `window` rows of the stream, in order: the bound of what is collected."""
    tree = RpTree(dim, **options)
    for x in matrix(rows.orderBy(seq).limit(window).select("features").toArrow().column("features"), dim):
        tree.learn(x)
    return tree


def with_leaf(rows: DataFrame, tree: RpTree) -> DataFrame:
    """Adds leaf, for every row."""
    dim = tree.vectors.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.leaves(matrix(batch.column("features"), dim)) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=[*batch.schema.names, "leaf"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("leaf", T.LongType())]))


def _own_leaf(q: DataFrame, w: DataFrame, types: tuple[int, ...], k: int) -> DataFrame:
    return top_k(q.join(w, "leaf").withColumn("distance", V.squared_distance("q", "features", types)), k)


def _visits(q: DataFrame, own: DataFrame, tree: RpTree, k: int) -> DataFrame:
    """query_id, q, leaf: the leaves that can hold a row nearer than the k-th of the query's own leaf."""
    dim = tree.vectors.shape[1]
    bound = own.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.sqrt(F.max("distance"))).otherwise(float("inf")).alias("radius"))
    wide = q.join(bound, "query_id", "left").fillna(float("inf"), ["radius"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reach = tree.reach(matrix(batch.column("q"), dim), batch.column("radius").to_numpy()) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("q"), pa.array(reach, pa.list_(pa.int64()))], names=["query_id", "q", "leaves"])

    return wide.select("query_id", "q", "radius").mapInArrow(visit, "query_id long, q array<double>, leaves array<long>").select("query_id", "q", F.explode("leaves").alias("leaf"))


def _sides(queries: DataFrame, window: DataFrame, tree: RpTree) -> tuple[DataFrame, DataFrame]:
    q = with_leaf(queries.select(F.col("id").alias("query_id"), "features"), tree).withColumnRenamed("features", "q")
    return q, with_leaf(window.select("id", "label", "weight", "features"), tree)


def knn_rptree(queries: DataFrame, window: DataFrame, tree: RpTree, dim: int, k: int = 5, defeatist: bool = False) -> DataFrame:
    """The k nearest (plain squared distance): in the query's own leaf only if defeatist, by an equi-join on the leaf; else exact, as the
    k-th distance in the own leaf bounds which leaves can hold nearer rows."""
    q, w = _sides(queries, window, tree)
    types, cols = (0,) * dim, ("query_id", "id", "label", "weight", "distance", "place")
    own = _own_leaf(q, w, types, k)
    if defeatist:
        return own.select(*cols)
    near = _visits(q, own, tree, k)
    return top_k(near.join(w, "leaf").withColumn("distance", V.squared_distance("q", "features", types)), k).select(*cols)


def work_log(queries: DataFrame, window: DataFrame, tree: RpTree, dim: int, k: int = 5) -> DataFrame:
    """What the exact search does for each query: query_id, compared (distances), leaf_size (mean of the leaves visited), leaves."""
    q, w = _sides(queries, window, tree)
    sizes = w.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))
    visits = _visits(q, _own_leaf(q, w, (0,) * dim, k), tree, k).join(sizes, "leaf")
    return visits.groupBy("query_id").agg(F.sum("n").alias("compared"), F.avg("n").alias("leaf_size"), F.count(F.lit(1)).alias("leaves"))
