"""Learners by options: names and defaults of the options, a registry of searches, and training, votes and reset over DataFrames.

A learner is trained by DataFrames of instances (id, features, label, weight), in the order of id, and votes for a
DataFrame of queries: query_id, class, p. What it has learnt is a window (a DataFrame), weights or a tree of bounded size;
what follows from it (ranges, trees) is made when votes are asked for, and dropped when more is trained.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import Header
from . import kdtree, knn, rptree, sgd, votes, windows, zorder
from .blocked import matrix
from .evaluation import metrics

# Names of options, their choices and defaults.
CONTEXTS = ("CPU", "OPENCL", "HSA")
WEIGHTINGS = ("none", "similarity", "inverse")
PROJECTIONS = ("CPU", "ViennaCL MM", "FJLT")


class Options:
    """Choices are checked; a device choice (contextUsed, useGPU, projectionMethod) is accepted and changes nothing, as Spark picks where work runs."""

    choices: dict[str, tuple[str, ...]] = {}

    def __post_init__(self):
        for name, allowed in {"contextUsed": CONTEXTS, **self.choices}.items():
            if hasattr(self, name) and getattr(self, name) not in allowed:
                raise ValueError(f"{name} is one of {', '.join(allowed)}")


@dataclass
class KnnOptions(Options):
    nearestNeighbourSearch: str = "DoubleLinearNN"
    nCurves: int = 10
    k: int = 10
    slidingWindowSize: int = 32768
    distanceWeighting: str = "none"
    contextUsed: str = "CPU"
    choices = {"distanceWeighting": WEIGHTINGS}


@dataclass
class KnnZOrderOptions(Options):
    nearestNeighbourSearch: str = "Z-OrderShift (device curves)"
    nCurves: int = 10
    nTargetDim: int = 4
    k: int = 10
    slidingWindowSize: int = 32768
    distanceWeighting: str = "none"
    contextUsed: str = "CPU"
    choices = {"distanceWeighting": WEIGHTINGS}


@dataclass
class KnnExtendedOptions(Options):
    k: int = 10
    limit: int = 1000
    nearestNeighbourSearch: str = "LinearNN"
    useGPU: bool = False
    contextUsed: str = "CPU"
    choices = {"nearestNeighbourSearch": ("LinearNN", "KDTree")}


@dataclass
class RpTreeOptions(Options):
    defeatist: bool = False
    k: int = 5
    windowSize: int = 65535
    maxTreeDepth: int = 8
    numProjections: int = 20
    contextUsed: str = "CPU"
    projectionMethod: str = "CPU"
    choices = {"projectionMethod": PROJECTIONS}


@dataclass
class SgdOptions(Options):
    workerIndex: int = 0
    workerCount: int = 1
    stagger: int = 10
    updater: str = "DirectUpdater"
    loss: str = "Hinge"
    minibatchSize: int = 1
    contextUsed: str = "CPU"
    choices = {"updater": tuple(sgd.UPDATERS), "loss": tuple(sgd.GRADIENTS)}


@dataclass
class EvaluationOptions(Options):
    """trainSize below 1: no limit; trainTime in seconds."""

    testSize: int = 1_000_000
    trainSize: int = 0
    trainTime: float = 10 * 60 * 60
    sampleFrequency: int = 100_000
    dumpFile: str | None = None
    cacheTest: bool = False


class Search(Protocol):
    """Nearest rows of each query: query_id, id, label, weight, distance, place. options: those of the learner."""

    def __call__(self, queries: DataFrame, window: DataFrame, header: Header, k: int, options: Options) -> DataFrame: ...


def _cosine(queries: DataFrame, window: DataFrame, header: Header, k: int, options: Options) -> DataFrame:
    return knn.knn_cosine(queries, window, header, k).withColumn("distance", 1 - F.col("similarity"))


#: Searches by their option names.
SEARCHES: dict[str, Search] = {
    "DoubleLinearNN": lambda q, w, h, k, o: knn.knn(q, w, h, k),
    "FloatLinearNN": lambda q, w, h, k, o: knn.knn_float(q, w, h, k),
    "Double Cosine Similarity search": _cosine,
    "Z-OrderShift": lambda q, w, h, k, o: zorder.knn_zorder(q, w, h, k, getattr(o, "nCurves", 10)),
    "Z-OrderShift (device curves)": lambda q, w, h, k, o: zorder.knn_zorder(q, w, h, k, getattr(o, "nCurves", 10)),
    "Z-Order + FJLT": lambda q, w, h, k, o: zorder.knn_projected(q, w, h, k, getattr(o, "nCurves", 10), getattr(o, "nTargetDim", 4)),
    "LinearNN": lambda q, w, h, k, o: knn.knn(q, w, h, k),
    "KDTree": lambda q, w, h, k, o: kdtree.knn_kdtree(q, w, h, k),
}


def register_search(name: str, search: Search) -> None:
    """Adds a search of one's own; learners find it by its name."""
    SEARCHES[name] = search


class Learner(Protocol):
    def train(self, rows: DataFrame) -> None: ...

    def votes(self, queries: DataFrame) -> DataFrame: ...

    def reset(self) -> None: ...


class _Windowed:
    """Keeps the last rows, by id."""

    def __init__(self, size: int):
        self.size, self.window, self.seen = size, None, 0

    def train(self, rows: DataFrame) -> None:
        rows = rows.select("id", "features", "label", "weight")
        self.seen += rows.count()
        both = rows if self.window is None else self.window.unionByName(rows)
        if self.seen > self.size:  # at most `size` rows of the window, and the new ones
            placed = windows.with_sequence(both, "id", out="_seq")
            both = windows.ring(placed, self.size, "_seq").drop("_seq", "slot")
        self.window = both
        self.rebuild()

    def rebuild(self) -> None:
        """Drops what follows from the window."""

    def reset(self) -> None:
        self.window, self.seen = None, 0
        self.rebuild()


def _prior(queries: DataFrame, n_classes: int) -> DataFrame:
    p = votes.uniform_prior(n_classes)
    return queries.select(F.col("id").alias("query_id"), F.inline(F.array(*[F.struct(F.lit(c).alias("class"), F.lit(x).alias("p")) for c, x in enumerate(p)])))


class Knn(_Windowed):
    """k nearest neighbours over a sliding window; the uniform prior until the window was filled once (ready_at: another count)."""

    def __init__(self, header: Header, options: KnnOptions | KnnZOrderOptions | None = None, ready_at: int | None = None):
        self.header, self.options = header, options or KnnOptions()
        super().__init__(self.options.slidingWindowSize)
        self.ready_at = self.size if ready_at is None else ready_at

    def neighbours(self, queries: DataFrame) -> DataFrame:
        return SEARCHES[self.options.nearestNeighbourSearch](queries, self.window, self.header, min(self.options.k, min(self.seen, self.size)), self.options)

    def votes(self, queries: DataFrame) -> DataFrame:
        if self.window is None or self.seen < self.ready_at:
            return _prior(queries, self.header.n_classes)
        ids = queries.select(F.col("id").alias("query_id"))
        return votes.class_votes(self.neighbours(queries), self.header.n_classes, min(self.seen, self.size), self.header.dim + 1, self.options.distanceWeighting, missing=ids)


class KnnExtended(_Windowed):
    """The same with plain counts as votes, k no more than the window holds, and the choice of a linear or a KD-tree search; a KD tree lasts until more is trained."""

    def __init__(self, header: Header, options: KnnExtendedOptions | None = None):
        self.header, self.options, self.tree = header, options or KnnExtendedOptions(), None
        super().__init__(self.options.limit)

    def rebuild(self) -> None:
        self.tree = None

    def votes(self, queries: DataFrame) -> DataFrame:
        if self.window is None:
            return queries.select(F.col("id").alias("query_id"), F.lit(0).alias("class"), F.lit(0).alias("votes")).limit(0)
        k = min(self.options.k, self.seen, self.size)
        if self.options.nearestNeighbourSearch == "KDTree":
            self.tree = self.tree or kdtree.prepared(self.window, self.header)
            return votes.raw_votes(kdtree.knn_kdtree(queries, self.window, self.header, k, tree=self.tree))
        return votes.raw_votes(SEARCHES[self.options.nearestNeighbourSearch](queries, self.window, self.header, k, self.options))


class RpTreeLearner(_Windowed):
    """Neighbours in the leaves of a random-projection tree that learns every row, in order; votes are plain counts."""

    def __init__(self, header: Header, options: RpTreeOptions | None = None, seed: int = 1):
        self.header, self.options, self.seed = header, options or RpTreeOptions(), seed
        self._fresh()
        super().__init__(self.options.windowSize)

    def _fresh(self) -> None:
        self.tree = rptree.RpTree(self.header.dim, self.options.maxTreeDepth, self.options.numProjections, self.seed)

    def train(self, rows: DataFrame) -> None:
        first = rows.orderBy("id").limit(self.options.windowSize).select("features").toArrow()  # at most a window of rows
        for x in matrix(first.column("features"), self.header.dim):
            self.tree.learn(x)
        super().train(rows)

    def votes(self, queries: DataFrame) -> DataFrame:
        return votes.raw_votes(rptree.knn_rptree(queries, self.window, self.tree, self.header.dim, self.options.k, self.options.defeatist))

    def reset(self) -> None:
        self._fresh()
        super().reset()


class Sgd:
    """One-vs-all linear models by mini-batches; rows of a last mini-batch that is not full wait for the next ones to come."""

    def __init__(self, header: Header, options: SgdOptions | None = None, rate: float = 1e-4, tau: float = 1.0):
        self.header, self.options, self.rate, self.tau = header, options or SgdOptions(), rate, tau
        self.reset()

    def reset(self) -> None:
        o, start = self.options, np.zeros((self.header.n_classes, self.header.dim + 1))
        self.updater = sgd.UPDATERS[o.updater](start, self.rate, o.workerCount, self.tau, o.stagger)
        self.gradient, self.left = sgd.GRADIENTS[o.loss](), None

    @property
    def weights(self) -> np.ndarray:
        return self.updater.weights

    def train(self, rows: DataFrame) -> None:
        rows = rows.select("id", "features", "label") if self.left is None else self.left.unionByName(rows.select("id", "features", "label"))
        size = self.options.minibatchSize * self.options.workerCount
        placed = windows.with_sequence(rows, "id").withColumn("batch", F.expr(f"seq div {size}").cast("int")).withColumn("worker", (F.col("seq") % self.options.workerCount).cast("int")).persist()
        try:
            full = placed.count() // size
            sgd.train(placed, self.header.dim, self.header.n_classes, list(range(full)), workers=self.options.workerCount, gradient=self.gradient, updater=self.updater)
            rest = placed.filter(F.col("batch") >= full).select("id", "features", "label")
            self.left = rows.sparkSession.createDataFrame(rest.toArrow(), rest.schema)  # less than a mini-batch a worker
        finally:
            placed.unpersist()

    def votes(self, queries: DataFrame) -> DataFrame:
        """p is 1 for classes whose score is above 0."""
        w, n = self.weights, self.header.n_classes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = np.hstack([matrix(batch.column("features"), w.shape[1] - 1), np.ones((batch.num_rows, 1))])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("id").to_numpy(), n)), pa.array(np.tile(np.arange(n, dtype=np.int32), batch.num_rows)), pa.array((np.nan_to_num(x) @ w.T > 0).astype(float).ravel())], names=["query_id", "class", "p"])

        return queries.select(F.col("id").cast("long").alias("id"), "features").mapInArrow(run, "query_id long, class int, p double")


def evaluate(learner: Learner, rows: DataFrame, options: EvaluationOptions | None = None, clock: Callable[[], float] = time.monotonic) -> list[dict]:
    """Periodic hold-out over a stream (id, features, label, weight, in the order of id): trains sampleFrequency rows, tests the next testSize, and so on.

    Ends at trainSize rows, after trainTime seconds of training, or before a test set that is not full. With cacheTest the
    first testSize rows are the test set of every checkpoint. Returns a line for each checkpoint; dumpFile: a folder that each is appended to."""
    from ..sources.sinks import append_results

    o = options or EvaluationOptions()
    placed = windows.with_sequence(rows, "id", out="_at").persist()
    lines, spent, trained, at = [], 0.0, 0, 0
    try:
        total = placed.count()
        part = lambda a, b: placed.filter((F.col("_at") >= a) & (F.col("_at") < b)).drop("_at")
        if o.cacheTest:
            at = o.testSize
        while at < total and (o.trainSize < 1 or trained < o.trainSize) and spent < o.trainTime:
            n = min(o.sampleFrequency, total - at, *([o.trainSize - trained] if o.trainSize >= 1 else []))
            begin = clock()
            learner.train(part(at, at + n))
            spent, trained, at = spent + clock() - begin, trained + n, at + n
            if not o.cacheTest and at + o.testSize > total:
                break
            test = part(0, o.testSize) if o.cacheTest else part(at, at + o.testSize)
            at += 0 if o.cacheTest else o.testSize
            begin = clock()
            found = learner.votes(test)
            score = "p" if "p" in found.columns else "votes"
            guess = found.groupBy("query_id").agg(F.max_by("class", F.struct(score, -F.col("class"))).alias("predicted"))
            result = test.select("id", F.col("label").alias("actual")).join(guess, F.col("id") == F.col("query_id")).select(F.col("id").alias("seq"), "actual", "predicted")
            (line,) = metrics(result).collect()
            lines.append({"trained": trained, "train_seconds": spent, "test_seconds": clock() - begin, **line.asDict()})
            if o.dumpFile:
                append_results(rows.sparkSession.createDataFrame([lines[-1]]), o.dumpFile)
    finally:
        placed.unpersist()
    return lines


def latency(predict: Callable[[], object], least: float = 0.030, more: int = 10, clock: Callable[[], float] = time.perf_counter) -> tuple[float, int]:
    """Seconds a call and the calls made: as many as take `least` seconds together, `more` being added until they do."""
    calls = 0
    while True:
        calls += more
        begin = clock()
        for _ in range(calls):
            predict()
        took = clock() - begin
        if took >= least:
            return took / calls, calls
