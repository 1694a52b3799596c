"""Linear models by mini-batch hinge gradients: losses, updates, 1-bit updates with error feedback, synchronous training.

Weights are long (class, attr, w), with the bias as attribute BIAS, whose input is 1. Exchange between workers is
synchronous and in a fixed order, so results do not depend on timing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocked import matrix

BIAS = -1


def hinge_loss(label: Column, score: Column) -> Column:
    """label 0 or 1; max(0, 1 - y * score) with y = 2 * label - 1."""
    return F.greatest(F.lit(0.0), 1 - (2 * label - 1) * score)


def hinge_factor(label: Column, score: Column) -> Column:
    """What a row is scaled by in the gradient: -y inside the margin, else 0."""
    y = (2 * label - 1).cast("double")
    return F.when(y * score < 1, -y).otherwise(F.lit(0.0))


def binary_hinge(entries: DataFrame, labels: DataFrame, weights: DataFrame) -> DataFrame:
    """row_id, loss and factor. entries: row_id, col, val; labels: row_id, label; weights: col, w."""
    scores = entries.join(weights, "col").groupBy("row_id").agg(F.sum(F.col("val") * F.col("w")).alias("score"))
    rows = labels.join(scores, "row_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return rows.select("row_id", hinge_loss(F.col("label"), F.col("score")).alias("loss"), hinge_factor(F.col("label"), F.col("score")).alias("factor"))


def class_scores(entries: DataFrame, rows: DataFrame, weights: DataFrame) -> DataFrame:
    """row_id, label, class and score = w . x + bias of every class; rows: row_id, label."""
    bias = weights.filter(F.col("attr") == BIAS).select("class", F.col("w").alias("bias"))
    dots = entries.join(weights.filter(F.col("attr") != BIAS).withColumnRenamed("attr", "col"), "col").groupBy("row_id", "class").agg(F.sum(F.col("val") * F.col("w")).alias("dot"))
    every = rows.crossJoin(F.broadcast(bias))  # one row a class
    return every.join(dots, ["row_id", "class"], "left").select("row_id", "label", "class", (F.coalesce("dot", F.lit(0.0)) + F.col("bias")).alias("score"))


def one_vs_all(scores: DataFrame) -> DataFrame:
    """Adds update: y where y * score < 1, else 0; y is 1 for the row's class and -1 for others."""
    y = F.when(F.col("class") == F.col("label"), F.lit(1.0)).otherwise(F.lit(-1.0))
    return scores.withColumn("update", F.when(y * F.col("score") < 1, y).otherwise(F.lit(0.0)))


def gradient(entries: DataFrame, updates: DataFrame, batch: int) -> DataFrame:
    """class, attr, g: sums of update / batch times the input, the bias' input being 1. Sparse and dense rows alike."""
    u = updates.filter(F.col("update") != 0).select("row_id", "class", (F.col("update") / batch).alias("u"))
    inner = entries.join(u, "row_id").groupBy("class", F.col("col").alias("attr")).agg(F.sum(F.col("val") * F.col("u")).alias("g"))
    bias = u.groupBy("class").agg(F.sum("u").alias("g")).select("class", F.lit(BIAS).alias("attr"), "g")
    return inner.unionByName(bias)


def dense_gradient(rows: DataFrame, updates: DataFrame, batch: int) -> DataFrame:
    """The same for rows with a features array."""
    return gradient(rows.select(F.col("id").alias("row_id"), F.posexplode("features").alias("col", "val")), updates, batch)


def predict(scores: DataFrame) -> DataFrame:
    """row_id, class, vote: 1 where the score is above 0."""
    return scores.select("row_id", "class", F.when(F.col("score") <= 0, 0).otherwise(1).alias("vote"))


def direct_update(weights: DataFrame, gradients: DataFrame, rate: float = 1e-4) -> DataFrame:
    """w + rate * g."""
    return weights.join(gradients, ["class", "attr"], "left").select("class", "attr", (F.col("w") + rate * F.coalesce("g", F.lit(0.0))).alias("w"))


def one_bit_step(state: DataFrame) -> DataFrame:
    """state: key columns, g, es, el, tau, delta. What is beyond tau goes into delta as a sign, the rest is kept as error.

    g' = g + es + el; where |g'| + 1e-12 >= tau: delta += sign, el = sign * (|g'| - tau), es = 0; else es = g', el = 0."""
    sent = F.abs("_s") + 1e-12 >= F.col("tau")
    sign = F.when(F.col("_s") < 0, F.lit(-1)).otherwise(F.lit(1))
    out = state.withColumn("_s", F.col("g") + F.col("es") + F.col("el"))
    out = out.withColumn("delta", F.col("delta") + F.when(sent, sign).otherwise(0)).withColumn("el", F.when(sent, sign * (F.abs("_s") - F.col("tau"))).otherwise(F.lit(0.0)))
    return out.withColumn("es", F.when(sent, F.lit(0.0)).otherwise(F.col("_s"))).drop("_s")


def read_weights(w: Column, tau: Column, delta: Column, rate: float = 1e-4) -> Column:
    """Weights as others see them before a delta is applied, and after."""
    return w + rate * tau * delta


def apply_delta(state: DataFrame, rate: float = 1e-4) -> DataFrame:
    return state.withColumn("w", read_weights(F.col("w"), F.col("tau"), F.col("delta"), rate)).withColumn("delta", F.lit(0))


def tau_update(errors: DataFrame, *keys: str) -> DataFrame:
    """keys, tau: half the difference of the means over batches of tau + |el| and |es|."""
    return errors.groupBy(*keys).agg(((F.avg(F.col("tau") + F.abs("el")) - F.avg(F.abs("es"))) / 2).alias("tau"))


class Gradient(Protocol):
    """A loss: sums of a mini-batch's gradient."""

    def sums(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        """x: rows with the bias input last; y: rows x classes, 1 or -1; w: classes x inputs. Returns the sum over rows, of the shape of w."""


class Updater(Protocol):
    """What becomes of a worker's mean gradient."""

    weights: np.ndarray

    def apply(self, gradient: np.ndarray, worker: int) -> None: ...

    def end_of_round(self, turn: int) -> None: ...


class HingeGradient:
    """One-vs-all hinge loss."""

    def sums(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        return np.where(y * (x @ w.T) < 1, y, 0.0).T @ x


class DirectUpdater:
    """Weights move by the rate times the gradient."""

    def __init__(self, weights: np.ndarray, rate: float = 1e-4):
        self.weights, self.rate = weights, rate

    def apply(self, gradient: np.ndarray, worker: int) -> None:
        self.weights = self.weights + self.rate * gradient

    def end_of_round(self, turn: int) -> None:
        return


class OneBitUpdater:
    """Each worker sends signs of what is beyond its tau and keeps the rest as error; tau is renewed every `stagger` rounds."""

    def __init__(self, weights: np.ndarray, rate: float = 1e-4, workers: int = 1, tau: float = 1.0, stagger: int = 10):
        self.weights, self.rate, self.stagger = weights, rate, stagger
        self.es, self.el = np.zeros((workers, *weights.shape)), np.zeros((workers, *weights.shape))
        self.tau = np.full((workers, *weights.shape), float(tau))

    def apply(self, gradient: np.ndarray, worker: int) -> None:
        s, tau = gradient + self.es[worker] + self.el[worker], self.tau[worker]
        sent, sign = np.abs(s) + 1e-12 >= tau, np.where(s < 0, -1.0, 1.0)
        self.weights = self.weights + self.rate * tau * np.where(sent, sign, 0.0)
        self.el[worker], self.es[worker] = np.where(sent, sign * (np.abs(s) - tau), 0.0), np.where(sent, 0.0, s)

    def end_of_round(self, turn: int) -> None:
        if (turn + 1) % self.stagger == 0:
            self.tau[:] = np.maximum(1e-12, ((self.tau + np.abs(self.el)).mean(0) - np.abs(self.es).mean(0)) / 2)


class FallbackUpdater(OneBitUpdater):
    """Weights that no other worker holds move by the whole gradient, the others by what a 1-bit update sends.

    held(worker, turn): which weights are held by others, of their shape; none where it is not given, as rounds are synchronous."""

    def __init__(self, *args, held: Callable[[int, int], np.ndarray] | None = None, **options):
        super().__init__(*args, **options)
        self.held, self.turn = held or (lambda worker, turn: np.zeros(self.weights.shape, bool)), 0

    def apply(self, gradient: np.ndarray, worker: int) -> None:
        held = self.held(worker, self.turn)
        free, es, el = self.weights + self.rate * gradient, self.es[worker].copy(), self.el[worker].copy()
        super().apply(gradient, worker)
        self.weights = np.where(held, self.weights, free)
        self.es[worker], self.el[worker] = np.where(held, self.es[worker], es), np.where(held, self.el[worker], el)

    def end_of_round(self, turn: int) -> None:
        super().end_of_round(turn)
        self.turn = turn + 1


#: Losses and updaters by their option names; an updater is made from (weights, rate, workers, tau, stagger).
GRADIENTS: dict[str, Callable[[], Gradient]] = {"Hinge": HingeGradient}
UPDATERS: dict[str, Callable[..., Updater]] = {
    "DirectUpdater": lambda weights, rate, workers, tau, stagger: DirectUpdater(weights, rate),
    "OneBitUpdater": OneBitUpdater,
    "FallbackUpdater": FallbackUpdater,
}
#: Bytes of mini-batches that one job brings at most; a mini-batch that is larger is summed where it lies.
MOST_BYTES = 32 << 20


def _signs(label: np.ndarray, n_classes: int) -> np.ndarray:
    return np.where(label[:, None] == np.arange(n_classes), 1.0, -1.0)


def _summed(rows: DataFrame, gradient: Gradient, w: np.ndarray) -> dict[int, tuple[np.ndarray, int]]:
    """Of each worker of one large mini-batch: the gradient's sum and the rows, summed in each task first."""
    n_classes, width = w.shape

    def partial(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for part in parts:
            if not part.num_rows:
                continue
            x = np.hstack([matrix(part.column("features"), width - 1), np.ones((part.num_rows, 1))])
            y, own = _signs(part.column("label").to_numpy(), n_classes), part.column("worker").to_numpy()
            for k in np.unique(own).tolist():
                g, n = sums.get(k, (np.zeros_like(w), 0))
                sums[k] = (g + gradient.sums(x[own == k], y[own == k], w), n + int((own == k).sum()))
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([g.ravel() for g, _ in sums.values()], pa.list_(pa.float64())), pa.array([n for _, n in sums.values()], pa.int64())], names=["worker", "g", "n"])

    got = rows.select("features", "label", F.col("worker").cast("int").alias("worker")).mapInArrow(partial, "worker int, g array<double>, n long").toPandas()
    return {int(k): (np.sum(own["g"].to_list(), axis=0).reshape(w.shape), int(own["n"].sum())) for k, own in got.groupby("worker")}


def train(
    rows: DataFrame, dim: int, n_classes: int, batches: list[int], workers: int = 1, rate: float = 1e-4, one_bit: bool = False, tau: float = 1.0, stagger: int = 10, start: np.ndarray | None = None,
    gradient: Gradient | None = None, updater: Updater | None = None, most_bytes: int = MOST_BYTES,
) -> np.ndarray:
    """Synchronous rounds over rows (features, label, batch, worker, and id or seq if they are to be in order): weights, classes x (dim + 1), bias last.

    Each round the mean gradients of the workers' mini-batches are applied in the order of workers. The rounds follow one
    another, so small mini-batches come many at a time, `most_bytes` in a job; those that are larger are summed by tasks,
    and only sums of fixed size come back."""
    w = np.zeros((n_classes, dim + 1)) if start is None else start
    gradient = gradient or HingeGradient()
    updater = updater or UPDATERS["OneBitUpdater" if one_bit else "DirectUpdater"](w, rate, workers, tau, stagger)
    if not batches:
        return updater.weights
    sizes = {r["batch"]: r["count"] for r in rows.groupBy("batch").count().collect()} if len(batches) > 1 else {batches[0]: 0}  # a row a mini-batch
    order = [c for c in ("batch", "worker", "seq", "id") if c in rows.columns]

    def finish(found: dict[int, tuple[np.ndarray, int]], turn: int) -> None:
        for k in sorted(found):
            total, n = found[k]
            updater.apply(total / n, k)
        updater.end_of_round(turn)

    turn = 0
    while turn < len(batches):
        together, held = 1, sizes.get(batches[turn], 0)
        while turn + together < len(batches) and (held + sizes.get(batches[turn + together], 0)) * (dim + 2) * 8 <= most_bytes:
            held += sizes.get(batches[turn + together], 0)
            together += 1
        own = batches[turn : turn + together]
        if together == 1:
            finish(_summed(rows.filter(F.col("batch") == own[0]), gradient, updater.weights), turn)
        else:
            part = rows.filter(F.col("batch").between(min(own), max(own))).select(*order, "features", "label").toArrow().sort_by([(c, "ascending") for c in order])
            x, label = np.hstack([matrix(part["features"], dim), np.ones((part.num_rows, 1))]), part["label"].to_numpy()
            batch, worker = part["batch"].to_numpy(), part["worker"].to_numpy()
            for step, number in enumerate(own):
                begin, end = np.searchsorted(batch, [number, number + 1])
                y, of = _signs(label[begin:end], n_classes), worker[begin:end]
                finish({int(k): (gradient.sums(x[begin:end][of == k], y[of == k], updater.weights), int((of == k).sum())) for k in np.unique(of)}, turn + step)
        turn += together
    return updater.weights


def sequential(rows: DataFrame, dim: int, n_classes: int, rate: float = 1e-4, decay: float = 0.0, key: str = "worker", seq: str = "seq") -> DataFrame:
    """key, class, attr, w: one row at a time in the order of seq, for each key by itself; the plain fold that rounds are compared with."""

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        w = np.zeros((n_classes, dim + 1))
        for x, label in part.sort_values(seq)[["features", "label"]].itertuples(index=False):
            x = np.append(np.asarray(x, float), 1.0)
            y = np.where(np.arange(n_classes) == label, 1.0, -1.0)
            w = w * (1 - rate * decay) + rate * np.outer(np.where(y * (w @ x) < 1, y, 0.0), x)
        attrs = [*range(dim), BIAS]
        return pd.DataFrame({key: part[key].iloc[0], "class": np.repeat(np.arange(n_classes), dim + 1), "attr": attrs * n_classes, "w": w.ravel()})

    return rows.select(key, seq, "features", "label").groupBy(key).applyInPandas(fold, f"{key} int, class int, attr int, w double")
