"""Structured Streaming forms: the ring window, test-then-train, and online SGD by micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def ring_stream(stream: DataFrame, size: int, key: str = "worker", seq: str = "seq") -> DataFrame:
    """For each key of a stream (key, seq, value): per micro-batch, the rows seen, whether the ring was filled once, and its sum and least place.

    The ring itself is the state: the last `size` values with their places, in slot order."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, slots, values = state.get if state.exists else (0, [], [])
        held = dict(zip(slots, values))
        rows = pd.concat(batches).sort_values(seq)
        for place, value in zip(rows[seq], rows["value"]):
            held[int(place)] = float(value)
            seen += 1
            if len(held) > size:
                del held[min(held)]
        state.update((seen, list(held), list(held.values())))
        yield pd.DataFrame({key: [k[0]], "seen": [seen], "ready": [seen >= size], "total": [sum(held.values())], "first": [min(held)]})

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} int, seen long, ready boolean, total double, first long", "seen long, slots array<long>, held array<double>", "update", GroupStateTimeout.NoTimeout)


class OnlineSgd:
    """A foreachBatch handler: each micro-batch is one synchronous step of one-vs-all hinge SGD; weights stay on the driver, of fixed size."""

    def __init__(self, dim: int, n_classes: int, rate: float = 1e-4):
        self.weights, self.rate, self.steps = np.zeros((n_classes, dim + 1)), rate, 0

    def __call__(self, batch: DataFrame, _: int) -> None:
        from ..operators.sgd import train

        rows = batch.select("features", "label", F.lit(0).alias("batch"), F.lit(0).alias("worker"))
        n_classes, width = self.weights.shape
        self.weights = train(rows, width - 1, n_classes, [0], rate=self.rate, start=self.weights)
        self.steps += 1


def evaluate_stream(stream: DataFrame, path: str, checkpoint: str, every: int, window: int, header, k: int = 10):
    """Test-then-train over a file stream, `every` rows at a time in the order of seq: rows are tested against the ring of rows before
    them, then added. A micro-batch of more rows is taken in so many steps; none is left out. Appends one result line a step."""
    from ..operators.evaluation import metrics
    from ..operators.knn import knn
    from ..operators.votes import class_votes, predicted
    from ..operators.windows import with_sequence
    from ..sources.sinks import append_results

    held: dict[str, DataFrame] = {}
    steps = 0

    def step(batch: DataFrame, _: int) -> None:
        nonlocal steps
        placed = with_sequence(batch, "seq", out="_at").persist()
        try:
            for begin in range(0, placed.count(), every):
                one(batch.sparkSession, placed.filter((F.col("_at") >= begin) & (F.col("_at") < begin + every)).drop("_at"), steps)
                steps += 1
        finally:
            placed.unpersist()

    def one(spark, part: DataFrame, number: int) -> None:
        rows = spark.createDataFrame(part.toPandas(), part.schema)  # at most `every` rows
        if "window" in held:
            near = knn(rows, held["window"], header, k)
            votes = class_votes(near, header.n_classes, held["window"].count(), header.dim + 1, missing=rows.select(F.col("id").alias("query_id")))
            got = predicted(votes).join(rows.select(F.col("id").alias("query_id"), F.col("label").alias("actual"), "seq"), "query_id")
            append_results(metrics(got.withColumn("checkpoint", F.lit(number)), "checkpoint"), path)
        both = rows if "window" not in held else held["window"].unionByName(rows)
        last = both.orderBy(F.col("seq").desc()).limit(window).toPandas()  # the ring, of at most `window` rows
        held["window"] = spark.createDataFrame(last, rows.schema)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
