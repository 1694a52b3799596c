"""Accuracy, kappa and temporal kappa at checkpoints; periodic hold-out plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .windows import as_number, range_bounds, range_place


def metrics(results: DataFrame, *by: str, seq: str = "seq") -> DataFrame:
    """results: actual, predicted, seq, and checkpoint columns `by`. Adds n, accuracy, kappa = (p0 - pc) / (1 - pc) and kappa_temporal = (p0 - pn) / (1 - pn).

    pc is chance agreement from the margins; pn the accuracy of repeating the label before, in the stream's order."""
    one = [F.lit(0).alias("_all")] if not by else []
    keys = list(by) or ["_all"]
    rows = results.select(*by, *one, "actual", "predicted", seq)
    # the label before is looked up within ranges of the order, and for the first row of a range in the last ones of the ranges before
    number = as_number(rows, seq)
    rows = rows.withColumn("_range", range_place(number, range_bounds(rows, number)))
    lasts = rows.groupBy(*keys, "_range").agg(F.max_by("actual", seq).alias("last"))
    lasts = lasts.withColumn("came", F.lag("last").over(Window.partitionBy(*keys).orderBy("_range"))).drop("last")  # a row a key and range
    before = F.coalesce(F.lag("actual").over(Window.partitionBy(*keys, "_range").orderBy(seq)), F.col("came"))
    rows = rows.join(lasts, [*keys, "_range"]).withColumn("same", (before == F.col("actual")).cast("int"))
    base = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("actual") == F.col("predicted")).cast("double")).alias("accuracy"), F.sum(F.coalesce("same", F.lit(0))).alias("repeats"))
    actual = rows.groupBy(*keys, F.col("actual").alias("c")).agg(F.count(F.lit(1)).alias("a"))
    guess = rows.groupBy(*keys, F.col("predicted").alias("c")).agg(F.count(F.lit(1)).alias("g"))
    chance = actual.join(guess, [*keys, "c"]).groupBy(*keys).agg(F.sum(F.col("a") * F.col("g")).alias("both"))
    out = base.join(chance, keys, "left")
    pc, pn = F.coalesce("both", F.lit(0)) / (F.col("n") * F.col("n")), F.col("repeats") / F.col("n")
    kappa = lambda p: F.when(p < 1, (F.col("accuracy") - p) / (1 - p)).otherwise(F.lit(0.0))
    return out.select(*by, "n", "accuracy", kappa(pc).alias("kappa"), kappa(pn).alias("kappa_temporal"))


def confusion(results: DataFrame, *by: str) -> DataFrame:
    return results.groupBy(*by, "actual", "predicted").agg(F.count(F.lit(1)).alias("n"))


def hold_out(rows: DataFrame, train_every: int, test_size: int, cached: bool = False, seq: str = "seq", train_size: int | None = None) -> DataFrame:
    """Adds checkpoint and role to each row of the stream.

    Not cached: train_every rows are trained, the next test_size tested, and so on; a short test set ends the stream.
    Cached: the first test_size rows are the test set of every checkpoint (checkpoint is null), the rest is trained."""
    s = F.col(seq)
    if cached:
        role = F.when(s < test_size, "test").otherwise("train")
        at = F.when(s >= test_size, F.floor((s - test_size) / train_every))
    else:
        period = train_every + test_size
        role = F.when(s % period < train_every, "train").otherwise("test")
        at = F.floor(s / period)
    out = rows.withColumn("checkpoint", at.cast("long")).withColumn("role", role)
    if not cached:
        full = rows.agg(F.floor((F.max(seq) + 1) / (train_every + test_size)).alias("_full"))
        out = out.join(F.broadcast(full), F.col("checkpoint") < F.col("_full")).drop("_full")
    if train_size is not None:
        out = out.filter((F.col("role") == "test") | (F.col("checkpoint") * train_every < train_size))
    return out


def work_statistics(log: DataFrame) -> DataFrame:
    """One row of means over a search log: query_id, compared, leaf_size, leaves."""
    return log.agg(F.avg("compared").alias("avg_compared"), F.avg("leaf_size").alias("avg_leaf_size"), F.avg("leaves").alias("avg_leaves"))
