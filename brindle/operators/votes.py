"""Votes of neighbours: class distributions with a prior, raw counts, numeric means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def vote_weight(distance: Column, scheme: str, n_features: int) -> Column:
    """none: 1; inverse: 1 / (sqrt(d / n) + 0.001); similarity: 1 - sqrt(d / n). n counts the class, too."""
    root = F.sqrt(distance / float(n_features))
    return {"none": F.lit(1.0), "inverse": 1 / (root + 0.001), "similarity": 1 - root}[scheme]


def class_votes(neighbours: DataFrame, n_classes: int, n_window: int, n_features: int, scheme: str = "none", missing: DataFrame | None = None) -> DataFrame:
    """query_id, class, p: each class begins at 1 / max(1, window), weights are added, and the total is divided out.

    missing: all query ids, so that queries without neighbours get the prior alone."""
    start = 1.0 / max(1, n_window)
    w = vote_weight(F.col("distance"), scheme, n_features) * F.col("weight")
    sums = neighbours.groupBy("query_id").agg(*[F.sum(F.when(F.col("label") == c, w).otherwise(0.0)).alias(f"c{c}") for c in range(n_classes)], F.sum(w).alias("all_"))
    if missing is not None:
        sums = missing.select("query_id").join(sums, "query_id", "left").fillna(0.0)
    total = F.col("all_") + n_classes * start
    each = F.array(*[F.struct(F.lit(c).alias("class"), ((F.col(f"c{c}") + start) / total).alias("p")) for c in range(n_classes)])
    return sums.select("query_id", F.inline(each))


def predicted(votes: DataFrame) -> DataFrame:
    """query_id and the class with most votes, ties to the lower class."""
    return votes.groupBy("query_id").agg(F.max_by("class", F.struct("p", -F.col("class"))).alias("predicted"))


def raw_votes(neighbours: DataFrame) -> DataFrame:
    """query_id, class, votes: plain counts."""
    return neighbours.groupBy("query_id", F.col("label").alias("class")).agg(F.count(F.lit(1)).alias("votes"))


def numeric_vote(neighbours: DataFrame, n_features: int, scheme: str = "none") -> DataFrame:
    """query_id and the weighted mean of the neighbours' numeric classes."""
    w = vote_weight(F.col("distance"), scheme, n_features) * F.col("weight")
    return neighbours.groupBy("query_id").agg((F.sum(w * F.col("label")) / F.sum(w)).alias("prediction"))


def uniform_prior(n_classes: int) -> list[float]:
    return [1.0 / n_classes] * n_classes


def votes_when_ready(votes: DataFrame, n_classes: int, seen: int, window: int, ready_at: int | None = None) -> DataFrame:
    """Votes once the window has been filled (or after ready_at rows); the uniform prior before."""
    if seen >= (window if ready_at is None else ready_at):
        return votes
    return votes.withColumn("p", F.lit(1.0 / n_classes))
