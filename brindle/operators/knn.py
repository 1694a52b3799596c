"""Exact nearest neighbours: a stated query set against a window of instances."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..schema import Header
from .blocked import Metric, nearest, products, similar, sliced, spread
from .ranges import feature_ranges, with_ranges
from .topk import top_k

#: Queries that are broadcast at once at most; more are broadcast in slices.
MOST_BROADCAST = 20_000
#: Times as many where they are equal to others, as these are ids only.
MOST_EQUAL = 10
#: Slices at most; more queries are dealt out in blocks, as a plan has a join for each slice.
MOST_SLICES = 50
#: Pairs that a task of the leave-one-out search takes, while there are fewer tasks than shuffle partitions.
PAIRS_A_TASK = 32 << 20
#: Similarities that a search to some decimals makes where the rows meet.
KINDS = {V.true_cosine: "root", V.squared_norm_cosine: "squared", V.normalized_cosine_distance: "distance"}


def pairs(queries: DataFrame, window: DataFrame, most: int = MOST_BROADCAST, slices: int = MOST_SLICES) -> DataFrame:
    """Every query with every row of the window. Queries are broadcast, after a count, in slices of about `most` distinct ones and MOST_EQUAL times as many in all,
    so that rows of the window are moved once at most, to spread() them, and a task has no more than its part of it; more than `slices` times `most` queries meet the window in a grid of blocks by an equi-join.

    query_ids has the queries whose other columns are equal: what is computed of a pair is so once for all of them, and their rows follow one another."""
    columns = [c for c in queries.columns if c != "query_id"]
    distinct, count = queries.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    blocks = -(-count // most)
    if blocks <= slices:
        out, window = None, spread(window, count)
        grouped = queries.groupBy(*columns).agg(F.collect_list("query_id").alias("query_ids"))
        for part in sliced(grouped, most, max(distinct, -(-count // MOST_EQUAL)), *columns):
            both = window.crossJoin(F.broadcast(part))
            out = both if out is None else out.unionByName(both)
        return out
    q = queries.withColumn("row_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).withColumn("col_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    w = window.withColumn("col_block", F.pmod(F.xxhash64("id"), F.lit(blocks))).withColumn("row_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return w.join(q, ["row_block", "col_block"]).drop("row_block", "col_block").withColumn("query_ids", F.array("query_id")).drop("query_id")


def as_queries(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(F.col("id").alias("query_id"), *more)


def distances(queries: DataFrame, window: DataFrame, header: Header, ranges: DataFrame | None = None) -> DataFrame:
    """query_id, id, label, weight and distance (squared, normalised by the window's ranges) of all pairs. Both sides are normalised before they meet."""
    ranges = feature_ranges(window, header.dim) if ranges is None else ranges
    scaled = V.normalize("features", "low", "high", header.types)
    q = with_ranges(queries, ranges).select(F.col("id").alias("query_id"), scaled.alias("q"))
    w = with_ranges(window, ranges).select("id", "label", "weight", scaled.alias("x"))
    found = pairs(q, w).withColumn("distance", V.squared_distance("q", "x", header.types))
    return found.select(F.explode("query_ids").alias("query_id"), "id", "label", "weight", "distance")


def known_ranges(ranges: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """low and high, computed now: two numbers a feature."""
    low, high = ranges.select("low", "high").first()
    return tuple(np.array([np.nan if v is None else v for v in x or []], float) for x in (low, high))


def knn(queries: DataFrame, window: DataFrame, header: Header, k: int = 10, keep_ties: bool = False, ranges: DataFrame | None = None) -> DataFrame:
    """The k nearest rows of each query: query_id, id, label, weight, distance, place. Ties go to the smaller id."""
    low, high = known_ranges(feature_ranges(window, header.dim) if ranges is None else ranges)
    if not len(low):  # no row, no range
        low, high = np.zeros(header.dim), np.zeros(header.dim)
    return top_k(nearest(queries, window, Metric(header.types, low, high), k, keep_ties), k, keep_ties=keep_ties)


def knn_float(queries: DataFrame, window: DataFrame, header: Header, k: int = 10) -> DataFrame:
    """The same on features rounded to single precision."""
    single = lambda d: d.withColumn("features", V.to_float(F.col("features")).cast("array<double>"))
    return knn(single(queries), single(window), header, k)


def similarities(
    queries: DataFrame, window: DataFrame, header: Header, similarity: Callable[[Column, Column, Column], Column], ranges: DataFrame | None = None, carry: tuple[str, ...] = ("id", "label", "weight"), most: int = MOST_BROADCAST, digits: int | None = None,
) -> DataFrame:
    """query_id, `carry` of the window's rows, and similarity of all pairs, to so many decimals if `digits`. Norms are of the raw rows; the inner product is of rows scaled by ranges, if given."""
    low, high = (None, None) if ranges is None else known_ranges(ranges)
    if low is not None and not len(low):  # no row, no range
        low, high = np.zeros(header.dim), np.zeros(header.dim)
    if digits is not None and similarity in KINDS:
        return similar(queries, window, Metric(header.types, low, high), KINDS[similarity], digits, carry, most)
    both = products(queries, window, Metric(header.types, low, high), carry, most)
    value = similarity(F.col("inner"), F.col("nq"), F.col("nx"))
    return both.withColumn("similarity", value if digits is None else V.rounded(value, digits)).drop("inner", "nq", "nx")


def knn_cosine(queries: DataFrame, window: DataFrame, header: Header, k: int = 10, norms: str = "squared") -> DataFrame:
    """The k most similar rows, with similarity; pairs out of the similarity's domain are left out. norms: "squared" for the angular similarity
    whose divisor is the product of squared norms, "root" for the plain cosine."""
    found = top_k(nearest(queries, window, Metric(header.types, norms=norms), k, rank="rank"), k, by="rank")
    ratio = -F.col("rank")
    return found.withColumn("similarity", 1 - F.acos(ratio) / math.pi if norms == "squared" else ratio).drop("rank")


def refine(candidates: DataFrame, queries: DataFrame, window: DataFrame, header: Header, k: int, ranges: DataFrame) -> DataFrame:
    """The k nearest of each query among its candidates (query_id, id)."""
    scaled = V.normalize("features", "low", "high", header.types)
    q = with_ranges(queries, ranges).select(F.col("id").alias("query_id"), scaled.alias("q"))
    w = with_ranges(window, ranges).select("id", "label", "weight", scaled.alias("x"))
    both = candidates.select("query_id", "id").distinct().join(w, "id").join(q, "query_id")
    return top_k(both.withColumn("distance", V.squared_distance("q", "x", header.types)).drop("q", "x"), k)


def leave_one_out(rows: DataFrame, header: Header, k: int) -> DataFrame:
    """The k nearest other rows of each row: query_id, id, label, weight, distance, place."""
    each = F.posexplode("others").alias("_at", "o")
    return loo_lists(rows, header, k).select("query_id", each).select("query_id", "o.id", "o.label", "o.weight", "o.distance", (F.col("_at") + 1).alias("place"))


def loo_lists(rows: DataFrame, header: Header, k: int) -> DataFrame:
    """query_id, label and others, the k nearest other rows of each row in the order of (distance, id) as an array of structs."""
    return loo_classes(rows, header, k).select("query_id", "label", F.slice(_without("near", "query_id"), 1, k).alias("others"))


def _without(near: str, own: str) -> Column:
    return F.filter(near, lambda o: ~o["id"].eqNullSafe(F.col(own)))


def loo_classes(rows: DataFrame, header: Header, k: int, once: dict[str, Column] | None = None) -> DataFrame:
    """query_id, label and near, the k + 1 nearest rows of each row, itself included; once: columns made of `near`, once for all rows of a class.

    Rows of equal features have the same distances, so each class of them is searched for once, and only its k + 1 rows of the smallest ids can
    be among the k + 1 nearest of any row; of those, a row that is one of them leaves out itself. Tasks of the search are as many as its pairs need:
    by the bytes of so few rows they would be one."""
    key = F.xxhash64("features").alias("h")  # a join on one long; features are compared, too
    known = rows.select("id", "features", "label", "weight")
    asked = known.groupBy("features").agg(F.min("id").alias("id")).select("id", "features")
    first = known.withColumn("_n", F.row_number().over(Window.partitionBy("features").orderBy("id"))).filter(F.col("_n") <= k + 1)
    tasks = -(-((k + 1) * asked.count() ** 2) // PAIRS_A_TASK)
    first = first.drop("_n").repartition(max(1, min(tasks, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))), "id")
    found = knn(asked, first, header, k + 1, ranges=feature_ranges(rows, header.dim))
    near = found.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("place", "id", "label", "weight", "distance"))).alias("near"))
    near = near.join(asked.select(F.col("id").alias("query_id"), F.col("features").alias("f"), key), "query_id").select("f", "h", "near", *[c.alias(n) for n, c in (once or {}).items()])
    each = known.select(F.col("id").alias("query_id"), "label", "features", key).join(near, "h").filter(F.col("features").eqNullSafe(F.col("f")))
    return each.select("query_id", "label", "near", *(once or {}))


def _means(labels: Column, k_max: int) -> Column:
    """The mean of the first k labels that are known, for each k."""
    known = lambda k: F.filter(F.slice(labels, 1, k), lambda x: x.isNotNull())
    return F.array(*[F.try_divide(F.aggregate(known(k), F.lit(0.0), lambda s, x: s + x), F.size(known(k))) for k in range(1, k_max + 1)])


def best_k(rows: DataFrame, header: Header, k_max: int = 10, numeric: bool = False, squared: bool = False) -> DataFrame:
    """Leave-one-out choice of k: k, errors for 1..k_max, and best, the lowest k with the least.

    errors counts wrong guesses, by plain votes with ties to the lower class; with `numeric` it is the mean absolute error
    (or with `squared` the root of the mean squared one) of the neighbours' mean label."""
    if numeric:
        # most rows are not among the nearest of their class, whose means are then theirs
        rest = _without("near", "query_id")
        own = F.col("query_id").isNull() | F.array_contains("ids", F.col("query_id"))
        classes = loo_classes(rows, header, k_max, {"ids": F.col("near.id"), "means": _means(F.col("near.label"), k_max)})
        labels = classes.filter(~own | (F.size(rest) > 0)).select(F.col("label").alias("truth"), F.when(own, _means(F.transform(rest, lambda o: o["label"]), k_max)).otherwise(F.col("means")).alias("means"))
        off = [F.col("means")[k] - F.col("truth") for k in range(k_max)]
        sums = labels.select(*[(o * o if squared else F.abs(o)).alias(f"e{i}") for i, o in enumerate(off)]).agg(*[F.avg(f"e{i}").alias(f"e{i}") for i in range(k_max)])
        listed = F.array(*[F.struct(F.lit(i + 1).alias("k"), (F.sqrt(f"e{i}") if squared else F.col(f"e{i}")).alias("errors")) for i in range(k_max)])
        errors = sums.select(F.inline(listed)).filter("errors IS NOT NULL")
    else:
        near = leave_one_out(rows, header, k_max)
        ks = near.sparkSession.range(1, k_max + 1).select(F.col("id").cast("int").alias("k"))
        near = near.join(F.broadcast(ks), F.col("place") <= F.col("k"))
        truth = rows.select(F.col("id").alias("query_id"), F.col("label").alias("truth"))
        votes = near.groupBy("k", "query_id", "label").agg(F.count(F.lit(1)).alias("n"))
        guess = votes.groupBy("k", "query_id").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("guess"))
        errors = guess.join(truth, "query_id").groupBy("k").agg(F.sum(F.when(F.col("guess") != F.col("truth"), 1).otherwise(0)).alias("errors"))
    by = Window.partitionBy().orderBy("errors", "k")  # k_max rows
    return errors.withColumn("best", F.row_number().over(by) == 1)
