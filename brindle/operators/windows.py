"""Windows over the order of a stream: the ring of the last rows, mini-batches, worker shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_bounds(rows: DataFrame, number: Column) -> list[float]:
    """Quantiles of a number that part the rows into as many ranges as there are shuffle partitions."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    steps = [(i + 1) / n for i in range(n - 1)]
    return sorted(set(rows.agg(F.percentile_approx(number, F.array(*map(F.lit, steps)))).first()[0] or [])) if steps else []  # n - 1 numbers


def range_place(number: Column, bounds: list[float]) -> Column:
    """The range that a number falls in, from 0: how many bounds are below it. The number is taken once a row, as an element, and searched for by halves."""
    if not bounds:
        return F.lit(0)

    def search(v: Column, low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(F.lit(bounds[mid]) < v, search(v, mid + 1, high)).otherwise(search(v, low, mid))

    return F.transform(F.array(number), lambda v: search(v, 0, len(bounds)))[0]


def offsets(counts: DataFrame, place: str, count: str, n_ranges: int) -> Column:
    """Of a range, the sum of counts of the ranges before; counts: one row a range, at most n_ranges."""
    sizes = {r[place]: r[count] for r in counts.collect()}
    total, starts = 0, []
    for k in range(n_ranges):
        starts.append(total)
        total += sizes.get(k) or 0
    return F.get(F.array(*[F.lit(x).cast("long") for x in starts]), F.col(place))


def as_number(rows: DataFrame, column: str) -> Column:
    kind = dict(rows.dtypes)[column]
    return (F.col(column).cast("timestamp") if kind.startswith("timestamp") else F.col(column)).cast("double")


def with_sequence(rows: DataFrame, *order: str, out: str = "seq") -> DataFrame:
    """Adds the place in the stream, from 0. Places are counted within ranges of the order and offset by the ranges before, so no task holds the stream.

    The rows are dealt into ranges by quantiles of the first order column, taken once."""
    number = as_number(rows, order[0])
    bounds = range_bounds(rows, number)
    dealt = rows.withColumn("_range", range_place(number, bounds))
    before = offsets(dealt.groupBy("_range").count(), "_range", "count", len(bounds) + 1)
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return dealt.withColumn(out, (inside + before).cast("long")).drop("_range")


def ring(rows: DataFrame, size: int, seq: str = "seq") -> DataFrame:
    """What a ring of `size` rows holds after all rows: the last ones, each with its slot. The bound is one aggregate; nothing is sorted."""
    last = rows.agg(F.max(seq).alias("_last"))
    kept = rows.crossJoin(F.broadcast(last)).filter(F.col(seq) > F.col("_last") - size)
    return kept.withColumn("slot", F.col(seq) % size).drop("_last")


def is_ready(seq: Column, size: int) -> Column:
    """Whether the ring had been filled once when a row came: after `size` rows before it."""
    return seq >= size


def mini_batches(rows: DataFrame, size: int, seq: str = "seq") -> DataFrame:
    """Adds batch; rows of a last batch that is not full are left out, as they are never trained."""
    total = rows.agg(F.floor((F.max(seq) + 1) / size).alias("_full"))
    return rows.withColumn("batch", F.floor(F.col(seq) / size)).join(F.broadcast(total), F.col("batch") < F.col("_full")).drop("_full")


def worker_rows(rows: DataFrame, workers: int, seq: str = "seq") -> DataFrame:
    """Adds the worker that a row belongs to, in turn."""
    return rows.withColumn("worker", F.pmod(F.col(seq), F.lit(workers)).cast("int"))
