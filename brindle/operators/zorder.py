"""Approximate nearest neighbours by Z-order curves: codes, positions, candidate windows, refinement.

A curve is a table (id, code, position). Positions are counted within ranges of the code and offset, so a curve is never
sorted in one task; a query's position is the number of codes below its own. Candidates are the rows at positions within
half a window around it, found by an equi-join on blocks of positions, never by comparing a query with all rows.

Windows that hold about the whole table over all curves (`is_wide`) would make as many candidates as there are pairs. There
the codes of all curves are made at once, as bytes, and each row carries its positions to the blocked search, which leaves
out the pairs that are near on no curve: the same candidates, none of which becomes a row of a join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import curves as C
from ..functions import vectors as V
from ..schema import Header
from .blocked import MOST_BROADCAST, MOST_BYTES, Metric, Near, matrix, nearest
from .knn import known_ranges, refine
from .projections import project, project_all, projected, sign_matrix
from .ranges import feature_ranges, with_ranges
from .topk import top_k
from .windows import offsets, range_bounds, range_place, with_sequence


def codes(rows: DataFrame, ranges: DataFrame, header: Header, shifts: list[int] | None = None, bits: int = 21) -> DataFrame:
    """id and code: normalised, quantised, shifted, interleaved. 21 bits hold features within the ranges and shifts below 1,000,000."""
    x = with_ranges(rows, ranges).select("id", V.normalize("features", "low", "high", header.types, floor=0.0).alias("x"))
    q = x.select("id", V.quantize("x", header.types).alias("q"))
    if shifts:
        q = q.withColumn("s", F.expr(f"array({', '.join(f'{s}L' for s in shifts)})")).select("id", V.shift("q", "s", header.dim).alias("q"))
    return q.select("id", C.morton_bits("q", header.dim, bits).alias("code"))


def _known(ranges: DataFrame) -> DataFrame:
    """The same row (two numbers a feature), computed now, so that each curve does not compute it again."""
    return ranges.sparkSession.createDataFrame(ranges.collect(), ranges.schema)


def curve_shifts(n_curves: int, dim: int, seed: int = 1, most: int = 1_000_000) -> list[list[int]]:
    """Random shifts of each curve; the first has none."""
    rng = np.random.default_rng(seed)
    return [[0] * dim] + [rng.integers(0, most, dim).tolist() for _ in range(n_curves - 1)]


def code_number(code: str = "code") -> Column:
    """A double that does not decrease along the curve: the leading 208 bits, of which it keeps the first 53 that are not all 0."""
    wide, out = F.rpad(code, 208, "0"), None
    for part in reversed(range(4)):
        bits = F.conv(F.substring(wide, 52 * part + 1, 52), 2, 10).cast("double")
        out = bits if out is None else bits + out / float(2**52)
    return out


def positions(coded: DataFrame) -> DataFrame:
    """Adds position from 0 in the order of (code, id). Rows are counted in ranges of the code, by its quantiles, and offset by the ranges before."""
    return with_sequence(coded.withColumn("_number", code_number()), "_number", "code", "id", out="position").select("id", "code", "position")


def query_positions(coded: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id and position: how many codes of the curve are below the query's (its lower bound). An as-of search: both are merged in ranges of the code."""
    both = coded.select(F.lit(None).cast("long").alias("query_id"), "code", F.lit(1).alias("one")).unionByName(queries.select(F.col("id").alias("query_id"), "code", F.lit(0).alias("one")))
    bounds = range_bounds(coded, code_number())
    both = both.withColumn("lead", range_place(code_number(), bounds))
    before = offsets(both.groupBy("lead").agg(F.sum("one").alias("n")), "lead", "n", len(bounds) + 1)
    below = Window.partitionBy("lead").orderBy("code", "one").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("below", F.sum("one").over(below)).filter("query_id IS NOT NULL")
    return found.select("query_id", (F.col("below") + before).cast("long").alias("position"))


def candidates(curve: DataFrame, at: DataFrame, half: int) -> DataFrame:
    """query_id and id of rows at positions from position - half to position + half - 1. The range join is an equi-join: positions in blocks of `half`."""
    wanted = at.withColumn("block", F.explode(F.expr(f"sequence((position - {half}) div {half} - 1, (position + {half} - 1) div {half})")))
    rows = curve.select("id", F.col("position").alias("p"), F.expr(f"position div {half}").alias("block"))
    near = rows.join(wanted, "block").filter(f"p >= position - {half} AND p <= position + {half} - 1")
    return near.select("query_id", "id")


def zorder_candidates(queries: DataFrame, window: DataFrame, header: Header, half: int, n_curves: int = 1, seed: int = 1, bits: int = 21) -> DataFrame:
    """Distinct candidates over all curves."""
    ranges, out = _known(feature_ranges(window.unionByName(queries), header.dim)), None
    for shifts in curve_shifts(n_curves, header.dim, seed):
        coded = codes(window, ranges, header, shifts, bits)
        found = candidates(positions(coded), query_positions(coded, codes(queries, ranges, header, shifts, bits)), half)
        out = found if out is None else out.unionByName(found)
    return out.distinct()


def wide_half(window: DataFrame, least: int = 512) -> int:
    """Half a candidate window that grows with the table: an eighth of its rows, and `least` at the fewest. Narrower ones lose neighbours as the table grows."""
    return max(least, -(-window.count() // 8))


def is_wide(queries: DataFrame, window: DataFrame, half: int, n_curves: int) -> bool:
    """Whether the windows of all curves together have as many places as the table has rows. Not where ids are missing or repeated, as rows are then told apart by no key."""
    sides = queries.select("id", F.lit(0).alias("side")).unionByName(window.select("id", F.lit(1).alias("side")))
    sizes = {r["side"]: r for r in sides.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("different")).collect()}
    return all(r["n"] == r["different"] for r in sizes.values()) and 2 * half * n_curves >= (sizes[1]["n"] if 1 in sizes else 0)


def packed_codes(x: np.ndarray, types: tuple[int, ...], shifts: list[int] | None, bits: int = 21) -> np.ndarray:
    """The codes of codes() as bytes, padded with zeros at the end; x: scaled features."""
    x = np.nan_to_num(x, nan=0.0)
    q = np.stack([x[:, i].astype(np.int64) * 1_000_000 if kind else (np.maximum(x[:, i], 0.0) * 1_000_000.0).astype(np.int64) for i, kind in enumerate(types)], 1) & V.UINT32
    if shifts:
        q = (q + np.array(shifts, np.int64)) & V.UINT32
    q >>= np.maximum(np.frexp(q.astype(float))[1] - bits, 0)  # of longer numbers the leading bits
    planes = (q[:, None, ::-1] >> np.arange(bits - 1, -1, -1)[None, :, None]) & 1
    return np.packbits(planes.astype(np.uint8).reshape(len(x), -1), axis=1)


@dataclass(frozen=True)
class Coder:
    """Codes of several curves; curves: of each the features that it takes, their types, and shifts. made: what the curves take in place of the row's `dim` features, if anything."""

    dim: int
    low: np.ndarray
    high: np.ndarray
    curves: list[tuple[slice, tuple[int, ...], list[int] | None]]
    made: Callable[[np.ndarray], np.ndarray] | None = None
    bits: int = 21

    @property
    def width(self) -> int:
        """Bytes of a code at most."""
        return max(-(-len(types) * self.bits // 8) for _, types, _ in self.curves)

    def codes(self, column) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each curve the codes as bytes, and a number of each code that does not decrease along the curve."""
        raw, out = matrix(column, self.dim), []
        raw = raw if self.made is None else self.made(raw)
        for own, types, shifts in self.curves:
            packed = packed_codes(Metric(types, self.low[own], self.high[own]).scaled(raw[:, own]), types, shifts, self.bits)
            number = np.zeros(len(packed))
            for byte in packed[:, :26].T:
                number = number * 256 + byte
            out.append((packed, number))
        return out


def coded_curves(rows: DataFrame, coder: Coder) -> DataFrame:
    """curve, id, code (bytes) and number of all curves."""
    schema = T.StructType([T.StructField("curve", T.IntegerType()), rows.schema["id"], T.StructField("code", T.BinaryType()), T.StructField("number", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            for c, (packed, number) in enumerate(coder.codes(batch.column(1))):
                code = pa.array(np.ascontiguousarray(packed).reshape(-1).view(f"V{packed.shape[1]}").tolist(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(packed), c, np.int32)), batch.column(0), code, pa.array(number)], names=schema.names)

    return rows.select("id", "features").mapInArrow(run, schema)


def _bytes(packed: np.ndarray) -> np.ndarray:
    """Codes of one length as one value each, in their order."""
    return np.ascontiguousarray(packed).reshape(-1).view(f"S{packed.shape[1]}")


def code_bounds(coded: DataFrame, n_curves: int) -> list[list[float]]:
    """Of each curve, quantiles of its numbers that part all curves into about as many ranges as there are shuffle partitions."""
    parts = int(coded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    steps = [(i + 1) / parts * n_curves for i in range(-(-parts // n_curves) - 1) if (i + 1) * n_curves < parts]
    bounds = [[] for _ in range(n_curves)]
    if steps:
        for curve, found in coded.groupBy("curve").agg(F.percentile_approx("number", F.array(*map(F.lit, steps)))).collect():  # at most `parts` numbers
            bounds[curve] = sorted(set(found))
    return bounds


def place_counts(rows: DataFrame, coder: Coder, bounds: list[list[float]], asked: list[np.ndarray]) -> dict[tuple[int, int], int]:
    """How many rows of a curve are in a range (curve, -1 - range), and how many have as many of the sorted codes `asked` not above their own (curve, codes). One scan, in which nothing is sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros(len(b) + 1 + len(a) + 1, np.int64) for b, a in zip(bounds, asked)]
        for batch in filter(len, batches):
            for c, (packed, number) in enumerate(coder.codes(batch.column(0))):
                ranges = len(bounds[c]) + 1
                held[c] += np.bincount(np.searchsorted(bounds[c], number), minlength=len(held[c]))
                held[c] += np.bincount(ranges + np.searchsorted(asked[c], _bytes(packed), "right"), minlength=len(held[c]))
        for c, n in enumerate(held):
            at, ranges = np.flatnonzero(n), len(bounds[c]) + 1
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), c, np.int32)), pa.array(np.where(at < ranges, -1 - at, at - ranges)), pa.array(n[at])], names=["curve", "at", "n"])

    found = rows.select("features").mapInArrow(run, "curve int, at long, n long").groupBy("curve", "at").agg(F.sum("n").alias("n"))
    return {(r["curve"], r["at"]): r["n"] for r in found.collect()}  # a range or a query of a curve each


def curve_positions(window: DataFrame, queries: DataFrame, coder: Coder, most: int = MOST_BROADCAST) -> tuple[DataFrame, DataFrame]:
    """id and positions (an array of double, one a curve) of both sides: places of the window's rows in the order of (code, id), and of each query the number of codes below its own.

    Rows of a curve are counted in ranges of its number and offset by the ranges before, so no task sorts a curve. Up to `most` queries (of at most MOST_BYTES) are placed by the scan that counts
    the ranges; more are sorted along with the window."""
    n_curves, coded = len(coder.curves), coded_curves(window, coder)
    bounds = code_bounds(coded, n_curves)
    most = max(1, min(most, MOST_BYTES // (8 * coder.dim + n_curves * coder.width)))
    few = queries.select("id", "features").limit(most + 1).toArrow()  # at most `most` rows and MOST_BYTES
    counted, asked = few.num_rows <= most, [np.zeros(0, "S1")] * n_curves
    if counted and few.num_rows:
        listed = zip(*[[_bytes(packed) for packed, _ in coder.codes(batch.column(1))] for batch in few.to_batches(max_chunksize=2000)])
        asked = [np.concatenate(codes_) for codes_ in listed]
    ordered = [np.unique(codes_) for codes_ in asked]
    counts = place_counts(window, coder, bounds, ordered)
    starts = [[sum(counts.get((c, -1 - k), 0) for k in range(lead)) for lead in range(len(b) + 1)] for c, b in enumerate(bounds)]
    before = F.get(F.get(F.array(*[F.array(*map(F.lit, s)).cast("array<long>") for s in starts]), F.col("curve")), F.col("lead"))
    own = F.get(F.array(*[F.array(*map(F.lit, b)).cast("array<double>") for b in bounds]), F.col("curve"))
    placed = lambda rows: rows.withColumn("lead", F.size(F.filter(own, lambda b: b < F.col("number")))).drop("number")
    both = placed(coded).withColumn("one", F.lit(1))
    if not counted:
        both = both.unionByName(placed(coded_curves(queries, coder)).withColumn("one", F.lit(0)))
    up_to = Window.partitionBy("curve", "lead").orderBy("code", "one", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = both.select("curve", "id", "one", (F.sum("one").over(up_to) - F.col("one") + before).cast("double").alias("position"))

    def side(one: int) -> DataFrame:
        listed = at.filter(F.col("one") == one).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("curve", "position"))).alias("p"))
        return listed.select("id", F.col("p.position").alias("positions"))

    if not counted:
        return side(1), side(0)
    below = [np.cumsum([counts.get((c, i), 0) for i in range(len(u))]) for c, u in enumerate(ordered)]
    found = np.stack([b[np.searchsorted(u, codes_)] for b, u, codes_ in zip(below, ordered, asked)], 1).astype(float) if few.num_rows else np.zeros((0, n_curves))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * n_curves), pa.array(found.ravel()))
    schema = T.StructType([queries.schema["id"], T.StructField("positions", T.ArrayType(T.DoubleType()))])
    return side(1), window.sparkSession.createDataFrame(pa.table([few.column("id"), lists], names=["id", "positions"]), schema)


def _wide(queries: DataFrame, window: DataFrame, header: Header, k: int, half: int, low: np.ndarray, high: np.ndarray, coder: Coder) -> DataFrame:
    """The k nearest of each query among the rows that are near on a curve; low, high: ranges of both sides."""
    carried = lambda rows, at: rows.join(at, "id").withColumn("features", F.concat("features", "positions")).drop("positions")
    w, q = (carried(rows, at) for rows, at in zip((window, queries), curve_positions(window, queries, coder)))
    return top_k(nearest(q, w, Near(Metric(header.types, low, high), len(coder.curves), half), k), k)


def _ranges(rows: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    low, high = known_ranges(feature_ranges(rows, dim))
    return (low, high) if len(low) else (np.zeros(dim), np.zeros(dim))  # no row, no range


def knn_zorder(queries: DataFrame, window: DataFrame, header: Header, k: int = 10, n_curves: int = 10, curve_header: Header | None = None, seed: int = 1, half: int | None = None) -> DataFrame:
    """The k nearest of each query among the candidates of all curves. curve_header: the leading features that the curves use, if not all. half: half the window, k if not given."""
    if is_wide(queries, window, half or k, n_curves):
        own = curve_header or header
        low, high = _ranges(window.unionByName(queries), header.dim)
        curves = [(slice(0, own.dim), own.types, shifts) for shifts in curve_shifts(n_curves, own.dim, seed)]
        return _wide(queries, window, header, k, half or k, low, high, Coder(header.dim, low, high, curves))
    found = zorder_candidates(queries, window, curve_header or header, half or k, n_curves, seed)
    ranges = _known(feature_ranges(window.unionByName(queries), header.dim))  # with the queries
    return refine(found, queries, window, header, k, ranges)


def knn_projected(queries: DataFrame, window: DataFrame, header: Header, k: int = 10, n_curves: int = 10, target: int = 4, half: int = 512, seed: int = 1) -> DataFrame:
    """Curves over random projections to `target` dimensions, each of its own seed, with a window that does not depend on k."""
    flat, out = Header.numeric(target), None
    if is_wide(queries, window, half, n_curves):
        dim, every = header.dim, np.concatenate([sign_matrix(target, header.dim, seed + curve) for curve in range(n_curves)])
        low, high = _ranges(project_all(window.unionByName(queries), every), dim + len(every))
        curves = [(slice(c * target, (c + 1) * target), flat.types, None) for c in range(n_curves)]
        return _wide(queries, window, header, k, half, low[:dim], high[:dim], Coder(dim, low[dim:], high[dim:], curves, lambda x: projected(x, every)))
    for curve in range(n_curves):
        matrix = sign_matrix(target, header.dim, seed + curve)
        q, w = (project(d, matrix).select("id", F.col("projected").alias("features")) for d in (queries, window))
        ranges = _known(feature_ranges(w.unionByName(q), target))
        coded = codes(w, ranges, flat)
        found = candidates(positions(coded), query_positions(coded, codes(q, ranges, flat)), half)
        out = found if out is None else out.unionByName(found)
    return refine(out, queries, window, header, k, _known(feature_ranges(window.unionByName(queries), header.dim)))


def approximation_error(exact: DataFrame, approximate: DataFrame, k: int) -> DataFrame:
    """One row: mean over queries of the approximate k-th distance divided by the exact one (both as roots), pairs of 0 counting as 1."""
    e = exact.filter(F.col("place") == k).select("query_id", F.sqrt("distance").alias("e"))
    a = approximate.filter(F.col("place") == k).select("query_id", F.sqrt("distance").alias("a"))
    ratio = F.when(F.col("e") > 0, F.col("a") / F.col("e")).when(F.col("a") == 0, F.lit(1.0))
    return e.join(a, "query_id").agg(F.avg(ratio).alias("epsilon"), F.count(F.lit(1)).alias("n"))
