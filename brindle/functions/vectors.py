"""Column expressions over feature arrays of a known length: normalising, quantising, distances, similarities.

Sums over features are written out term by term, left to right from 0.0, so they stay inside generated code and give
the same doubles as a fold in that order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

UINT32 = 4294967295
#: Rows of more features are scaled by one loop, as a term for each would not compile.
WIDE = 16


def _sum(terms: list[str]) -> Column:
    return F.expr("0.0D + " + " + ".join(terms) if terms else "0.0D")


def _each(terms: list[str]) -> Column:
    return F.expr(f"array({', '.join(terms)})")


def dot(a: str, b: str, dim: int) -> Column:
    """Sum of products; also a dense matrix row times a vector."""
    return _sum([f"{a}[{i}] * {b}[{i}]" for i in range(dim)])


def normalize(x: str, low: str, high: str, types: tuple[int, ...], floor: float | None = None) -> Column:
    """Min-max scaling of numeric features, 0 where the range is empty; nominal ones are unchanged. floor: least value, without an upper one."""
    if len(types) > WIDE:
        minus = lambda a, b: F.zip_with(a, b, lambda u, v: u - v)
        cut = (lambda v: v) if floor is None else (lambda v: F.greatest(v, F.lit(float(floor))))
        scaled = F.zip_with(minus(x, low), minus(high, low), lambda d, w: cut(F.when(w > 0, d / w).otherwise(F.lit(0.0))))
        if not any(types):
            return scaled
        kinds = F.array(*[F.lit(int(t)) for t in types])
        return F.zip_with(F.zip_with(F.col(x), kinds, lambda v, t: F.when(t != 0, v)), scaled, lambda v, w: F.coalesce(v, w))

    def one(i: int, kind: int) -> str:
        if kind:
            return f"{x}[{i}]"
        scaled = f"CASE WHEN {high}[{i}] - {low}[{i}] > 0 THEN ({x}[{i}] - {low}[{i}]) / ({high}[{i}] - {low}[{i}]) ELSE 0.0D END"
        return scaled if floor is None else f"greatest({scaled}, {float(floor)}D)"

    return _each([one(i, kind) for i, kind in enumerate(types)])


def quantize(x: str, types: tuple[int, ...], scale: int = 1_000_000) -> Column:
    """Unsigned 32-bit integers: numeric features are scaled then truncated, nominal ones truncated then scaled."""
    if len(types) > WIDE and not any(types):
        return F.transform(x, lambda v: (v * float(scale)).cast("long").bitwiseAND(UINT32))
    return _each([f"CAST({x}[{i}] AS BIGINT) * {scale}L & {UINT32}L" if kind else f"CAST({x}[{i}] * {scale}D AS BIGINT) & {UINT32}L" for i, kind in enumerate(types)])


def shift(q: str, by: str, dim: int) -> Column:
    """Adds a shift to each quantised feature, modulo 2^32."""
    if dim > WIDE:
        return F.zip_with(q, by, lambda v, s: (v + s).bitwiseAND(UINT32))
    return _each([f"({q}[{i}] + {by}[{i}]) & {UINT32}L" for i in range(dim)])


def nan_to_zero(x: Column, infinite: bool = True) -> Column:
    """Missing values as 0; with infinite, infinite ones too."""
    bad = lambda v: v.isNull() | F.isnan(v) | ((F.abs(v) == float("inf")) if infinite else F.lit(False))
    return F.transform(x, lambda v: F.when(bad(v), F.lit(0.0)).otherwise(v))


def to_float(x: Column) -> Column:
    return x.cast("array<float>")


def squared_distance(a: str, b: str, types: tuple[int, ...]) -> Column:
    """Of normalised rows: squared differences of numeric features, and 1 for each nominal one whose integer parts differ."""
    return _sum([f"CASE WHEN CAST({a}[{i}] AS INT) <> CAST({b}[{i}] AS INT) THEN 1.0D ELSE 0.0D END" if kind else f"({a}[{i}] - {b}[{i}]) * ({a}[{i}] - {b}[{i}])" for i, kind in enumerate(types)])


def euclidean(a: str, b: str, types: tuple[int, ...]) -> Column:
    return F.sqrt(squared_distance(a, b, types))


def inner_product(a: str, b: str, types: tuple[int, ...]) -> Column:
    """Of two rows: products of numeric features, and 1 for each nominal one that differs."""
    return _sum([f"CASE WHEN CAST({a}[{i}] AS INT) <> CAST({b}[{i}] AS INT) THEN 1.0D ELSE 0.0D END" if kind else f"{a}[{i}] * {b}[{i}]" for i, kind in enumerate(types)])


def squared_norm(x: str, types: tuple[int, ...]) -> Column:
    """Once a row, before rows meet: squares of numeric features, and 1 for each nominal one."""
    return _sum(["1.0D" if kind else f"{x}[{i}] * {x}[{i}]" for i, kind in enumerate(types)])


def squared_norm_cosine(inner: Column, x: Column, y: Column) -> Column:
    """1 - acos(inner / (|a|^2 |b|^2)) / pi: the angular similarity of unit rows; the divisor is the product of squared norms x and y. Out of the domain: null."""
    ratio = F.when(x * y > 0, inner / (x * y))
    return F.when(F.abs(ratio) <= 1, 1 - F.acos(ratio) / math.pi)


def true_cosine(inner: Column, x: Column, y: Column) -> Column:
    """The cosine itself; null where a row is zero."""
    return F.when((x > 0) & (y > 0), inner / (F.sqrt(x) * F.sqrt(y)))


def normalized_cosine_distance(inner: Column, x: Column, y: Column) -> Column:
    """2 - inner / (|a|^2 |b|^2), inner being of the normalised rows and the norms of the raw ones; null where one is zero."""
    return F.when(x * y > 0, 2 - inner / (x * y))


def rounded(x: Column, digits: int) -> Column:
    """To so many decimals, halves away from 0, in doubles: as SQL engines round a double, and without a decimal number for each row."""
    v = F.abs(x) * float(10**digits)
    return F.when(F.isnan(x) | (v >= float(2**52)), x).otherwise(F.signum(x) * F.floor(v + F.when(v < 0.5, 0.0).otherwise(0.5)).cast("double") / float(10**digits))


def erf(x: Column) -> Column:
    """The error function by the rational approximation 7.1.26 of Abramowitz and Stegun, within 1.5e-7."""
    # fixed values
    p, c = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    t = 1 / (1 + p * F.abs(x))
    poly = F.lit(0.0)
    for k in reversed(c):
        poly = (poly + k) * t
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def next_pow2(v: Column) -> Column:
    """The least power of two that is at least v."""
    return F.when(v <= 1, F.lit(1)).otherwise(F.pow(F.lit(2.0), F.ceil(F.log2(v)))).cast("long")


def tree_level(i: Column) -> Column:
    """Level of a heap node from 0; integers only, as a logarithm could round."""
    return (F.length(F.bin(i + 1)) - 1).cast("int")


def tree_parent(i: Column) -> Column:
    return F.when(i > 0, F.floor((i - 1) / 2)).cast("long")


def tree_left(i: Column) -> Column:
    return 2 * i + 1


def tree_right(i: Column) -> Column:
    return 2 * i + 2


def is_left(i: Column) -> Column:
    return i % 2 == 1


def max_level_id(level: Column) -> Column:
    """The last node of a level."""
    return F.shiftleft(F.lit(1).cast("long"), 1) * F.pow(F.lit(2.0), level).cast("long") - 2
