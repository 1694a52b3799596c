"""Z-order (Morton) codes of quantised features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def morton_bits(q: str, dim: int, bits: int = 32) -> Column:
    """A string of dim * bits zeros and ones, most significant first; in each bit plane the last dimension leads. Its order is the curve's."""
    planes = [f"substr(lpad(bin({q}[{d}]), {bits}, '0'), {b + 1}, 1)" for b in range(bits) for d in reversed(range(dim))]
    if len(planes) <= 32:
        return F.expr(f"concat({', '.join(planes)})")
    # wide codes: one loop over planes, the bits of each dimension being taken once
    rows = F.transform(F.reverse(q), lambda v: F.lpad(F.bin(v), bits, "0"))  # q is named once: a term for each dimension copies what is below it
    return F.transform(F.array(rows), lambda r: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(bits)), lambda b: F.array_join(F.transform(r, lambda x: F.substring(x, b, F.lit(1))), "")), ""))[0]


def morton_bytes(q: str, dim: int, bits: int = 32) -> Column:
    """The same code as bytes, of (dim * bits) / 8; binary columns compare unsigned, byte by byte."""
    if dim * bits <= 56 and dim * bits % 8 == 0:
        # by shifts of a long, in generated code; of longer numbers the leading bits, as in the string
        own = [f"(CASE WHEN {q}[{d}] BETWEEN 0 AND {(1 << bits) - 1} THEN {q}[{d}] ELSE CAST(conv(substr(bin({q}[{d}]), 1, {bits}), 2, 10) AS BIGINT) END)" for d in range(dim)]
        return F.unhex(F.lpad(F.hex(F.expr(_long(own, bits))), dim * bits // 4, "0"))
    code = morton_bits(q, dim, bits)
    nibbles = F.transform(F.sequence(F.lit(0), F.lit(dim * bits // 4 - 1)), lambda i: F.conv(F.substring(code, i * 4 + 1, F.lit(4)), 2, 16))
    return F.unhex(F.array_join(nibbles, ""))


def _long(parts: list[str], bits: int) -> str:
    return " | ".join(f"shiftleft(shiftright({x}, {b}) & 1L, {b * len(parts) + d})" for b in range(bits) for d, x in enumerate(parts))


def morton_long(q: str, dim: int, bits: int) -> Column:
    """The same code as a long, where dim * bits is at most 63."""
    if dim * bits > 63:
        raise ValueError("a long holds 63 bits")
    return F.expr(_long([f"{q}[{d}]" for d in range(dim)], bits))
