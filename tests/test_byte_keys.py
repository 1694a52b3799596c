"""Byte keys and places in ranges: values beyond the bits, missing ones, and one look at each number."""

import numpy as np
from pyspark.sql import functions as F

from brindle.functions import curves as C
from brindle.operators import windows


def test_bytes_are_those_of_the_string(spark):
    values = [0, 1, 17, 128, 255, 256, 1000, 2**31, None]
    df = spark.createDataFrame([([a, b],) for a in values for b in values], "q array<long>")
    for r in df.select(C.morton_bytes("q", 2, 8).alias("key"), C.morton_bits("q", 2, 8).alias("bits")).collect():
        assert (r["key"] is None) == (r["bits"] is None) and (r["key"] is None or bytes(r["key"]) == int(r["bits"], 2).to_bytes(2, "big"))


def test_range_place(spark):
    x = [None, -1.0, 0.0, 0.5, 1.0, 2.0, 2.5, 99.0, float("nan")]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    bounds = [0.0, 1.0, 2.0, 3.0, 7.0]
    got = [r[0] for r in df.select(windows.range_place(F.col("x"), bounds)).collect()]
    assert got == [0, *np.searchsorted(bounds, x[1:-1]).tolist(), 5]


def test_a_number_is_computed_once_a_row(spark):
    """Not once for each bound, as where it stands in the loop over them."""
    number = F.conv(F.hex("id"), 16, 10).cast("double")
    text = spark.range(10).select(windows.range_place(number, [1.0, 2.0, 3.0]).alias("r"))._jdf.queryExecution().optimizedPlan().toString()
    assert "conv(" in text and "conv(" not in text.split("lambdafunction(", 1)[1]
