"""All pairs: slices of queries, copies, missing values, rounding."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.functions import vectors as V
from brindle.operators import blocked
from brindle.operators import knn as K
from brindle.plans import queries
from brindle.schema import Header

SF = "/root/testdata/sf0.01"


def rows(spark, x):
    return spark.createDataFrame([(i, v, 0.0, 1.0) for i, v in enumerate(x)], "id long, features array<double>, label double, weight double")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_many_queries_meet_the_window_without_a_shuffle(spark):
    x = np.random.default_rng(0).integers(0, 3, (90, 3)).astype(float)  # with copies
    df, header = rows(spark, x.tolist()), Header((0, 0, 1))
    both = K.pairs(df.select(F.col("id").alias("query_id"), F.col("features").alias("q")), df, most=20)
    assert "SortMergeJoin" not in plan(both) and "BroadcastHashJoin" not in plan(both)
    assert both.count() <= 5 * 27 * 90  # equal queries of a slice meet a row once
    ranges = K.feature_ranges(df, 3)
    want = {(a, b): sum((x[a][:2] / 2 - x[b][:2] / 2) ** 2) + (x[a][2] != x[b][2]) for a in range(90) for b in range(90)}
    for most, slices in ((20, 50), (20, 2), (1000, 50)):  # slices, the grid, and one slice
        with pytest.MonkeyPatch.context() as m:
            m.setattr(K, "pairs", lambda q, w, f=K.pairs: f(q, w, most, slices))
            got = K.distances(df, df, header, ranges).collect()
        assert len(got) == 8100 and all(abs(want[r["query_id"], r["id"]] - r["distance"]) < 1e-12 for r in got)


def test_equal_queries_meet_a_row_once_in_all_slices(spark):
    x = np.random.default_rng(5).integers(0, 3, (90, 3)).astype(float).tolist()
    x[3], x[4], x[5], x[6] = [0.0, float("nan"), 1.0], [-0.0, float("nan"), 1.0], None, None
    df = rows(spark, x)
    both = K.pairs(df.select(F.col("id").alias("query_id"), F.col("features").alias("q")), df, most=5)
    distinct = len({None if v is None else tuple(map(str, np.array(v) + 0.0)) for v in x})
    assert distinct > 10 and both.count() == distinct * 90
    ids = both.filter("id = 0").select(F.explode("query_ids")).collect()
    assert sorted(r[0] for r in ids) == list(range(90))


def test_pairs_of_one_file_are_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(blocked, "PAIRS_OUT", 1000)
    df = rows(spark, np.random.default_rng(6).normal(size=(90, 3)).tolist()).coalesce(1)
    both = K.pairs(df.select(F.col("id").alias("query_id"), F.col("features").alias("q")), df)
    assert both.count() == 90 * 90 and both.select(F.spark_partition_id().alias("task")).distinct().count() > 4


def test_rounding_is_that_of_sql(spark):
    x = [0.5, -0.5, 2.5e-9, -2.5e-9, 4.9999e-10, 1.0000000005, 0.1234567895, -0.9999999995, 1e300, float("nan"), float("inf"), None, 0.0, *np.random.default_rng(0).normal(size=500).tolist()]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(V.rounded(F.col("x"), 9)).collect()]
    want = [duckdb.execute("SELECT round(?::DOUBLE, 9)", [v]).fetchone()[0] for v in x]
    assert all(a == b or a != a and b != b for a, b in zip(got, want))


def check_cosine(spark, name, similarity, scaled=False):
    got = queries.QUERIES[name](spark, SF)
    assert "BroadcastNestedLoopJoin" not in plan(got) and "MapInArrow" in plan(got)  # 64 terms of a pair in generated code are interpreted: 10 microseconds a pair
    q, w = queries.sides(spark, SF)
    sliced = K.similarities(q, w, queries.EMB, similarity, K.feature_ranges(w, queries.DIM) if scaled else None, ("id",), most=3)
    sliced = sliced.select("query_id", "id", V.rounded(F.col("similarity"), 9).alias("similarity"))
    assert got.exceptAll(sliced).count() == sliced.exceptAll(got).count() == 0 and got.count() == 10 * 500


def test_cosine_norm(spark):
    check_cosine(spark, "cosine_norm", V.normalized_cosine_distance, True)


def test_similarities_of_missing_values_and_nominal_features(spark):
    df = rows(spark, [[1.0, 2.0, 3.0], [0.5, None, 3.0], [0.0, 0.0, 4.9], None, [0.0, 0.0, 4.1]])
    got = {(r["query_id"], r["id"]): r["similarity"] for r in K.similarities(df, df, Header((0, 0, 1)), V.true_cosine).collect()}
    assert len(got) == 25 and all((v is None) == bool({1, 3} & set(k)) for k, v in got.items())
    assert got[2, 4] == 0.0 and got[0, 0] == 5 / (6**0.5 * 6**0.5) and got[0, 2] == 1 / 6**0.5
    assert K.similarities(df.filter("id > 9"), df, Header((0, 0, 1)), V.true_cosine).count() == 0
    assert K.similarities(df, df.filter("id > 9"), Header((0, 0, 1)), V.true_cosine, K.feature_ranges(df.filter("id > 9"), 3)).count() == 0


def test_cosine_ref(spark):
    check_cosine(spark, "cosine_ref", V.squared_norm_cosine)


def test_cosine_true(spark):
    check_cosine(spark, "cosine_true", V.true_cosine)


@pytest.mark.parametrize("similarity", [V.true_cosine, V.squared_norm_cosine, V.normalized_cosine_distance])
def test_decimals_are_those_of_plain_sums(spark, monkeypatch, similarity):
    """Zero, tiny, huge, missing and equal rows, rows in a right angle, and rounded halves, with and without nominal features: the values of products()."""
    rng = np.random.default_rng(7)
    x = [*rng.normal(size=(60, 4)).tolist(), *np.round(rng.normal(size=(20, 4)), 1).tolist(), *(rng.normal(size=(4, 4)) * 1e-9).tolist(), *(rng.normal(size=(4, 4)) * 1e200).tolist()]
    x[:60] = (np.array(x[:60]) / np.linalg.norm(x[:60], axis=1)[:, None] * rng.choice([0.3, 1.0, 1.2], 60)[:, None]).tolist()  # ratios of both sides of 1
    x[60:63] = x[:3]
    unit = [[1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0], [-1.0, 0.0, 0.0, 0.0], [0.6, 0.8, 0.0, 0.0]]
    for extra in ([], [[0.0] * 4, *x[80:], [1.0, None, 2.0, 3.0], None, [float("nan"), 1.0, 2.0, 3.0], [float("inf"), 1.0, 2.0, 3.0]]):
        df = rows(spark, [*x[:80], *unit, *unit, *extra])
        for header in (Header.numeric(4), Header((0, 0, 1, 0))):
            args = df.filter("id % 3 = 0 OR id > 78"), df, header, similarity, None, ("id",)
            want = K.similarities(*args).select("query_id", "id", V.rounded(F.col("similarity"), 9).alias("similarity"))
            got = K.similarities(*args, digits=9)
            assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 and got.count() == want.count()


def leaves_python_rounded(spark, name):
    """Norms and inner products of a pair are no columns that a row carries out of the search."""
    text = plan(queries.QUERIES[name](spark, SF))
    return "MapInArrow" in text and "inner" not in text and "ACOS" not in text.upper()


def test_cosine_ref_is_rounded_where_rows_meet(spark):
    assert leaves_python_rounded(spark, "cosine_ref")


def test_cosine_true_is_rounded_where_rows_meet(spark):
    assert leaves_python_rounded(spark, "cosine_true")


@pytest.mark.parametrize("digits", [9, None])
def test_one_part_of_a_file_is_dealt_into_as_many_tasks_as_its_pairs_need(spark, monkeypatch, digits):
    """By its bytes, a window of few bytes would meet the queries in one task, however many pairs they make."""
    df = rows(spark, np.random.default_rng(3).normal(size=(40, 4)).tolist()).coalesce(1)
    pairs = lambda: K.similarities(df, df, Header.numeric(4), V.true_cosine, None, ("id",), most=15, digits=digits).select("query_id", "id", "similarity")
    whole = pairs().collect()
    monkeypatch.setattr(blocked, "PAIRS_OUT", 200, raising=False)
    dealt = pairs().select("*", F.spark_partition_id().alias("task")).collect()
    per_row = {r["id"]: set() for r in dealt}
    for r in dealt:
        per_row[r["id"]].add(r["task"])
    slices = max(map(len, per_row.values()))  # each slice of the queries has tasks of its own
    cores = spark.sparkContext.defaultParallelism
    assert len({r["task"] for r in dealt}) == -(-3 // cores) * cores * slices and slices == 3
    assert sorted(r[:3] for r in dealt) == sorted(map(tuple, whole)) and len(whole) == 1600
