"""The blocked search by positions on curves against the equi-join on candidates."""

import numpy as np
import pytest

from brindle.operators import zorder
from brindle.plans.queries import QUERIES
from brindle.schema import Header


def rows(spark, x, ids=None):
    return spark.createDataFrame([(int(i), v, float(i % 3), 1.0) for i, v in zip(ids or range(len(x)), x)], "id long, features array<double>, label double, weight double")


def both_ways(monkeypatch, search, q, w, **options):
    """Rows by blocks and by the join."""
    wide = sorted(map(tuple, search(q, w, **options).collect()))
    monkeypatch.setattr(zorder, "is_wide", lambda *a: False)
    return wide, sorted(map(tuple, search(q, w, **options).collect()))


@pytest.mark.parametrize("n, half", [(300, 60), (60, 200), (120, 20)])
def test_zorder_by_blocks(spark, monkeypatch, n, half):
    x = np.random.default_rng(n).integers(0, 6, (n, 5)).astype(float)  # with equal codes
    df, header = rows(spark, x.tolist()), Header((0, 0, 0, 0, 1))
    q = df.filter("id % 9 = 0")
    assert zorder.is_wide(q, df, half, 3)
    got, want = both_ways(monkeypatch, zorder.knn_zorder, q, df, header=header, k=5, n_curves=3, half=half)
    assert got == want and len(got) == 5 * len(range(0, n, 9))


def test_few_candidates_stay_few(spark, monkeypatch):
    """Fewer candidates than k: no other row takes their places."""
    df = rows(spark, np.random.default_rng(1).normal(size=(40, 4)).tolist())
    got, want = both_ways(monkeypatch, zorder.knn_zorder, df.filter("id < 4"), df, header=Header.numeric(4), k=30, n_curves=5, half=4)
    assert got == want and all(sum(r[0] == q for r in got) < 30 for q in range(4))


def test_queries_out_of_the_window_and_no_rows(spark, monkeypatch):
    x = np.random.default_rng(3).normal(size=(100, 6))
    q, w, none = rows(spark, (x[:5] * 2).tolist(), list(range(500, 505))), rows(spark, x.tolist()), rows(spark, x[:1].tolist()).filter("id < 0")
    assert zorder.knn_zorder(none, w, Header.numeric(6), half=50).count() == 0
    assert zorder.knn_zorder(q, none, Header.numeric(6), half=50).count() == 0
    got, want = both_ways(monkeypatch, zorder.knn_zorder, q, w, header=Header.numeric(6), k=3, n_curves=2, half=30)
    assert got == want and len(got) == 15


def test_repeated_ids_take_the_join(spark):
    df = rows(spark, [[1.0, 2.0], [1.0, 2.0], [3.0, 4.0]], [0, 0, 1])
    assert not zorder.is_wide(df.filter("id = 1"), df, 100, 10)
    assert zorder.knn_zorder(df.filter("id = 1"), df, Header.numeric(2), k=3, half=100).count() == 3


def test_missing_values_are_farthest(spark):
    x = np.random.default_rng(4).normal(size=(30, 3))
    x[7] = np.nan
    df = rows(spark, x.tolist())
    got = zorder.knn_zorder(df.filter("id in (3, 7)"), df, Header.numeric(3), k=30, half=30).collect()
    assert len(got) == 60 and [r["id"] for r in got if r["query_id"] == 3][-1] == 7


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_eps_error_wide_makes_no_candidate_rows(spark):
    assert "explode(sequence(" not in plan(QUERIES["eps_error_wide"](spark, "/root/testdata/sf0.01"))


def test_knn_projected_wide_makes_no_candidate_rows(spark):
    assert "explode(sequence(" not in plan(QUERIES["knn_projected_wide"](spark, "/root/testdata/sf0.01"))


@pytest.mark.parametrize("half", [30, 400])
def test_projected_by_blocks(spark, monkeypatch, half):
    df = rows(spark, np.random.default_rng(2).normal(size=(200, 20)).tolist())
    got, want = both_ways(monkeypatch, zorder.knn_projected, df.filter("id % 20 = 3"), df, header=Header.numeric(20), k=4, n_curves=4, half=half)
    assert got == want and len(got) == 40


def test_knn_zorder_wide_makes_no_candidate_rows(spark):
    assert "explode(sequence(" not in plan(QUERIES["knn_zorder_wide"](spark, "/root/testdata/sf0.01"))


def test_queries_are_placed_without_sorting_the_window(spark, monkeypatch):
    """The scan that counts the rows of a range places the queries, too; more queries than `most` are sorted along, with the same positions."""
    x = np.random.default_rng(6).integers(0, 4, (150, 3)).astype(float)  # with equal codes
    df = rows(spark, x.tolist())
    q, near, seen = df.filter("id % 10 = 0"), zorder.nearest, []
    monkeypatch.setattr(zorder, "nearest", lambda q, *a: seen.append(plan(q)) or near(q, *a))
    assert zorder.knn_projected(q, df, Header.numeric(3), k=4, n_curves=3, half=40).count() == 60
    assert len(seen) == 1 and "Window" not in seen[0]
    coder = zorder.Coder(3, np.zeros(3), np.full(3, 3.0), [(slice(0, 3), (0, 0, 0), shifts) for shifts in zorder.curve_shifts(3, 3)])
    (w1, q1), (w2, q2) = (zorder.curve_positions(df, q, coder, most=most) for most in (20, 4))
    assert "Window" not in plan(q1) and "Window" in plan(q2) and q1.count() == 15
    assert sorted(map(tuple, q1.collect())) == sorted(map(tuple, q2.collect())) and sorted(map(tuple, w1.collect())) == sorted(map(tuple, w2.collect()))
