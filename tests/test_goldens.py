"""Worked examples of single operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.functions import vectors as V
from brindle.operators import evaluation, projections, rptree, sgd, sparse, windows, zorder
from brindle.operators.ranges import feature_ranges, widen, with_ranges
from brindle.operators.topk import top_k
from brindle.plans import queries
from brindle.plans.registry import QUERIES


def rows(spark, values):
    return spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(values)], "id long, features array<double>")


def test_ranges_and_update(spark):
    df = rows(spark, [[i + j + 1 for j in range(9)] for i in range(100)])
    r = feature_ranges(df, 9)
    assert r.first()["low"] == [float(j + 1) for j in range(9)] and r.first()["high"] == [100.0 + j for j in range(9)]
    wide = widen(r, rows(spark, [[0] * 8 + [1000]])).first()
    assert wide["low"] == [0.0] * 8 + [9.0] and wide["high"] == [100.0 + j for j in range(8)] + [1000.0]


def test_normalize(spark):
    df = rows(spark, [[i] * 3 for i in range(11)])
    got = with_ranges(df, feature_ranges(df, 3)).select("id", V.normalize("features", "low", "high", (0, 0, 0)).alias("x")).collect()
    assert all(np.allclose(r["x"], r["id"] / 10) for r in got)


def test_wide_and_narrow_normalize_agree(spark):
    rng = np.random.default_rng(1)
    df = rows(spark, rng.random((5, 20)))
    types = tuple([0] * 19 + [1])
    wide = with_ranges(df, feature_ranges(df, 20)).select("id", V.normalize("features", "low", "high", types).alias("x")).orderBy("id").collect()
    x = np.array([r["features"] for r in df.orderBy("id").collect()])
    want = (x - x.min(0)) / (x.max(0) - x.min(0))
    want[:, 19] = x[:, 19]
    assert np.array_equal(np.array([r["x"] for r in wide]), want)


def test_quantize(spark):
    df = rows(spark, [[0.01 * i for i in range(10)]])
    got = df.select(V.quantize("features", (0,) * 10).alias("q")).first()["q"]
    assert got == [int(0.01 * i * 1e6) for i in range(10)]


def test_batch_gradient(spark):
    """Three rows of ones with classes 0, 1, 2; the class slot is the bias' input."""
    weights = [[1, 1, 1, 1, 1], [0.5] * 5, [0, 1, 0, 0, 1]]
    w = spark.createDataFrame([(c, j - 1 if j else sgd.BIAS, float(weights[c][j]) if j else 0.0) for c in range(3) for j in range(5)], "class int, attr int, w double")
    data = rows(spark, [[1] * 4] * 3).withColumn("label", F.col("id").cast("int"))
    entries = sparse.sparsify(data)
    scores = sgd.class_scores(entries, data.select(F.col("id").alias("row_id"), "label"), w)
    assert {(r["row_id"], r["class"]): r["score"] for r in scores.collect()} == {(i, c): [4.0, 2.0, 2.0][c] for i in range(3) for c in range(3)}
    up = sgd.one_vs_all(scores)
    assert [r["update"] for r in up.orderBy("row_id", "class").collect()] == [0, -1, -1, -1, 0, -1, -1, -1, 0]
    for g in (sgd.gradient(entries, up, 3), sgd.dense_gradient(data, up, 3)):
        got = {(r["class"], r["attr"]): r["g"] for r in g.collect()}
        assert len(got) == 15 and np.allclose(list(got.values()), -2 / 3)


def test_one_bit_steps(spark):
    g = [0.7, 1.2, 0.5, 1.4, 0, 1.7, 0.2, 1.5, 0.4, 0, 1.3, 1.1, 0.5, 0, 1.2]
    state = spark.createDataFrame([(i, float(v), 0.0, 0.0, 1.0, 0) for i, v in enumerate(g)], "i int, g double, es double, el double, tau double, delta int")
    one = sgd.one_bit_step(state)
    got = one.orderBy("i").collect()
    assert np.allclose([r["es"] for r in got], [0.7, 0, 0.5, 0, 0, 0, 0.2, 0, 0.4, 0, 0, 0, 0.5, 0, 0])
    assert np.allclose([r["el"] for r in got], [0, 0.2, 0, 0.4, 0, 0.7, 0, 0.5, 0, 0, 0.3, 0.1, 0, 0, 0.2])


def test_hinge(spark):
    loss = spark.range(1).select(sgd.hinge_loss(F.lit(1), F.lit(500 * 1e-6)).alias("l"), sgd.hinge_factor(F.lit(1), F.lit(5e-4)).alias("f")).first()
    assert abs(loss["l"] - 0.9995) < 1e-4 and loss["f"] == -1.0


def test_rounds_equal_a_plain_fold(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(60, 3)), rng.integers(0, 3, 60)
    df = spark.createDataFrame([(i, x[i].tolist(), int(y[i]), i // 10, 0) for i in range(60)], "seq long, features array<double>, label int, batch int, worker int")
    got = sgd.train(df, 3, 3, list(range(6)), rate=0.1)
    w = np.zeros((3, 4))
    for b in range(6):
        z = np.hstack([x[b * 10 : b * 10 + 10], np.ones((10, 1))])
        s = np.where(y[b * 10 : b * 10 + 10, None] == np.arange(3), 1.0, -1.0)
        w = w + 0.1 * (np.where(s * (z @ w.T) < 1, s, 0).T @ z) / 10
    assert np.allclose(got, w)


@pytest.mark.parametrize("one_bit", [False, True])
def test_registered_training_uses_every_full_batch(spark, sf_dir, one_bit):
    table = sorted(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect())
    z = np.hstack([np.array([r["embedding"] for r in table], float), np.ones((len(table), 1))])
    y = np.where(np.array([[r["label"]] for r in table]) == np.arange(10), 1.0, -1.0)
    w = np.zeros((10, 65))
    es, el, tau = np.zeros((2, 10, 65)), np.zeros((2, 10, 65)), np.full((2, 10, 65), 0.05)
    assert len(table) // 64 > 4
    for b in range(len(table) // 64):
        parts = [slice(b * 64 + k, b * 64 + 64, 2) for k in range(2)]
        for k, g in enumerate([np.where(y[p] * (z[p] @ w.T) < 1, y[p], 0).T @ z[p] / 32 for p in parts]):
            s = g + es[k] + el[k]
            sent, sign = np.abs(s) + 1e-12 >= tau[k], np.where(s < 0, -1.0, 1.0)
            w = w + 0.01 * (np.where(sent, sign * tau[k], 0) if one_bit else g)
            el[k], es[k] = np.where(sent, sign * (np.abs(s) - tau[k]), 0), np.where(sent, 0, s)
        if one_bit and b % 2:
            tau[:] = np.maximum(1e-12, ((tau + np.abs(el)).mean(0) - np.abs(es).mean(0)) / 2)
    got = QUERIES["sgd_onebit" if one_bit else "sgd_train"](spark, sf_dir).collect()
    assert len(got) == 650 and np.allclose([r["w"] for r in got], w.ravel())


def test_fjlt_rows_are_independent(spark):
    df = rows(spark, np.random.default_rng(0).random((4, 5)))
    both = {r["id"]: r["projected"] for r in projections.fjlt(df, 5, 3).collect()}
    one = projections.fjlt(df.filter("id = 2"), 5, 3).first()["projected"]
    assert one == both[2]


def test_fjlt_keeps_lengths_on_average():
    padded, signs, places = projections.fjlt_parts(64, 64)
    x = np.random.default_rng(1).normal(size=(10, 64))
    y = projections.hadamard(x * signs)[:, places] / 8
    assert np.allclose((y**2).sum(1), (x**2).sum(1))


def test_sequence_ring_and_batches(spark):
    df = spark.range(100).select((F.col("id") * 37 % 101).alias("k")).repartition(5)
    seq = windows.with_sequence(df, "k")
    got = seq.orderBy("seq").collect()
    assert [r["seq"] for r in got] == list(range(100)) and [r["k"] for r in got] == sorted(r["k"] for r in got)
    assert windows.ring(seq, 10).count() == 10 and windows.mini_batches(seq, 30).count() == 90


def test_ties(spark):
    df = spark.createDataFrame([(0, i, d) for i, d in enumerate([1.0, 2.0, 2.0, 2.0, 3.0])], "query_id int, id int, distance double")
    assert top_k(df, 2).count() == 2 and top_k(df, 2, keep_ties=True).count() == 4


def test_metrics(spark):
    df = spark.createDataFrame([(i, a, p) for i, (a, p) in enumerate([(0, 0), (0, 0), (1, 0), (1, 1)])], "seq int, actual int, predicted int")
    m = evaluation.metrics(df).first()
    assert m["accuracy"] == 0.75 and abs(m["kappa"] - 0.5) < 1e-12 and m["kappa_temporal"] == 0.5


def test_rp_tree_reach_is_exact(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(400, 8)), rng.normal(size=(400, 8)) + 4])
    tree = rptree.RpTree(8, depth=5)
    for row in rng.permutation(x):
        tree.learn(row)
    assert len(tree.split) > 1
    df = spark.createDataFrame([(i, v.tolist(), 0.0, 1.0) for i, v in enumerate(x)], "id long, features array<double>, label double, weight double")
    got = rptree.knn_rptree(df.filter("id < 5"), df.filter("id >= 5"), tree, 8, k=5)
    for q in range(5):
        d = ((x[5:] - x[q]) ** 2).sum(1)
        assert [r["id"] for r in got.filter(F.col("query_id") == q).orderBy("place").collect()] == (np.argsort(d, kind="stable")[:5] + 5).tolist()


def recall(spark, sf_dir, found):
    """Share of the ten true neighbours by numpy, ranges with the queries, that were found; ids from 0 without gaps."""
    x = np.array([r["embedding"] for r in sorted(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect())], float)
    x = (x - x.min(0)) / (x.max(0) - x.min(0))
    true = {(q, int(i)) for q in range(0, len(x), 50) for i in np.argsort(((x - x[q]) ** 2).sum(1), kind="stable")[:10]}
    return len(true & {(r["query_id"], r["id"]) for r in found.select("query_id", "id").collect()}) / len(true)


@pytest.mark.parametrize("name", ["knn_zorder_wide", "knn_projected_wide"])
def test_wide_curves_find_the_neighbours(spark, name):
    sf = "/root/testdata/sf0.1"
    assert recall(spark, sf, QUERIES[name](spark, sf)) >= 0.9


@pytest.mark.parametrize("search", [zorder.knn_zorder, zorder.knn_projected])
def test_an_eighth_on_each_side_is_enough(spark, search):
    """Windows that do not hold the whole table."""
    sf = "/root/testdata/sf0.1"
    q, w = queries.sides(spark, sf)
    assert zorder.wide_half(w, 1) == 250 and recall(spark, sf, search(q, w, queries.EMB, half=250)) >= 0.9


def test_error_of_wide_curves(spark):
    got = QUERIES["eps_error_wide"](spark, "/root/testdata/sf0.1").first()
    assert 1 <= got["epsilon"] < 1.01 and got["n"] == 40


def test_empty_tables(spark):
    none = rows(spark, [[1.0, 2.0]]).filter("id < 0")
    assert feature_ranges(none, 2).first()["low"] == [None, None]
    assert windows.with_sequence(none, "id").count() == 0
