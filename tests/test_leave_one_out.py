"""Leave-one-out by classes of equal rows against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.operators import knn as K
from brindle.schema import Header


def made(spark, n=240, labels=None):
    rng = np.random.default_rng(5)
    x = np.stack([rng.integers(0, 5, n), rng.integers(0, 3, n), rng.integers(0, 2, n)], 1).astype(float)  # 30 classes, and ties between them
    x[0, 0], x[1, 0] = 0.0, -0.0
    y = rng.normal(size=n).tolist() if labels is None else labels
    ids = rng.permutation(n * 2)[:n].tolist()
    return spark.createDataFrame([(i, v.tolist(), l, 1.0) for i, v, l in zip(ids, x, y)], "id long, features array<double>, label double, weight double"), np.array(ids), x, y


def nearest_others(ids, x, k):
    z = np.column_stack([(x[:, 0] - x[:, 0].min()) / (x[:, 0].max() - x[:, 0].min()), x[:, 1:]])
    out = {}
    for q in range(len(ids)):
        d = (z[:, 0] - z[q, 0]) ** 2 + (z[:, 1] != z[q, 1]) + (z[:, 2] != z[q, 2])
        out[int(ids[q])] = [i for i in np.lexsort((ids, d)) if i != q][:k]
    return out


def check_errors(spark, squared):
    df, ids, x, y = made(spark)
    want = nearest_others(ids, x, 4)
    at = {int(i): n for n, i in enumerate(ids)}
    for r in K.best_k(df, Header((0, 1, 1)), 4, numeric=True, squared=squared).collect():
        off = np.array([np.mean([y[i] for i in near[: r["k"]]]) - y[at[q]] for q, near in want.items()])
        assert abs(r["errors"] - (np.sqrt((off**2).mean()) if squared else np.abs(off).mean())) < 1e-9


def test_each_class_is_searched_for_once(spark, monkeypatch):
    df, ids, x, _ = made(spark)
    seen, knn = [], K.knn
    monkeypatch.setattr(K, "knn", lambda q, w, *a, **b: seen.append((q.count(), w.count())) or knn(q, w, *a, **b))
    got = K.leave_one_out(df, Header((0, 1, 1)), 6).collect()
    assert seen[0][0] == len(np.unique(x, axis=0)) == 30 and seen[0][1] <= 30 * 7
    want = nearest_others(ids, x, 6)
    assert {(r["query_id"], r["place"], r["id"]) for r in got} == {(q, p + 1, int(ids[i])) for q, near in want.items() for p, i in enumerate(near)}


def test_mean_absolute_error(spark):
    check_errors(spark, False)


def test_few_rows_and_missing_labels(spark):
    df = spark.createDataFrame([(0, [1.0], 1.0, 1.0), (1, [1.0], None, 1.0), (2, [1.0], 4.0, 1.0)], "id long, features array<double>, label double, weight double")
    got = {r["k"]: r["errors"] for r in K.best_k(df, Header((0,)), 3, numeric=True).collect()}
    assert got == {1: 3.0, 2: 3.0, 3: 3.0}  # row 0 has the missing label and 4, row 2 has 1 and the missing one
    assert K.best_k(df.filter("id = 0"), Header((0,)), 3, numeric=True).count() == 0 == K.leave_one_out(df.filter("id > 5"), Header((0,)), 3).count()


def test_root_mean_squared_error(spark):
    check_errors(spark, True)


def test_the_search_has_as_many_tasks_as_its_pairs_need(spark, monkeypatch):
    """By their bytes, the few rows of all classes would be searched in one task, however many pairs they make."""
    df, seen, knn = made(spark)[0], [], K.knn
    monkeypatch.setattr(K, "PAIRS_A_TASK", 1000, raising=False)
    monkeypatch.setattr(K, "knn", lambda q, w, *a, **b: seen.append(w.select(F.spark_partition_id()).distinct().count()) or knn(q, w, *a, **b))
    K.best_k(df, Header((0, 1, 1)), 4, numeric=True, squared=True)
    assert seen == [4]


def test_rows_beyond_the_first_of_their_class(spark):
    """Most rows of a class are not among its nearest rows, and have the means of the class; the others leave out themselves."""
    df = spark.createDataFrame([(i, [float(i % 2)], float(i * i % 13) if i % 5 else None, 1.0) for i in range(40)], "id long, features array<double>, label double, weight double")
    label = {i: float(i * i % 13) if i % 5 else None for i in range(40)}
    for r in K.best_k(df, Header((0,)), 3, numeric=True).collect():
        off = []
        for q in range(40):
            near = [label[i] for i in sorted(range(40), key=lambda i: ((i - q) % 2, i)) if i != q][: r["k"]]
            known = [v for v in near if v is not None]
            off += [abs(sum(known) / len(known) - label[q])] if known and label[q] is not None else []
        assert abs(r["errors"] - np.mean(off)) < 1e-9
