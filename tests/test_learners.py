"""Learners by options, the registries, periodic hold-out, and the blocked search they rest on."""

import numpy as np
import pytest

from brindle.operators import kdtree, knn, learners, rptree, sgd
from brindle.operators.blocked import Metric, nearest
from brindle.operators.topk import top_k
from brindle.schema import Header
from brindle.sources import streams
from brindle.sources.sinks import read_results


def frame(spark, x, y=None, first=0):
    y = np.zeros(len(x), int) if y is None else y
    return spark.createDataFrame([(first + i, [float(v) for v in r], int(c), 1.0) for i, (r, c) in enumerate(zip(x, y))], "id long, features array<double>, label int, weight double")


def brute(x, q, types, k, ties=False):
    d = np.zeros((len(q), len(x)))
    for f, kind in enumerate(types):
        u, v = x[q][:, f, None], x[None, :, f]
        d += (np.trunc(u) != np.trunc(v)) if kind else (u - v) * (u - v)
    out = set()
    for i, row in zip(q, d):
        order = np.lexsort((np.arange(len(x)), row))
        kth = row[order[min(k, len(x)) - 1]]
        out |= {(int(i), int(j), float(row[j])) for j in (np.flatnonzero(row <= kth) if ties else order[:k])}
    return out


@pytest.mark.parametrize("most", [3, 1000])
@pytest.mark.parametrize("ties", [False, True])
def test_blocks_are_the_plain_formula(spark, most, ties):
    """Few queries and a grid of blocks; coarse values, so that many distances tie."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(0, 3, (300, 3)).astype(float), rng.random((300, 3))])
    types, rows = (0, 0, 1), frame(spark, x)
    got = top_k(nearest(rows.filter("id % 50 = 0"), rows, Metric(types), 4, ties, most=most), 4, keep_ties=ties)
    assert {(r["query_id"], r["id"], r["distance"]) for r in got.collect()} == brute(x, np.arange(0, 600, 50), types, 4, ties)


def test_cells_meet_in_any_partition(spark, tmp_path):
    """The grid of blocks with partitions as they are dealt, not put together at run time."""
    rng = np.random.default_rng(12)
    x = rng.random((500, 3))
    frame(spark, x).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))  # both sides from one scan
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        found = top_k(nearest(rows.filter("id >= 0"), rows.filter("id < 500"), Metric((0, 0, 0)), 4, most=60), 4)
        got = found.collect()
        assert found.count() == 2000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {(r["query_id"], r["id"], r["distance"]) for r in got} == brute(x, np.arange(500), (0, 0, 0), 4)


def test_missing_values_and_few_rows(spark):
    x = np.array([[0.0, 1.0], [np.nan, 1.0], [2.0, 3.0]])
    got = knn.knn(frame(spark, x[:1]), frame(spark, x), Header.numeric(2), 5).orderBy("place").collect()
    assert [r["id"] for r in got][:2] == [0, 2] and len(got) == 3
    assert knn.knn(frame(spark, x[:1]), frame(spark, x).filter("id < 0"), Header.numeric(2), 5).count() == 0


def test_kd_search_is_exact_in_blocks_of_queries(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.random((400, 2)), np.repeat(rng.random((1, 2)), 100, 0)])  # a leaf of equal rows
    rows, header = frame(spark, x), Header.numeric(2)
    want = {(r["query_id"], r["id"]) for r in knn.knn(rows.filter("id % 50 = 0"), rows, header, 7).collect()}
    for most in (4, 1000):
        got = kdtree.knn_kdtree(rows.filter("id % 50 = 0"), rows, header, 7, leaf=16, most=most)
        assert {(r["query_id"], r["id"]) for r in got.collect()} == want
    log = kdtree.work_log(rows.filter("id % 50 = 0"), rows, header, 7, leaf=16).collect()
    assert len(log) == 10 and all(7 <= r["compared"] < 500 and r["leaves"] >= 1 for r in log)


# ------------------------------------------------------------------ random-projection trees
def test_running_means_and_histograms():
    s, x = rptree.Stats(1), np.random.default_rng(3).normal(size=400)
    for v in x:
        s.add(np.array([v]))
    assert np.isclose(s.mean[0], x.mean()) and np.isclose(s.square[0], (x**2).mean())  # no decay before 65,536 rows
    assert 0.6 < s.small.sum() < 0.76 and 0.24 < s.tail.sum() < 0.4  # shares within one deviation, and beyond
    s = rptree.Stats(1, decay=10)
    for v in x:
        s.add(np.array([v]))
    plain = 0.0
    for i, v in enumerate(x, 1):
        plain += (v - plain) / min(i, 10)
    assert np.isclose(s.mean[0], plain)


def test_first_split_parts_two_groups():
    tree, rng = rptree.RpTree(1, depth=3, vectors=np.array([[1.0]])), np.random.default_rng(4)
    for i in range(99):
        tree.learn(np.array([i % 2 * 10 + rng.random()]))
    assert not tree.split
    tree.learn(np.array([0.5]))
    kind, k, at = tree.split[0]
    assert kind == "median" and k == 0 and 1 < at < 10
    for i in range(120):
        tree.learn(np.array([i % 2 * 10 + rng.random()]))
    assert tree.stats[1].n > 0 and tree.stats[2].n > 0
    rows = np.array([[0.5], [10.5], [0.1]])
    assert tree.leaves(rows)[0] == tree.leaves(rows)[2] != tree.leaves(rows)[1]


def test_heavy_tails_give_a_centre_split():
    """Projection 0 is normal; projection 1 has outliers that grow, far more than a normal one could have. Tried at row 349, and descendants start again."""
    tree, rng = rptree.RpTree(2, depth=4, vectors=np.eye(2)), np.random.default_rng(5)
    for i in range(348):
        tree.learn(np.array([rng.normal(), 10 * (-1.6) ** (i // 14) if i % 14 == 0 else rng.normal()]))
    assert tree.split[0][0] == "median"
    tree.learn(np.zeros(2))
    s, (kind, k, at) = tree.stats[0], tree.split[0]
    assert kind == "centre" and k == 1 and s.n == 349 and at > 0
    assert sum(tree.stats[n].n for n in (1, 2) if n in tree.stats) <= 1
    step = at / s.deviation[1]
    assert any(np.isclose(step, x) for x in (0.25, 0.5, 0.75, 1.0, 2.0, 3.0, 4.0))
    # the likelihood of that step is the best one below 0
    scores = {t: s.likelihood(1, t) for t in range(1, 8)}
    best = max((v, -t) for t, v in scores.items() if v is not None and v < 0)
    assert np.isclose(step, {1: 0.25, 2: 0.5, 3: 0.75, 4: 1.0, 5: 2.0, 6: 3.0, 7: 4.0}[-best[1]])


def test_no_heavy_tail_in_normal_rows():
    s, rng = rptree.Stats(3), np.random.default_rng(6)
    for _ in range(400):
        s.add(rng.normal(size=3))
    assert s.heavy_tail() is None and s.centre_split() is None


def test_leaves_within_reach(spark):
    rng = np.random.default_rng(7)
    x, tree = rng.normal(size=(800, 3)), rptree.RpTree(3, depth=5, projections=4)
    for row in x:
        tree.learn(row)
    leaf, radius = tree.leaves(x), np.full(20, 0.7)
    for i, reach in enumerate(tree.reach(x[:20], radius)):
        near = np.flatnonzero(((x - x[i]) ** 2).sum(1) <= 0.49)
        assert set(leaf[near]) <= set(reach)


# ------------------------------------------------------------------ SGD
def test_large_mini_batches_are_summed_where_they_lie(spark):
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(120, 3)), rng.integers(0, 2, 120)
    rows = frame(spark, x, y).selectExpr("*", "int(id div 30) AS batch", "int(id % 2) AS worker")
    for one_bit in (False, True):
        options = dict(workers=2, rate=0.1, one_bit=one_bit, tau=0.05, stagger=2)
        a, b = (sgd.train(rows, 3, 2, [0, 1, 2, 3], most_bytes=m, **options) for m in (1, 1 << 20))
        assert np.allclose(a, b, atol=1e-9) and np.abs(a).sum() > 0


def test_own_updaters_and_gradients(spark):
    class Kept:
        def __init__(self):
            self.weights, self.seen = np.zeros((2, 2)), []

        def apply(self, gradient, worker):
            self.seen.append(worker)

        def end_of_round(self, turn):
            self.seen.append(-1 - turn)

    rows = frame(spark, np.ones((4, 1)), [0, 1, 0, 1]).selectExpr("*", "int(id div 2) AS batch", "int(id % 2) AS worker")
    kept = Kept()
    sgd.train(rows, 1, 2, [0, 1], workers=2, updater=kept)
    assert kept.seen == [0, 1, -1, 0, 1, -2]


def test_held_weights_fall_back_to_one_bit(spark):
    rng = np.random.default_rng(9)
    rows = frame(spark, rng.normal(size=(60, 2)), rng.integers(0, 2, 60)).selectExpr("*", "int(id div 20) AS batch", "0 AS worker")
    run = lambda u: sgd.train(rows, 2, 2, [0, 1, 2], updater=u)
    start, options = np.zeros((2, 3)), dict(rate=0.1, tau=0.05, stagger=2)
    direct, one_bit = run(sgd.DirectUpdater(start, 0.1)), run(sgd.OneBitUpdater(start, **options))
    assert np.array_equal(run(sgd.FallbackUpdater(start, **options)), direct)
    assert np.array_equal(run(sgd.FallbackUpdater(start, held=lambda w, t: np.ones((2, 3), bool), **options)), one_bit)
    half = np.array([[True, False, True], [False, True, False]])
    assert not np.array_equal(run(sgd.FallbackUpdater(start, held=lambda w, t: half, **options)), direct)


# ------------------------------------------------------------------ options, registries, evaluation
def test_options_and_defaults():
    o = learners.KnnOptions()
    assert (o.nCurves, o.k, o.slidingWindowSize, o.distanceWeighting) == (10, 10, 32768, "none")
    assert learners.RpTreeOptions().windowSize == 65535 and learners.SgdOptions().minibatchSize == 1 and learners.KnnZOrderOptions().nTargetDim == 4
    assert learners.EvaluationOptions().testSize == 1_000_000
    learners.KnnOptions(contextUsed="OPENCL")  # accepted, and ignored
    for wrong in ({"contextUsed": "GPU"}, {"distanceWeighting": "cubic"}):
        with pytest.raises(ValueError):
            learners.KnnOptions(**wrong)


def clusters(spark, n, seed=1):
    return streams.SOURCES["two_clusters"](seed=seed).rows(spark, n)


@pytest.mark.parametrize("name", ["DoubleLinearNN", "FloatLinearNN", "Z-OrderShift", "Z-Order + FJLT", "Double Cosine Similarity search"])
def test_searches_by_name(spark, name):
    learner = learners.Knn(Header.numeric(7, 2), learners.KnnOptions(nearestNeighbourSearch=name, nCurves=2, k=3, slidingWindowSize=60), ready_at=10)
    rows = clusters(spark, 100)
    assert {round(r["p"], 6) for r in learner.votes(rows.limit(2)).collect()} == {0.5}  # not ready
    learner.train(rows.filter("id < 80"))
    assert learner.window.count() == 60 and learner.window.filter("id < 20").count() == 0
    got = learner.votes(rows.filter("id >= 80")).groupBy("query_id").agg({"p": "sum"}).collect()
    assert len(got) == 20 and all(abs(r["sum(p)"] - 1) < 1e-9 for r in got)
    learner.reset()
    assert learner.window is None and {round(r["p"], 6) for r in learner.votes(rows.limit(2)).collect()} == {0.5}


def test_own_search(spark):
    learners.register_search("first rows", lambda q, w, h, k, o: knn.knn(q, w.filter("id < 5"), h, k))
    try:
        learner = learners.Knn(Header.numeric(7, 2), learners.KnnOptions(nearestNeighbourSearch="first rows", k=2), ready_at=1)
        learner.train(clusters(spark, 50))
        assert {r["id"] for r in learner.neighbours(clusters(spark, 50)).collect()} <= set(range(5))
    finally:
        del learners.SEARCHES["first rows"]


@pytest.mark.parametrize("search", ["LinearNN", "KDTree"])
def test_extended_knn_takes_what_the_window_has(spark, search):
    learner = learners.KnnExtended(Header.numeric(7, 2), learners.KnnExtendedOptions(nearestNeighbourSearch=search, k=10))
    assert learner.votes(clusters(spark, 3)).count() == 0
    learner.train(clusters(spark, 6))
    assert {r["n"] for r in learner.votes(clusters(spark, 3)).groupBy("query_id").agg({"votes": "sum"}).withColumnRenamed("sum(votes)", "n").collect()} == {6}
    learner.train(clusters(spark, 12).filter("id >= 6"))
    assert learner.tree is None and learner.votes(clusters(spark, 3)).count() > 0


@pytest.mark.parametrize("learner", [
    lambda h: learners.Knn(h, learners.KnnOptions(k=5), ready_at=1), lambda h: learners.RpTreeLearner(h), lambda h: learners.RpTreeLearner(h, learners.RpTreeOptions(defeatist=True)),
    lambda h: learners.Sgd(h, learners.SgdOptions(minibatchSize=8), rate=0.1), lambda h: learners.Sgd(h, learners.SgdOptions(minibatchSize=4, workerCount=2, updater="OneBitUpdater"), rate=0.1, tau=0.05),
])
def test_periodic_hold_out(spark, tmp_path, learner):
    options = learners.EvaluationOptions(testSize=50, sampleFrequency=150, dumpFile=str(tmp_path / "out"))
    lines = learners.evaluate(learner(Header.numeric(7, 2)), clusters(spark, 500), options)
    assert [x["trained"] for x in lines] == [150, 300] and all(x["n"] == 50 and x["accuracy"] >= 0.9 for x in lines)  # the third test set is short
    got = read_results(spark, str(tmp_path / "out"))
    assert got.count() == 2 and "kappa_temporal" in got.columns


def test_stop_rules(spark):
    make, rows = lambda: learners.Knn(Header.numeric(7, 2), ready_at=1), clusters(spark, 400)
    ends = lambda **o: [x["trained"] for x in learners.evaluate(make(), rows, learners.EvaluationOptions(testSize=20, sampleFrequency=50, **o))]
    assert ends(trainSize=120) == [50, 100, 120]
    assert ends(cacheTest=True, trainSize=100) == [50, 100]
    ticks = iter(range(1000))
    got = learners.evaluate(make(), rows, learners.EvaluationOptions(testSize=20, sampleFrequency=50, trainTime=2), clock=lambda: next(ticks))
    assert [x["trained"] for x in got] == [50, 100] and got[-1]["train_seconds"] == 2


def test_latency_repeats_until_it_is_long_enough():
    now = [0.0]

    def predict():
        now[0] += 0.001

    each, calls = learners.latency(predict, clock=lambda: now[0])
    assert calls == 30 and abs(each - 0.001) < 1e-9
