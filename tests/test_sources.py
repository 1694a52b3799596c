import numpy as np

from brindle.sources import arff, generators, sinks, streams

ARFF = """% comment
@relation t
@attribute a numeric
@attribute b {x,y}
@attribute digit {0,1}

@data
1.5,x,0
?,y,1
-2,x,1
"""


def test_arff_round(spark, tmp_path):
    (tmp_path / "a.arff").write_text(ARFF)
    df, header = arff.read_arff(spark, str(tmp_path / "a.arff"))
    got = df.orderBy("id").collect()
    assert [n for n, _ in header] == ["a", "b", "digit"]
    assert got[0]["features"] == [1.5, 0.0] and np.isnan(got[1]["features"][0]) and [r["label"] for r in got] == [0.0, 1.0, 1.0]
    turned = arff.cycle(df, 7).orderBy("seq").collect()
    assert [r["label"] for r in turned] == [0, 1, 1, 0, 1, 1, 0]
    arff.write_arff(df.filter("label IS NOT NULL"), str(tmp_path / "out"), "t", header)
    again, _ = arff.read_arff(spark, str(tmp_path / "out"))
    assert [r["label"] for r in again.orderBy("id").collect()] == [0.0, 1.0, 1.0]


def test_generators_repeat(spark):
    a, b = (sorted(map(tuple, (x["features"] for x in generators.random_tree(spark, 50).collect()))) for _ in range(2))
    assert a == b
    assert generators.two_clusters(spark, 100).filter("label NOT IN (0, 1)").count() == 0
    assert generators.radial_basis(spark, 50).count() == 50
    m = generators.mappings(10, 7, 1024)
    assert len(set(m.ravel())) == 70


def test_results_append(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5)], "checkpoint int, accuracy double")
    sinks.append_results(df, str(tmp_path / "r"))
    sinks.append_results(df, str(tmp_path / "r"))
    assert sinks.read_results(spark, str(tmp_path / "r")).count() == 2
    sinks.save_model(df, str(tmp_path / "m"), 3)
    assert sinks.load_model(spark, str(tmp_path / "m"), 3).count() == 1


def test_sparse_and_quoted_lines(spark, tmp_path):
    (tmp_path / "b.arff").write_text("@relation 'a b'\n@attribute 'first one' numeric\n@attribute kind {plain,'a, b','it\\'s'}\n@attribute z numeric\n@attribute digit {no,yes}\n@data\n1, 'a, b' ,3,yes\n{0 2.5, 3 yes}\n{ }\n2,'it\\'s',?,no\n{1 'a, b'}\n")
    df, header = arff.read_arff(spark, str(tmp_path / "b.arff"))
    got = df.orderBy("id").collect()
    assert header[0][0] == "first one" and header[1][1] == ["plain", "a, b", "it's"]
    assert [r["label"] for r in got] == [1, 1, 0, 0, 0]
    assert [r["features"][:2] for r in got] == [[1, 1], [2.5, 0], [0, 0], [2, 2], [0, 1]] and got[0]["features"][2] == 3 and np.isnan(got[3]["features"][2])


def test_parts_are_read_in_order(spark, tmp_path):
    rows = spark.range(0, 3000, numPartitions=5).selectExpr("id", "array(double(id), double(id % 2)) AS features", "double(id % 2) AS label")
    header = [("a", None), ("b c", ["x, y", "z"]), ("digit", ["0", "1"])]
    arff.write_arff(rows, str(tmp_path / "out"), "t", header)
    again, names = arff.read_arff(spark, str(tmp_path / "out"))
    assert names == header
    assert [r["features"][0] for r in again.orderBy("id").collect()] == list(range(3000))
    assert again.agg({"id": "max"}).first()[0] == 2999


def test_instance_sources(spark, tmp_path):
    source = streams.SOURCES["random_tree"]()
    a, b = source.rows(spark, 10), source.rows(spark, 10)
    assert source.has_more() and source.header.dim == 10
    assert [r["id"] for r in a.orderBy("id").collect()] == list(range(10)) and [r["id"] for r in b.orderBy("id").collect()] == list(range(10, 20))
    source.restart()
    assert sorted(map(str, source.rows(spark, 10).collect())) == sorted(map(str, a.collect()))
    (tmp_path / "a.arff").write_text(ARFF)
    source = streams.ArffSource(spark, str(tmp_path / "a.arff"), count=5)
    assert [r["label"] for r in source.rows(spark, 4).orderBy("id").collect()] == [0, 1, 1, 0] and source.has_more()
    assert [r["id"] for r in source.rows(spark).collect()] == [4] and not source.has_more()
    assert source.header.types == (0, 1) and source.header.n_classes == 2
