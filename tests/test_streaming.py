from brindle.schema import Header
from brindle.sources.sinks import read_results
from brindle.streaming.online import OnlineSgd, evaluate_stream


def source(spark, tmp_path):
    for part in range(3):
        rows = [(part * 40 + i, part * 40 + i, [float(i % 2), float(i % 2) + i / 400], i % 2, 1.0) for i in range(40)]
        spark.createDataFrame(rows, "id long, seq long, features array<double>, label int, weight double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema("id long, seq long, features array<double>, label int, weight double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_online_sgd_and_evaluation(spark, tmp_path):
    stream, model = source(spark, tmp_path), OnlineSgd(2, 2, rate=0.1)
    stream.writeStream.foreachBatch(model).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start().awaitTermination()
    assert model.steps == 3 and abs(model.weights).sum() > 0
    run = evaluate_stream(stream, str(tmp_path / "out"), str(tmp_path / "c2"), 100, 1000, Header.numeric(2, 2), k=3).trigger(availableNow=True).start()
    run.awaitTermination()
    got = read_results(spark, str(tmp_path / "out")).collect()
    assert len(got) == 2 and all(r["accuracy"] == 1.0 for r in got)


def test_large_micro_batches_lose_no_row(spark, tmp_path):
    """Batches of 40 rows, ten at a time: 12 steps, of which the first has no window."""
    run = evaluate_stream(source(spark, tmp_path), str(tmp_path / "out"), str(tmp_path / "c"), 10, 1000, Header.numeric(2, 2), k=3).trigger(availableNow=True).start()
    run.awaitTermination()
    got = read_results(spark, str(tmp_path / "out")).orderBy("checkpoint").collect()
    assert [r["checkpoint"] for r in got] == list(range(1, 12)) and sum(r["n"] for r in got) == 110
