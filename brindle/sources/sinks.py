"""Result sinks: one header, one line a checkpoint; model tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_HEADER = "_header"


def _at(spark: SparkSession, path: str):
    """A path and its file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def append_results(results: DataFrame, path: str, sep: str = "\t") -> None:
    """Appends checkpoint rows to a folder of delimited files. The header is written once, by the first call, into a file of its own."""
    spark = results.sparkSession
    head, files = _at(spark, f"{path}/{_HEADER}")
    if not files.exists(head):
        out = files.create(head, True)
        out.write(bytearray((sep.join(results.columns) + "\n").encode()))
        out.close()
    results.write.mode("append").option("sep", sep).csv(path)


def read_results(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    head, files = _at(spark, f"{path}/{_HEADER}")
    names = _first_line(files, head, spark).split(sep)
    return spark.read.option("sep", sep).option("inferSchema", True).csv(path).toDF(*names)


def _first_line(files, head, spark: SparkSession) -> str:
    reader = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(files.open(head), "UTF-8"))
    try:
        return reader.readLine()
    finally:
        reader.close()


def save_model(weights: DataFrame, path: str, version: int) -> None:
    """A model table in a versioned folder, in place of shared memory."""
    weights.write.mode("overwrite").parquet(f"{path}/version={version}")


def load_model(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{path}/version={version}")
