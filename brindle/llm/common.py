"""What the corpus operators share: scratch tables in the shared folder, and the word and byte conventions."""

from __future__ import annotations

import atexit
import ctypes
import functools
import inspect
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Six ASCII blanks, as a Java, Python and DuckDB character class and as plain characters.
BLANK_CLASS = r"[ \t-\r]"
WORD_CLASS = r"[^ \t-\r]+"
BLANKS = " \t\n\x0b\x0c\r"
#: Spark removes a query's shuffle files when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one for a local master only."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    if base := spark.sparkContext.getCheckpointDir():
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.conf.set("spark.checkpoint.dir", base := "file://" + tempfile.mkdtemp(prefix="brindle-shared-"))
    return base


class Scratch:
    """Tables written in the shared folder, to cut lineage without local state. Removed by keep() and drop(), with the block of
    temporary() that they were made in, or at the latest when the driver ends."""

    made: list[Scratch] | None = None  # those of the block of temporary() that runs

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.names = spark, f"{shared_dir(spark)}/brindle-{uuid.uuid4().hex}", set()
        if Scratch.made is not None:
            Scratch.made.append(self)
        atexit.register(self.drop)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, *by: str, codec: str = "zstd") -> DataFrame:
        """Writes df as Parquet and reads it again. The shuffle files that fed it go when it is written: no later plan uses them."""
        conf, before = self.spark.conf, self.spark.conf.get(CLEANUP, "false")
        conf.set(CLEANUP, "true")
        self.names.add(name)
        try:
            writer = df.write.mode("overwrite").option("compression", codec)
            (writer.partitionBy(*by) if by else writer).parquet(self.path(name))
        finally:
            conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def keep(self, *names: str) -> None:
        """Drops all tables but these, which are those that a result still reads."""
        for name in self.names - set(names):
            self.drop(name)
        self.names &= set(names)

    def drop(self, name: str = "") -> None:
        try:
            jvm = self.spark._jvm
            at = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the session has ended: its shared folder is left to the cluster's own retention
            return


@contextmanager
def temporary() -> Iterator[None]:
    """Drops, at its end, the tables that operators wrote within: for results that have been written meanwhile."""
    before, Scratch.made = Scratch.made, []
    try:
        yield
    finally:
        done, Scratch.made = Scratch.made, before
        for scratch in done:
            scratch.drop()


def give_back() -> None:
    """Returns memory that this process has freed to the system: Arrow's, and the C library's where it can."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function over a task's batches; at its end the worker gives back what it freed, as idle workers stay beside those of the next stage."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def lean_group(run: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """The same function of a group's table, or of two; the worker gives back after each group what it freed."""

    def one(group: pa.Table) -> pa.Table:
        try:
            return run(group)
        finally:
            give_back()

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return run(left, right)
        finally:
            give_back()

    return functools.wraps(run)(two if len(inspect.signature(run).parameters) == 2 else one)


def whole(text: str | Column) -> Column:
    """A text, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
