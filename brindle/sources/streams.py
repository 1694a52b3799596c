"""Instance sources by one protocol: a header, rows, and a restart; sources are registered by name."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import NOMINAL, NUMERIC, Header
from . import arff, generators


class InstanceSource(Protocol):
    """rows(n): the next n rows of the stream (id, features, label, weight; id goes on over calls), or None for all that is left."""

    header: Header

    def rows(self, spark: SparkSession, n: int | None = None) -> DataFrame: ...

    def has_more(self) -> bool: ...

    def restart(self) -> None: ...


def _instances(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("id").cast("long").alias("id"), "features", F.col("label").cast("int").alias("label"), F.lit(1.0).alias("weight"))


class GeneratorSource:
    """An endless generator: rows follow from their place, so a restart gives the same again."""

    def __init__(self, make: Callable[[SparkSession, int], DataFrame], header: Header):
        self.make, self.header, self.at = make, header, 0

    def rows(self, spark: SparkSession, n: int | None = None) -> DataFrame:
        if n is None:
            raise ValueError("a generator has no end: say how many rows")
        begin, self.at = self.at, self.at + n
        return _instances(self.make(spark, self.at).filter(F.col("id") >= begin))

    def has_more(self) -> bool:
        return True

    def restart(self) -> None:
        self.at = 0


class ArffSource:
    """The rows of an ARFF file, over and over; count: rows in all, -1 for no end."""

    def __init__(self, spark: SparkSession, path: str, count: int = -1, class_attribute: str = "digit"):
        self.table, attributes = arff.read_arff(spark, path, class_attribute)
        names = [n for n, _ in attributes]
        label = names.index(class_attribute) if class_attribute in names else len(names) - 1
        types = tuple(NUMERIC if v is None else NOMINAL for i, (_, v) in enumerate(attributes) if i != label)
        self.header, self.count, self.at = Header(types, len(attributes[label][1] or ())), count, 0

    def rows(self, spark: SparkSession, n: int | None = None) -> DataFrame:
        if n is None and self.count < 0:
            raise ValueError("the stream has no end: say how many rows")
        end = min(x for x in (self.count if self.count >= 0 else None, None if n is None else self.at + n) if x is not None)
        begin, self.at = self.at, end
        return _instances(arff.cycle(self.table, max(end, 1)).filter((F.col("seq") >= begin) & (F.col("seq") < end)).withColumn("id", F.col("seq")))

    def has_more(self) -> bool:
        return self.count < 0 or self.at < self.count

    def restart(self) -> None:
        self.at = 0


#: Generators by name.
SOURCES: dict[str, Callable[..., InstanceSource]] = {
    "random_tree": lambda **o: GeneratorSource(lambda spark, n: generators.random_tree(spark, n, **o), Header((NOMINAL,) * o.get("nominals", 5) + (NUMERIC,) * o.get("numerics", 5), o.get("classes", 2))),
    "two_clusters": lambda **o: GeneratorSource(lambda spark, n: generators.two_clusters(spark, n, **o), Header.numeric(o.get("dim", 7), 2)),
    "radial_basis": lambda **o: GeneratorSource(lambda spark, n: generators.radial_basis(spark, n, **o), Header.numeric(o.get("dim", 10), o.get("classes", 2))),
}


def register_source(name: str, make: Callable[..., InstanceSource]) -> None:
    SOURCES[name] = make
