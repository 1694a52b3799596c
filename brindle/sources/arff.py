"""ARFF files: reading, cycling, exporting."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_ATTRIBUTE = re.compile(r"@attribute\s+('[^']*'|\"[^\"]*\"|\S+)\s+(.*)", re.I)


#: A cell of a data line: quoted, or up to the next comma.
_CELL = r"""\s*('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|[^,]*?)\s*(?:,|$)"""
#: A cell of a sparse line: its place, a blank, and the same.
_PAIR = _CELL.replace(r"\s*(", r"\s*([0-9]+\s+(?:", 1).replace(r"[^,]*?)", r"[^,]*?))", 1)


def _values(kind: str) -> list[str] | None:
    """Values of a nominal attribute; None for a numeric one."""
    kind = kind.strip()
    if not kind.startswith("{"):
        return None
    found = [m.group(1) for m in re.finditer(_CELL, kind[1 : kind.rindex("}")])]
    return [_plain(v) for v in (found[:-1] if found and not found[-1] else found)]


def _plain(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text[1:-1]) if len(text) > 1 and text[0] in "'\"" and text[-1] == text[0] else text


def read_arff(spark: SparkSession, path: str, class_attribute: str = "digit") -> tuple[DataFrame, list[tuple[str, list[str] | None]]]:
    """Rows (id in the order of the file or of the parts of a folder, features, label) and the header: (name, nominal values or None).

    "?" is missing (NaN); a nominal value is its index. Cells may be quoted, and then hold commas and blanks; sparse lines
    are "{place value, ...}", with 0 elsewhere. The header comes from the leading lines; data lines are read as text by all tasks."""
    lines = spark.read.text(path)
    head = lines.filter(F.lower(F.trim("value")).startswith("@attribute")).collect()  # one line an attribute
    attributes = []
    for (line,) in head:
        name, kind = _ATTRIBUTE.match(line.strip()).groups()
        attributes.append((_plain(name), _values(kind)))
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    data = lines.select("value", place.alias("place")).filter(~F.trim("value").rlike(r"^(@|%|$)"))
    # a line's number: its place in its split, after the splits before
    splits = data.groupBy("place.file", "place.block").agg(F.min("place.at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    splits = splits.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).select(F.col("file").alias("f"), F.col("block").alias("b"), "before")
    data = data.join(splits, (F.col("place.file") == F.col("f")) & (F.col("place.block") == F.col("b"))).select("value", (F.col("place.at") + F.col("before")).alias("at"))
    line = F.trim("value")
    sparse = F.startswith(line, F.lit("{"))
    body = F.when(sparse, F.regexp_replace(line, r"^\{\s*|\s*\}$", "")).otherwise(line)
    cells = F.when(sparse, F.regexp_extract_all(body, F.lit(_PAIR), F.lit(1))).otherwise(F.regexp_extract_all(body, F.lit(_CELL), F.lit(1)))
    data = data.select("at", sparse.alias("sparse"), cells.alias("cells"))
    # in a sparse line a cell is its place, a blank and its value
    held = F.map_from_entries(F.transform("cells", lambda c: F.struct(F.regexp_extract(c, r"^[0-9]+", 0).cast("int"), F.trim(F.regexp_replace(c, r"^[0-9]+\s+", "")))))
    data = data.withColumn("held", F.when(F.col("sparse"), held))

    def cell(i: int, values: list[str] | None):
        raw = F.when(F.col("sparse"), F.try_element_at("held", F.lit(i))).otherwise(F.get("cells", F.lit(i)))
        quoted = raw.rlike(r"""^('.*'|".*")$""")
        text = F.when(quoted, F.regexp_replace(F.substring(raw, F.lit(2), F.length(raw) - 2), r"\\(.)", "$1")).otherwise(raw)
        number = text.try_cast("double")
        known = number if values is None else F.when(F.array_position(F.array(*map(F.lit, values)), text) > 0, (F.array_position(F.array(*map(F.lit, values)), text) - 1).cast("double"))
        return F.when(F.col("sparse") & raw.isNull(), F.lit(0.0)).when(raw == "?", F.lit(float("nan"))).otherwise(known)

    names = [n for n, _ in attributes]
    label = names.index(class_attribute) if class_attribute in names else len(names) - 1
    features = F.array(*[cell(i, v) for i, (_, v) in enumerate(attributes) if i != label])
    return data.select(F.col("at").alias("id"), features.alias("features"), cell(label, attributes[label][1]).alias("label")), attributes


def cycle(rows: DataFrame, count: int, order: str = "id") -> DataFrame:
    """The first `count` rows of the stream that repeats rows in order: adds seq. Each row is repeated by its own share, without a join."""
    from ..operators.windows import with_sequence

    placed = with_sequence(rows, order, out="place")
    total = placed.agg(F.count(F.lit(1)).alias("total"))
    turns = F.floor((F.lit(count - 1) - F.col("place")) / F.col("total"))
    once = placed.crossJoin(F.broadcast(total)).filter(F.col("place") < count)
    return once.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), turns))).withColumn("seq", F.col("place") + F.col("turn") * F.col("total")).drop("place", "turn", "total")


def _quoted(text: str) -> str:
    return "'" + re.sub(r"([\\'])", r"\\\1", text) + "'" if re.search(r"[\s,{}%'\"]", text) or not text else text


def write_arff(rows: DataFrame, path: str, relation: str, header: list[tuple[str, list[str] | None]]) -> None:
    """A folder of text parts: the header is the first, data lines follow in the order of id, so the parts one after the other are one file.

    header: features first, the class last; nominal features and classes are indices into their values, missing ones "?"."""
    spark = rows.sparkSession
    top = [f"@relation {_quoted(relation)}", ""] + [f"@attribute {_quoted(n)} {'numeric' if v is None else '{' + ','.join(map(_quoted, v)) + '}'}" for n, v in header] + ["", "@data"]
    lines = spark.createDataFrame([(i, t) for i, t in enumerate(top)], "at long, value string").coalesce(1).sortWithinPartitions("at").select("value")

    def cell(x, values: list[str] | None):
        text = x.cast("string") if values is None else F.get(F.array(*[F.lit(_quoted(v)) for v in values]), x.cast("int"))
        return F.when(x.isNull() | F.isnan(x.cast("double")), F.lit("?")).otherwise(text)

    cells = [cell(F.get("features", F.lit(i)), v) for i, (_, v) in enumerate(header[:-1])] + [cell(F.col("label"), header[-1][1])]
    lines.unionAll(rows.orderBy("id").select(F.concat_ws(",", *cells).alias("value"))).write.mode("overwrite").text(path)
