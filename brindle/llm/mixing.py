"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

Each source's target is its weight's share of the mix, held at a multiple of its size; what is above is shared again by
weight among the rest (water-filling: sources in the order of cap / weight are capped while the level reaches them). The
whole multiples of a source's size in its target are certain copies of every document. What is left, R words, is a sample
of unequal probabilities, in proportion to size: a document of s words is in it with probability p = min(1, c s), where c
makes the expected words sum p s of the source equal to R. c follows from counts by (source, size): sizes are capped from
the largest down while c s is above 1. Documents are ranked by random odds u / (1 - u) divided by inclusion odds p / (1 - p)
(Pareto order sampling; p = 1 comes first), and the lowest ranks are taken until the source's words are reached; the last
one is taken if that brings the sum nearer.

u comes from the md5 of the seed and the doc_id, so reruns agree on any partitioning. The ranks are never sorted as a whole:
per source a histogram of rank intervals, whose number grows with the root of the table's, finds the one where the target
falls, and only its documents are sorted.

Edge cases: null texts have size 0; a null source is a source of its own, last; rows with a null doc_id draw by their
text; repeated rows draw alike; an empty table gives an empty mix; a source without words has target 0; other columns
are ignored or carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_CLASS, Scratch, table, whole

NAME = "op7_mix_sources"


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD_CLASS)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """sizes: source, source_size. Adds target, copies (certain whole copies) and rest (words to be sampled)."""
    by_name, by_fill = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("fill", "place")
    place = F.row_number().over(by_name)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    full = F.col("source_size") * F.lit(float(cap))
    earlier = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    later = by_fill.rowsBetween(0, Window.unboundedFollowing)
    out = sizes.withColumn("place", place).withColumn("w", w).withColumn("fill", full / F.col("w"))
    out = out.withColumn("total", F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share)))
    out = out.withColumn("level", (F.col("total") - F.coalesce(F.sum(full).over(earlier), F.lit(0.0))) / F.sum("w").over(later))
    out = out.withColumn("capped", F.col("fill") <= F.col("level"))
    out = out.withColumn("line", F.max(F.when(~F.col("capped"), F.col("level"))).over(Window.partitionBy()))
    out = out.withColumn("target", F.when(F.col("capped"), full).otherwise(F.col("w") * F.col("line")))
    words = F.col("source_size")
    copies = F.when(words > 0, F.floor(F.col("target") / F.greatest(words, F.lit(1)))).otherwise(F.lit(0)).cast("long")
    return out.select("source", "source_size", "target", copies.alias("copies")).withColumn("rest", F.col("target") - F.col("copies") * words)


def size_factors(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """of, factor: of each source with a rest, the c that makes sum min(1, c size) size its rest. Windows are over counts by size."""
    by_size = sized.filter("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    up_to = Window.partitionBy("of").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    each = by_size.join(goals.filter("rest > 0"), by_size["source"].eqNullSafe(goals["of"]))
    each = each.withColumn("squares", F.sum(F.col("size").cast("double") * F.col("size") * F.col("n")).over(up_to))
    each = each.withColumn("free", F.col("rest") - (F.col("source_size") - F.sum(F.col("size") * F.col("n")).over(up_to)))
    open_ = each.filter(F.col("free") * F.col("size") <= F.col("squares"))  # sizes whose own probability is at most 1 where all larger ones are taken
    return open_.groupBy("of").agg(F.max_by(F.col("free") / F.col("squares"), "size").alias("factor"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, bins: int = 4096, carry: bool = False, **targets) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken (size times the copies the mix takes); with carry also `row`.

    bins: rank intervals at the fewest."""
    scratch = Scratch(docs.sparkSession)
    text = whole(docs[text_col])
    name = F.coalesce(docs[id_col].cast("string"), F.concat(F.lit("text:"), text))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, 13), 16, 10).cast("long")
    sized = scratch.write(
        docs.select(
            docs[id_col].alias("doc_id"), docs[source_col].alias("source"), n_words(text).alias("size"), ((draw + 0.5) / float(2**52)).alias("u"),
            *([F.struct(*docs.columns).alias("row")] if carry else []),
        ), "sized",
    )
    bins = max(bins, 1 << (sized.count().bit_length() + 1) // 2)
    goals = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), **targets)
    goals = scratch.write(goals, "goals").withColumnRenamed("source", "of")
    factors = size_factors(sized, goals).withColumnRenamed("of", "source")
    goals = scratch.write(goals.join(factors, goals["of"].eqNullSafe(factors["source"]), "left").drop("source"), "factors")
    ranked = sized.join(goals, sized["source"].eqNullSafe(goals["of"])).drop("of")
    p = F.least(F.lit(1.0), F.col("factor") * F.col("size"))
    odds = F.col("u") / (1 - F.col("u")) / (F.col("p") / (1 - F.col("p")))
    rank = F.when((F.col("rest") <= 0) | (F.col("p") >= 1), F.lit(0.0)).when(F.col("p") > 0, odds / (1 + odds)).otherwise(F.lit(1.0))
    ranked = ranked.withColumn("p", F.coalesce(p, F.lit(0.0))).withColumn("rank", rank).withColumn("bin", F.floor(F.col("rank") * bins).cast("long")).drop("p", "factor")

    per_bin = ranked.filter("rest > 0").groupBy("source", "bin", "rest").agg(F.sum("size").alias("words"))
    up_to = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    per_bin = per_bin.withColumn("after", F.sum("words").over(up_to)).filter("after > rest and after - words <= rest")
    edge = per_bin.select(F.col("source").alias("at"), F.col("bin").alias("edge"), (F.col("after") - F.col("words")).alias("before"))
    ranked = ranked.join(edge, ranked["source"].eqNullSafe(edge["at"]), "left").drop("at")

    inside = (F.col("rest") > 0) & F.col("edge").isNotNull() & (F.col("bin") == F.col("edge"))
    lower = F.coalesce((F.col("rest") > 0) & (F.col("bin") < F.coalesce("edge", F.lit(bins + 1))), F.lit(False))
    in_order = Window.partitionBy("source").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    last = ranked.filter(inside).withColumn("so_far", F.col("before") + F.sum("size").over(in_order))
    last = last.withColumn("more", (F.col("so_far") - F.col("size") / 2.0 <= F.col("rest")).cast("long")).drop("so_far")
    rows = ranked.filter(~F.coalesce(inside, F.lit(False))).withColumn("more", lower.cast("long")).unionByName(last)
    taken = F.col("size") * (F.col("copies") + F.col("more"))
    return rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"), *(["row", (F.col("copies") + F.col("more")).alias("times")] if carry else []))


def take_mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of docs, each as often as the mix takes it."""
    mixed = mix(docs, carry=True, **options).filter("times > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+'))::BIGINT AS size,
  (('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, 'text:' || coalesce(text, ''))), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM documents),
src AS (SELECT source, sum(size)::DOUBLE AS s, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM sized GROUP BY source),
filled AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(place - 1) % 3 + 1] AS w, s * 2.0::DOUBLE / [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(place - 1) % 3 + 1] AS fill FROM src),
lev AS (SELECT *, (sum(s) OVER () * 1.5::DOUBLE - coalesce(sum(s * 2.0::DOUBLE) OVER (ORDER BY fill, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY fill, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM filled),
goal AS (SELECT *, CASE WHEN fill <= level THEN s * 2.0::DOUBLE ELSE w * max(CASE WHEN fill > level THEN level END) OVER () END AS target FROM lev),
certain AS (SELECT *, CASE WHEN s > 0 THEN floor(target / greatest(s, 1)) ELSE 0 END AS copies FROM goal),
part AS (SELECT *, target - copies * s AS rest FROM certain),
sizes AS (SELECT p.source, d.size, count(*) AS n, any_value(p.s) AS s, any_value(p.rest) AS rest FROM sized d JOIN part p ON d.source IS NOT DISTINCT FROM p.source WHERE d.size > 0 AND p.rest > 0 GROUP BY p.source, d.size),
run AS (SELECT *, sum(size::DOUBLE * size * n) OVER w AS squares, rest - (s - sum(size * n) OVER w) AS free FROM sizes WINDOW w AS (PARTITION BY source ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
factor AS (SELECT source, arg_max(free / squares, size) AS c FROM run WHERE free * size <= squares GROUP BY source),
odds AS (SELECT d.doc_id, d.size, d.u, p.source, p.s, p.target, p.copies, p.rest, coalesce(least(1.0::DOUBLE, f.c * d.size), 0) AS p
  FROM sized d JOIN part p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN factor f ON f.source IS NOT DISTINCT FROM p.source),
ranked AS (SELECT *, CASE WHEN rest <= 0 OR p >= 1 THEN 0 WHEN p > 0 THEN u / (1 - u) / (p / (1 - p)) / (1 + u / (1 - u) / (p / (1 - p))) ELSE 1 END AS rank FROM odds),
summed AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS so_far FROM ranked)
SELECT doc_id, size, s::BIGINT AS source_size, target,
  (size * (copies + CASE WHEN rest > 0 AND so_far - size / 2.0 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM summed
"""
