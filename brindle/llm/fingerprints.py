"""Document fingerprints by I-Match over randomised lexicon subsets, in DataFrame functions only.

Lexicon: blank-separated lower-cased terms whose document frequency, as a share of all documents, lies in a band (so in a
band of inverse document frequency). Every term's frequency is counted over all documents, map-side first. At most (mean
distinct terms of a document) / (lower end of the band) terms can reach the band, 150,000 for texts of 300 terms, however
large the corpus or its vocabulary, so the lexicon is broadcast: an array of 64-bit hashes for each hash bucket, in which a
term is looked up; terms are never shuffled with their documents. Six bits of a term's md5 deal it to one of 64 random
subsets of the lexicon. A document's sorted distinct terms of each subset are hashed; the fingerprint is the 64 hashes. A document with few terms in the band is
fingerprinted by all of its terms. The likeness of two fingerprints is the share of equal hashes among the subsets in
which either has a term.

The next document in descending doc_id comes from a window within ranges of doc_id; the first document of the range
after is added to each, so no document is looked up by a join and no task holds more than a range.

Edge cases: null texts count as empty; an empty text has 64 empty hashes and is like another empty one (1) and unlike all
others (0); rows with a null doc_id come last, rows with the same doc_id in the order of their texts; a single row is its
own next; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BLANK_CLASS, Scratch, partitions, table, whole

NAME = "op9_imatch_fingerprints"
SUBSETS, WIDTH, EMPTY = 64, 8, "d41d8cd9"  # EMPTY begins the md5 of nothing


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def terms(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), BLANK_CLASS + "+"), lambda t: t != ""))


def bucket(hash64: Column, bits: int) -> Column:
    return F.shiftrightunsigned(hash64, 64 - bits).cast("int")


def subset(term: Column) -> Column:
    """By the last two digits of the term's md5."""
    return F.conv(F.substring(F.md5(term.cast("binary")), 31, 2), 16, 10).cast("int").bitwiseAND(F.lit(SUBSETS - 1))


def lexicon(docs: DataFrame, text_col: str, lower: float, upper: float) -> tuple[DataFrame, int]:
    """One row: `terms`, an array of 2^bits arrays, the hashes of the band's terms by bucket; and bits."""
    scratch, spark = Scratch(docs.sparkSession), docs.sparkSession
    counts = docs.select(F.explode(terms(whole(docs[text_col]))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    total = docs.agg(F.count(F.lit(1)).alias("n"))
    inside = counts.crossJoin(F.broadcast(total)).filter((F.col("df") >= F.col("n") * lower) & (F.col("df") <= F.col("n") * upper))  # total is one row
    inside = scratch.write(inside.select(F.xxhash64("term").alias("hash")), "inside")
    bits = min(20, max(10, inside.count().bit_length() - 1))  # one or two terms a bucket
    own = inside.groupBy(bucket(F.col("hash"), bits).alias("place")).agg(F.sort_array(F.collect_list("hash")).alias("hashes"))
    every = spark.range(1 << bits).join(own, F.col("id") == F.col("place"), "left").select("id", F.coalesce("hashes", F.expr("cast(array() AS array<bigint>)")).alias("hashes"))
    row = every.groupBy().agg(F.sort_array(F.collect_list(F.struct("id", "hashes"))).alias("all")).select(F.col("all.hashes").alias("terms"))
    row = scratch.write(row, "lexicon")
    scratch.keep("lexicon")
    return row, bits


def fingerprint(text: Column, lexicon_: Column, bits: int, least: int = 8) -> Column:
    known = lambda t: F.array_contains(F.get(lexicon_, bucket(F.xxhash64(t), bits)), F.xxhash64(t))
    chosen = let(terms(text), lambda all_: let(F.filter(all_, known), lambda some: F.when(F.size(some) >= least, some).otherwise(all_)))
    # every subset begins with an empty term; in order they join to one line a subset
    heads = F.transform(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), lambda i: F.struct(i.alias("i"), F.lit("").alias("t")))
    dealt = F.concat(heads, F.transform(chosen, lambda t: F.struct(subset(t).alias("i"), t.alias("t"))))
    lines = F.array_join(F.transform(F.sort_array(dealt), lambda x: F.when(x["t"] == "", F.lit("\n")).otherwise(F.concat(F.lit(" "), x["t"]))), "")
    part = lambda line: F.when(line == "", F.lit(EMPTY)).otherwise(F.substring(F.md5(F.substring(line, F.lit(2), F.length(line)).cast("binary")), 1, WIDTH))
    return F.array_join(F.transform(F.slice(F.split(lines, "\n"), 2, SUBSETS), part), "")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1."""
    cut = lambda x, i: F.substring(x, i * WIDTH + 1, F.lit(WIDTH))
    each = F.sequence(F.lit(0), F.lit(SUBSETS - 1))
    either = F.size(F.filter(each, lambda i: (cut(a, i) != EMPTY) | (cut(b, i) != EMPTY)))
    same = F.size(F.filter(each, lambda i: (cut(a, i) == cut(b, i)) & (cut(a, i) != EMPTY)))
    return F.when(either == 0, F.lit(1.0)).otherwise(same / F.greatest(either, F.lit(1)))


def with_next(rows: DataFrame, key: str, tie: str, *columns: str, ranges: int | None = None) -> DataFrame:
    """Adds next_<column>: that of the row after in descending key (ties by `tie`), of the last that of the first."""
    n = ranges or partitions(rows.sparkSession)
    steps = F.array(*[F.lit((i + 1) / n) for i in range(n - 1)]) if n > 1 else None
    bounds = sorted(set(rows.agg(F.percentile_approx(key, steps, F.lit(10_000))).first()[0] or [])) if n > 1 else []  # n - 1 numbers
    place = F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds]), lambda b: b <= F.col(key))) if bounds else F.lit(0)
    rows = rows.withColumn("range", place).withColumn("extra", F.lit(False))
    heads = {r["range"]: r["head"] for r in rows.groupBy("range").agg(F.max(key).alias("head")).collect()}  # n rows
    full = sorted(heads, reverse=True)
    if not full:
        return rows.select("*", *[F.col(c).alias(f"next_{c}") for c in columns]).drop("range", "extra")
    after = [(full[i], heads[full[(i + 1) % len(full)]]) for i in range(len(full))]
    first = rows.sparkSession.createDataFrame(after, "to int, head long")
    more = rows.join(F.broadcast(first), F.col(key) == F.col("head")).withColumn("range", F.col("to")).withColumn("extra", F.lit(True)).drop("to", "head")  # n rows
    in_order = Window.partitionBy("range").orderBy("extra", F.col(key).desc(), tie)
    out = rows.unionByName(more)
    for c in columns:
        out = out.withColumn(f"next_{c}", F.lead(c).over(in_order))
    return out.filter(~F.col("extra")).drop("range", "extra")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lower: float = 0.002, upper: float = 0.008, ranges: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    lower, upper: the band of document frequency, as shares of all documents."""
    band, bits = lexicon(docs, text_col, lower, upper)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), whole(docs[text_col]).alias("text"))
    rows = rows.withColumn("key", F.coalesce("doc_id", F.lit(-(2**63))))
    rows = rows.crossJoin(F.broadcast(band)).select("doc_id", "text", "key", fingerprint(F.col("text"), F.col("terms"), bits).alias("fingerprint"))
    rows = with_next(rows, "key", "text", "text", "fingerprint", ranges=ranges)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", "next_fingerprint")
    rows = rows.crossJoin(F.broadcast(band)).withColumn("edited_fingerprint", fingerprint(F.col("edited"), F.col("terms"), bits)).drop("terms")
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id DESC NULLS LAST, coalesce(text, '')) AS r, doc_id, coalesce(text, '') AS text FROM documents),
e AS (SELECT r, doc_id, text, coalesce(lead(text) OVER (ORDER BY r), first_value(text) OVER (ORDER BY r)) AS next_text, coalesce(lead(r) OVER (ORDER BY r), 1) AS next_r FROM d),
f AS (SELECT r, doc_id, next_r, text, left(text, (length(text) - length(text) // 2)::BIGINT) || left(next_text, (length(text) // 2)::BIGINT) AS edited FROM e),
both_ AS (SELECT r, 0 AS k, text FROM f UNION ALL SELECT r, 1, edited FROM f),
t AS (SELECT DISTINCT r, k, unnest(regexp_extract_all(lower(text), '[^ \t-\r]+')) AS t FROM both_),
c AS (SELECT r, k, t, ('0x' || substr(md5(t), 31, 2))::BIGINT AS v FROM t),
lex AS (SELECT t FROM c WHERE k = 0 GROUP BY 1 HAVING count(*) >= (SELECT count(*) FROM documents) * 0.002::DOUBLE AND count(*) <= (SELECT count(*) FROM documents) * 0.008::DOUBLE),
m AS (SELECT c.*, lex.t IS NOT NULL AS band FROM c LEFT JOIN lex ON c.t = lex.t),
s AS (SELECT *, count(*) FILTER (band) OVER (PARTITION BY r, k) AS n_band FROM m),
g AS (SELECT r, k, v & 63 AS i, substr(md5(string_agg(t, ' ' ORDER BY t)), 1, 8) AS h FROM s WHERE band OR n_band < 8 GROUP BY ALL),
p AS (SELECT b.r, b.k, string_agg(coalesce(g.h, 'd41d8cd9'), '' ORDER BY q.i) AS fp FROM (SELECT r, k FROM both_) b CROSS JOIN (SELECT unnest(range(64)) AS i) q LEFT JOIN g ON g.r = b.r AND g.k = b.k AND g.i = q.i GROUP BY b.r, b.k),
x AS (SELECT f.*, a.fp AS fp, b.fp AS efp, c.fp AS nfp FROM f JOIN p a ON a.r = f.r AND a.k = 0 JOIN p b ON b.r = f.r AND b.k = 1 JOIN p c ON c.r = f.next_r AND c.k = 0),
l AS (SELECT x.r, j.i, substr(fp, j.i * 8 + 1, 8) AS a, substr(efp, j.i * 8 + 1, 8) AS b, substr(nfp, j.i * 8 + 1, 8) AS c FROM x CROSS JOIN (SELECT unnest(range(64)) AS i) j),
n AS (SELECT r,
  CASE WHEN count(*) FILTER (a <> 'd41d8cd9' OR b <> 'd41d8cd9') = 0 THEN 1.0::DOUBLE ELSE count(*) FILTER (a = b AND a <> 'd41d8cd9')::DOUBLE / count(*) FILTER (a <> 'd41d8cd9' OR b <> 'd41d8cd9') END AS near_edited,
  CASE WHEN count(*) FILTER (a <> 'd41d8cd9' OR c <> 'd41d8cd9') = 0 THEN 1.0::DOUBLE ELSE count(*) FILTER (a = c AND a <> 'd41d8cd9')::DOUBLE / count(*) FILTER (a <> 'd41d8cd9' OR c <> 'd41d8cd9') END AS near_next FROM l GROUP BY r)
SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256, fp AS fingerprint, efp AS edited_fingerprint, near_edited, near_next FROM x JOIN n USING (r)
"""
