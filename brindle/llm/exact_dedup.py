"""Exact dedup by distributed MSD radix partitioning.

A document is the byte string of its text without ASCII blanks, led by its byte length as the first digit. Each round
splits every open group by its next bytes alone: the key is the group's number and the bytes at the round's depth, eight
times as many as in the rounds before together. What was read is cut off, so no byte is shuffled by a later round, and a
group is done when it is a singleton or its bytes have ended. Equality therefore comes from the bytes themselves; no
digest is compared. Only rows of open groups go on, so the rounds shrink to the true copies, and their number is the
logarithm of the longest text.

A group's count and its best row are summed map-side first, so a group that holds a third of all rows is one row per
task in that exchange; only groups of more than one row are written, with numbers that no retry changes, and the join that
hands them back has one row per group on its small side and is split by adaptive skew handling on the other.

Edge cases: null texts count as empty, and all empty texts are one group; a null doc_id counts as the largest; of rows
equal in text length and doc_id exactly one is kept; an empty table gives an empty result; other columns are ignored,
or carried unchanged under their own names inside one struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, Scratch, table, whole

NAME = "op3_exact_dedup"


def normalised(text: Column) -> Column:
    """The bytes of a text without blanks."""
    for blank in BLANKS:
        text = F.replace(text, F.lit(blank), F.lit(""))
    return F.encode(text, "UTF-8")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False, first: int = 64, growth: int = 8) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, and text_sha256, or with carry `row`, the whole input row.

    first: bytes compared in the first round; growth: how much further each next round looks."""
    scratch = Scratch(docs.sparkSession)
    text = whole(docs[text_col])
    more = F.struct(*docs.columns).alias("row") if carry else F.sha2(normalised(text), 256).alias("text_sha256")
    own = "row" if carry else "text_sha256"
    rows = docs.select(docs[id_col].alias("doc_id"), F.length(text).alias("n_cp"), *([more] if carry else [normalised(text).alias("data"), more]))
    # with carry the bytes are those of the row's own text, so they are exchanged once
    data = normalised(whole(F.col("row")[text_col])) if carry else F.col("data")
    rows = rows.withColumn("group", F.octet_length(data).cast("long"))  # the first digit
    done, depth, step, level = [], 0, first, 0
    while True:
        # without carry `data` has lost what was read; with it, the text of the row is read from there
        digits = F.substring(data, depth + 1 if carry else 1, step)
        split = rows.groupBy(F.col("group").alias("g"), digits.alias("digits")).agg(
            F.count(F.lit(1)).alias("size"),
            F.min(F.struct((-F.col("n_cp")).alias("shortness"), F.col("doc_id").isNull().alias("unnamed"), "doc_id")).alias("best"),
        )
        split = scratch.write(split.filter("size > 1").withColumn("number", F.monotonically_increasing_id()), f"groups{level}")
        split = split.hint("merge")  # the groups grow with the table, so they are not broadcast where they happen to be few
        out = rows.join(split, (rows["group"] == split["g"]) & (digits == split["digits"]), "left")
        length = F.octet_length(data)
        open_ = F.col("number").isNotNull() & (length > (depth + step if carry else step))
        rest = [] if carry else [F.when(F.col("open"), F.substring("data", step + 1, length)).alias("data")]
        out = out.withColumn("open", open_).select(
            "doc_id", "n_cp", *rest, own, F.col("number").alias("group"), "open",
            F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
            (F.col("size").isNotNull() & F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("best.shortness") == -F.col("n_cp"))).alias("wins"), F.coalesce("size", F.lit(1)).alias("group_size"),
        )
        out = scratch.write(out, f"level{level}", "open")
        done.append(out.filter(~F.col("open")).select("doc_id", "keep_id", "group_size", "wins", own, "group", F.lit(level).alias("level")))
        rows = out.filter("open").select("doc_id", "n_cp", *([] if carry else ["data"]), own, "group")
        if rows.isEmpty():
            break
        depth, step, level = depth + step, (depth + step) * (growth - 1), level + 1
    found = done[0]
    for next_ in done[1:]:
        found = found.unionByName(next_)
    # of rows that repeat a group's best one, one is kept: places in the written tables tell them apart
    found = found.withColumn("at", F.monotonically_increasing_id())
    best = found.filter("wins")
    first = best.groupBy(F.col("level").alias("l"), F.col("group").alias("g")).agg(F.min("at").alias("first"))
    best = best.join(first, (F.col("level") == F.col("l")) & (F.col("group") == F.col("g"))).withColumn("kept", F.col("at") == F.col("first"))
    found = found.filter("NOT wins").withColumn("kept", F.col("group_size") == 1).unionByName(best.drop("l", "g", "first"))
    return found.select("doc_id", "keep_id", "group_size", "kept", own)


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with the columns of docs."""
    kept = exact_groups(docs, id_col, text_col, carry=True).filter("kept")
    return kept.select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n_cp, regexp_replace(coalesce(text, ''), '[ \t-\r]', '', 'g') AS norm FROM documents),
g AS (SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
  first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place
  FROM d WINDOW w AS (PARTITION BY norm ORDER BY n_cp DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM g
"""
