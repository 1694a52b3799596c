"""From raw documents to packed training sequences: five stages, each applied to all that the one before kept.

STAGES are functions (spark, docs, sf_dir) -> DataFrame; run() applies them to the documents of sf_dir, each result
written as Parquet in the shared folder and read again as the next one's docs; what a stage wrote on its way is removed then.

Edge cases: a null text counts as empty, is scored by the classifier, copies other empty texts, is near to nothing, weighs no word
and so is in no mix; rows with a null doc_id pass as any other, the exact copies among them included; a null source is a
source of its own; without labels of both kinds nothing is rejected; an empty table, or one of empty texts, gives an empty
result; other columns, whatever their names, are carried up to the packing, whose columns are its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brindle.llm.common import Scratch, table, temporary
from brindle.llm.exact_dedup import drop_exact_copies
from brindle.llm.mixing import take_mix
from brindle.llm.near_dedup import keep_one
from brindle.llm.packing import pack
from brindle.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from labels of documents that are still there."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose texts are equal up to blanks."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more."""
    return keep_one(docs, width=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources; a document taken twice is there twice."""
    return take_mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces and their places in sequences of at most 4096 tokens."""
    return pack(docs)


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with temporary():
            docs = scratch.write(stage(spark, docs, sf_dir), name)
        scratch.keep(name)
    return docs


ORACLE_SQL = None  # a trained classifier and a tokenizer are not SQL: tests hold each stage against brute force
