"""The corpus pipeline: quality, exact and near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and
read again as the next one's docs.  All but the last give the columns of
``documents``.

Defined results of every stage: rows with null ids or sources, null, empty and
very long texts, repeated rows and ids take part as any other; extra columns
are kept whatever their names; an empty table gives an empty one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexloom.llm import exact_dedup, minhash, mixing, packing, quality_rank
from lexloom.llm.common import stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranker accepts, judged by their whole text
    alone; null text counts as empty.  Without labels of both kinds all stay."""
    return quality_rank.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of equal texts, white space aside: the longest original,
    then the least id, null ids last.  Null, empty and blank texts are one
    group; rows alike in id and text stay or go together."""
    return exact_dedup.keep_one_of_each(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least id of each group of near duplicates.  Rows with a null id and
    texts without words are linked with nothing and stay."""
    return minhash.keep_one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the sources' schedule; null is a source of
    its own."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences, which follow the order of the schedule
    by groups.  Null and empty texts give a piece of the end id alone, long ones
    as many as they fill.  Workers keep to less memory than when packing is all
    that executors do."""
    return packing.pack(docs, memo_chunks=200_000, slice_bytes=4_000_000, in_order=True, batch_rows=1_000)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mix", mix), ("pack", pack)]

#: Learned scores, MinHash and tokens are beyond SQL; tests hold run() against
#: a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = step(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stage(docs, name)
    return docs
