"""Joins of documents, mentions and relations."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mention_rows(abstracts: DataFrame, mentions: DataFrame, key: str = "PMID", title: str = "Title", body: str = "Abstract", kind: str = "Type", merge_types: Mapping[str, str] | None = None, out: str = "Text") -> DataFrame:
    """Documents with each of their mentions (inner join); title and body become
    one text, kinds are merged by a mapping, rows with any null are dropped."""
    rows = abstracts.join(mentions, key)
    rows = rows.withColumn(out, F.concat(F.col(title), F.lit(" "), F.col(body))).drop(title, body).na.drop("any")
    return rows.replace(dict(merge_types), subset=[kind]) if merge_types else rows


def first_mentions(mentions: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One mention for each key, the first in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return mentions.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def relation_rows(relations: DataFrame, texts: DataFrame, mentions: DataFrame, key: str = "PMID", strict: bool = False) -> DataFrame:
    """Each relation with its text and both mentions.

    Mentions are looked up by (document, argument), the first of several; a
    relation that names an absent one is dropped, or an error when strict."""
    ends = {}
    for end in ("Subject", "Object"):
        one = first_mentions(mentions, [key, "Arg"], [F.col("Start_offset"), F.col("End_offset")])
        ends[end] = one.select(F.col(key).alias(f"_{end}_key"), F.col("Arg").alias(f"{end}_Arg"), F.col("Type").alias(f"{end}_Type"), F.col("Start_offset").alias(f"{end}_Start"), F.col("End_offset").alias(f"{end}_End"), F.col("String").alias(f"_{end}_text"))
    rows = relations.join(texts, key)
    for end, m in ends.items():
        arg = F.split_part(F.col(end), F.lit(":"), F.lit(2))
        same = (F.col(key) == F.col(f"_{end}_key")) & (arg == F.col(f"{end}_Arg"))
        rows = rows.join(m, same, "left" if strict else "inner").drop(f"_{end}_key")
        if strict:
            there = F.assert_true(F.col(f"{end}_Arg").isNotNull(), F.concat(F.lit(f"no mention for {end} "), F.col(end)))
            rows = rows.where(there.isNull())
        rows = rows.withColumn(end, F.col(f"_{end}_text")).drop(f"_{end}_text")
    columns = [key, "Text", *(f"{e}{s}" for e in ("Subject", "Object") for s in ("", "_Arg", "_Type", "_Start", "_End"))]
    return rows.select(*columns, F.col("Predicate").alias("Relation"))


def shared_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys in both splits; none means no leak."""
    return a.select(key).intersect(b.select(key))


def with_default(df: DataFrame, table: DataFrame, key: str, value: str, default: object, pos: str | None = None) -> DataFrame:
    """A looked-up value, or a default for keys that the table lacks or that are
    null.  A key that the table repeats has one value: the one written last by
    ``pos``, or the greatest where no order is given."""
    last = F.max(value) if pos is None else F.max_by(value, pos)
    once = table.groupBy(key).agg(last.alias(value))
    return df.join(once, key, "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))
