"""Folds, splits, samples and batches, all fixed by a seed and a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import md5_bucket, number_groups, number_rows, seeded, sum_before


def signatures(rows: DataFrame, key: str, kind: str) -> DataFrame:
    """Per document the multiset of its rows' kinds, as sorted (kind, count)."""
    counts = rows.groupBy(key, kind).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(kind, "n"))).alias("signature"))


def signature_classes(signed: DataFrame, key: str, min_class_size: int = 5) -> DataFrame:
    """Each document's class: the rank of its signature by frequency, from 0 on,
    ties by the least key that has it; rare signatures share -1, and keep their
    place in the count."""
    sizes = signed.groupBy("signature").agg(F.count(F.lit(1)).alias("size"), F.min(key).alias("first_seen"))
    # One row for each distinct signature.
    ranked = number_rows(sizes, [-F.col("size"), F.col("first_seen")], "rank")
    classes = ranked.select("signature", F.when(F.col("size") >= min_class_size, F.col("rank")).otherwise(F.lit(-1)).alias("class"))
    return signed.join(classes, "signature")


def stratified_folds(rows: DataFrame, key: str, kind: str, folds: int = 5, seed: int = 42, min_class_size: int = 5) -> DataFrame:
    """(key, class, fold): documents of a class are dealt to the folds in turn,
    in a seeded order, classes following one another, so a class's counts differ
    by at most one between folds."""
    classed = signature_classes(signatures(rows, key, kind), key, min_class_size).select(key, "class")
    shuffled = classed.withColumn("_order", seeded(seed, F.col(key)))
    numbered = number_groups(shuffled, ["class"], md5_bucket(F.col("_order")), [F.col("_order"), F.col(key)], "_at")
    sizes = classed.groupBy(F.col("class").alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = sum_before(sizes, "_c", "_n", "_o").select("_c", "_o")
    return numbered.join(offsets, F.col("class") == F.col("_c")).select(key, "class", ((F.col("_o") + F.col("_at")) % folds).cast("int").alias("fold"))


def fold_splits(df: DataFrame, folds: DataFrame, key: str, k: int) -> DataFrame:
    """Every row once for each fold, as ``val`` in its own and ``train`` in the
    others; written with partitionBy("fold", "split"), a fold is a directory."""
    own = df.join(folds.select(key, F.col("fold").alias("_own")), key)
    every = own.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return every.withColumn("split", F.when(F.col("fold") == F.col("_own"), "val").otherwise("train")).drop("_own")


def fold_report(split: DataFrame, key: str, kind: str) -> DataFrame:
    """Rows and documents of each fold and split, by kind."""
    return split.groupBy("fold", "split", kind).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(key).alias("documents"))


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (or all) without replacement."""
    return df.orderBy(seeded(seed, F.col(key)), key).limit(n)


def shuffled_number(df: DataFrame, key: str, seed: int | str, out: str) -> DataFrame:
    """Adds each row's place, from 0 on, in an order shuffled by the seed."""
    rows = df.withColumn("_order", seeded(seed, F.col(key)))
    return number_groups(rows, [], md5_bucket(F.col("_order")), [F.col("_order"), F.col(key)], out).drop("_order")


def ratio_split(df: DataFrame, key: str, ratio: float, seed: int | str = 42) -> DataFrame:
    """Adds ``split``: the first floor(n * ratio) rows of a seeded shuffle are
    ``train``, the rest ``test``."""
    numbered = shuffled_number(df, key, seed, "_at")
    total = df.agg(F.floor(F.count(F.lit(1)) * F.lit(ratio)).alias("_cut"))
    cut = total.first()[0]
    return numbered.withColumn("split", F.when(F.col("_at") < F.lit(cut), "train").otherwise("test")).drop("_at")


def batches(df: DataFrame, order: Sequence[Column], size: int, out: str = "batch") -> DataFrame:
    """Adds the number of the row's batch, each of ``size`` rows in order."""
    return number_rows(df, order, "_at").withColumn(out, F.floor(F.col("_at") / size)).drop("_at")


def neighbours(df: DataFrame, by: Sequence[str], order: Sequence[Column], key: str) -> DataFrame:
    """Adds the previous and next key in order; at an end, the row's own."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("previous", F.coalesce(F.lag(key).over(w), F.col(key))).withColumn("next", F.coalesce(F.lead(key).over(w), F.col(key)))
