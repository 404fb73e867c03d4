"""Descriptive summaries: describe, histograms, densities, means, reports."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import digest

STATS = ("count", "mean", "std", "min", "25%", "50%", "75%", "max")


def describe(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Count, mean, sample deviation, extremes and linear quartiles of the
    non-null values, a row for each group."""
    v = F.col(value).cast("double")
    q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    wide = df.groupBy(*by).agg(F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), q.alias("_q"), F.max(v).alias("max"))
    return wide.select(*by, "count", "mean", "std", "min", *(F.get("_q", F.lit(i)).alias(n) for i, n in enumerate(("25%", "50%", "75%"))), "max")


def unpivoted(summary: DataFrame, by: Sequence[str] = (), drop: Sequence[str] = (), digits: int | None = None) -> DataFrame:
    """A summary turned: a row for each group and statistic."""
    names = [c for c in summary.columns if c not in by]
    as_double = summary.select(*by, *(F.col(f"`{c}`").cast("double").alias(c) for c in names))
    long = as_double.unpivot(list(by), [f"`{c}`" if "%" in c else c for c in names], "stat", "value").where(~F.col("stat").isin(*drop)) if drop else as_double.unpivot(list(by), [f"`{c}`" if "%" in c else c for c in names], "stat", "value")
    return long.withColumn("value", F.bround("value", digits)) if digits is not None else long


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows of each value, the most frequent first, ties by value; null counts as
    a value."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("count")).orderBy(F.col("count").desc(), column)


def histogram(df: DataFrame, value: str, width: float, start: float = 0.0, by: Sequence[str] = ()) -> DataFrame:
    """Counts in bins of equal width; bin k is [start + k width, start + (k + 1) width)."""
    return df.where(F.col(value).isNotNull()).groupBy(*by, F.floor((F.col(value) - start) / width).alias("bin")).agg(F.count(F.lit(1)).alias("count"))


def auto_width(df: DataFrame, value: str) -> float:
    """Freedman-Diaconis bin width, 1.0 where the quartiles meet."""
    n, q = df.agg(F.count(value), F.percentile(F.col(value).cast("double"), F.array(F.lit(0.25), F.lit(0.75)))).first()
    return 2 * (q[1] - q[0]) / n ** (1 / 3) if n and q[1] > q[0] else 1.0


def density(df: DataFrame, value: str, lo: float, hi: float, points: int = 200, bandwidth: float | None = None) -> DataFrame:
    """A gaussian kernel density on an even grid (Scott's bandwidth by default).

    Equal values are counted first, then each distinct value meets the grid."""
    v = F.col(value).cast("double")
    n, std = df.agg(F.count(v), F.stddev_samp(v)).first()
    h = bandwidth or (std or 1.0) * max(n, 1) ** -0.2
    counts = df.where(v.isNotNull()).groupBy(v.alias("v")).agg(F.count(F.lit(1)).alias("w"))
    step = (hi - lo) / (points - 1)
    grid = counts.select("v", "w", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    x = F.lit(lo) + F.col("i") * F.lit(step)
    kernel = F.exp(-0.5 * F.pow((x - F.col("v")) / F.lit(h), F.lit(2)))
    scale = 1 / (max(n, 1) * h * (2 * 3.141592653589793) ** 0.5)
    return grid.groupBy("i").agg((F.sum(F.col("w") * kernel) * F.lit(scale)).alias("density")).withColumn("x", F.lit(lo) + F.col("i") * F.lit(step))


def mean_of_correct(df: DataFrame, truth: str, answer: str) -> DataFrame:
    """Accuracy: the mean of equality; null answers count as wrong."""
    return df.agg(F.avg(F.coalesce(F.col(truth) == F.col(answer), F.lit(False)).cast("double")).alias("accuracy"))


def drop_matching(df: DataFrame, pattern: str) -> DataFrame:
    """Without the columns whose name matches."""
    return df.drop(*(c for c in df.columns if re.search(pattern, c)))


def renamed_rows(df: DataFrame, column: str, names: Mapping[str, str]) -> DataFrame:
    """Values replaced by a mapping; others, and nulls, stay."""
    return df.replace(dict(names), subset=[column])


def flag_maximum(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Adds whether a row holds its group's largest value; nulls never do.  Null
    group keys form a group.  Maxima are pre-aggregated, and joined by their
    size."""
    names = {g: f"_g{i}" for i, g in enumerate(by)}
    top = df.groupBy(*by).agg(F.max(column).alias("_top")).select(*(F.col(g).alias(n) for g, n in names.items()), "_top")
    if by:
        joined = df.join(top, reduce(lambda a, b: a & b, (F.col(g).eqNullSafe(F.col(n)) for g, n in names.items())))
    else:
        joined = df.crossJoin(F.broadcast(top))  # one row
    return joined.withColumn("is_max", F.coalesce(F.col(column) == F.col("_top"), F.lit(False))).drop("_top", *names.values())


def keep_first(df: DataFrame, subset: Sequence[str], pos: str) -> DataFrame:
    """The first row, by ``pos``, of each distinct combination of ``subset``; null
    equals null, a null ``pos`` comes last, and rows that tie fall by a digest
    of all their columns (equal rows are one).

    The first is found by a pre-aggregated minimum, so equal combinations never
    gather in one task, and by digests, so long texts aren't compared."""
    names = df.columns
    rows = df.withColumns({"_digest": digest(*subset), "_place": F.struct(F.col(pos).isNull().alias("none"), F.col(pos).alias("pos"), digest(*names).alias("row"))})
    first = rows.groupBy(F.col("_digest").alias("_first")).agg(F.min("_place").alias("_at"))
    met = rows.join(first, (F.col("_digest") == F.col("_first")) & (F.col("_place") <= F.col("_at")), "left_semi")
    return met.dropDuplicates(["_digest"]).select(*(f"`{c}`" for c in names))


def first_seen(df: DataFrame, label: str, pos: str) -> DataFrame:
    """Distinct labels in order of first appearance."""
    return df.groupBy(label).agg(F.min(pos).alias("first_pos")).orderBy("first_pos", label)


def longest(df: DataFrame, text: str, key: Column | str) -> DataFrame:
    """The key of the longest text, the least key of several."""
    k = F.col(key) if isinstance(key, str) else key
    return df.agg(F.max_by(k, F.struct(F.length(text), -k)).alias("key"), F.max(F.length(text)).alias("length"))


def last_write(df: DataFrame, keys: Sequence[str], value: str, pos: str) -> DataFrame:
    """The value written last for each key."""
    return df.groupBy(*keys).agg(F.max_by(value, pos).alias(value))
