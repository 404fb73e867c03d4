"""Scores of entities, answers and retrieval."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import tokenize


def _ratios(df: DataFrame) -> DataFrame:
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    out = df.withColumn("precision", safe(tp, tp + fp)).withColumn("recall", safe(tp, tp + fn))
    return out.withColumn("f1", safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def entity_scores(predicted: DataFrame, gold: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Exact-match precision, recall and F1 of spans, for each label and, with a
    null label, over all."""
    p = predicted.select(*keys, label).distinct().withColumn("_p", F.lit(1))
    g = gold.select(*keys, label).distinct().withColumn("_g", F.lit(1))
    both = p.join(g, [*keys, label], "full_outer")
    hit = F.col("_p").isNotNull() & F.col("_g").isNotNull()
    sums = (F.sum(hit.cast("long")).alias("tp"), F.sum((F.col("_g").isNull()).cast("long")).alias("fp"), F.sum((F.col("_p").isNull()).cast("long")).alias("fn"))
    each = both.groupBy(label).agg(*sums)
    every = both.agg(*sums).select(F.lit(None).cast(dict(each.dtypes)[label]).alias(label), "tp", "fp", "fn").where("tp IS NOT NULL")
    return _ratios(each.unionByName(every))


def binary_scores(df: DataFrame, truth: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts, precision, recall, F1 and accuracy of 0/1 columns."""
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    count = lambda c: F.sum(c.cast("long"))
    sums = df.groupBy(*by).agg(count(t & p).alias("tp"), count(~t & p).alias("fp"), count(t & ~p).alias("fn"), count(~t & ~p).alias("tn"))
    return _ratios(sums).withColumn("accuracy", (F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")))


def share_supported(verdicts: DataFrame, sample: str, verdict: str, out: str) -> DataFrame:
    """Faithfulness (claims supported by the context) and context recall (gold
    sentences found in it): the share of true verdicts for each sample."""
    return verdicts.groupBy(sample).agg(F.avg(F.coalesce(F.col(verdict), F.lit(False)).cast("double")).alias(out))


def context_precision(verdicts: DataFrame, sample: str, rank: str, verdict: str, out: str = "context_precision") -> DataFrame:
    """Mean of precision at k over the ranks k that are relevant; 0 if none is."""
    w = Window.partitionBy(sample).orderBy(rank)
    v = F.coalesce(F.col(verdict), F.lit(False)).cast("double")
    at = verdicts.withColumn("_v", v).withColumn("_p", F.sum("_v").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) / F.row_number().over(w))
    sums = at.groupBy(sample).agg(F.sum(F.col("_p") * F.col("_v")).alias("_s"), F.sum("_v").alias("_n"))
    return sums.select(sample, F.when(F.col("_n") > 0, F.col("_s") / F.col("_n")).otherwise(F.lit(0.0)).alias(out))


def answer_relevancy(pairs: DataFrame, sample: str, score: str, out: str = "answer_relevancy") -> DataFrame:
    """The mean similarity of a question to those regenerated from its answer."""
    return pairs.groupBy(sample).agg(F.avg(score).alias(out))


def _grams(df: DataFrame, key: str, text: str, n: int, out: str) -> DataFrame:
    tokens = df.select(key, F.transform(tokenize(F.coalesce(text, F.lit(""))), F.lower).alias("t"))
    starts = F.when(F.size("t") >= n, F.sequence(F.lit(1), F.size("t") - (n - 1))).otherwise(F.array().cast("array<int>"))
    rows = tokens.select(key, F.explode(F.transform(starts, lambda i: F.array_join(F.slice("t", i, F.lit(n)), " "))).alias("g"))
    return rows.groupBy(key, "g").agg(F.count(F.lit(1)).alias(out))


def rouge_n(pairs: DataFrame, key: str, candidate: str, reference: str, n: int = 1) -> DataFrame:
    """Per pair: shared n-grams counted as multisets, and precision, recall, F1."""
    a, b = _grams(pairs, key, candidate, n, "ca"), _grams(pairs, key, reference, n, "cb")
    both = a.join(b, [key, "g"], "full_outer").na.fill(0, ["ca", "cb"])
    sums = both.groupBy(key).agg(F.sum(F.least("ca", "cb")).alias("shared"), F.sum("ca").alias("a"), F.sum("cb").alias("b"))
    sums = pairs.select(key).distinct().join(sums, key, "left").na.fill(0, ["shared", "a", "b"])
    safe = lambda x, y: F.when(y > 0, x / y).otherwise(F.lit(0.0))
    p, r = safe(F.col("shared"), F.col("a")), safe(F.col("shared"), F.col("b"))
    return sums.select(key, "shared", p.alias("precision"), r.alias("recall"), safe(2 * p * r, p + r).alias("f1"))


@F.pandas_udf(T.DoubleType())
def rouge_l(candidate: pd.Series, reference: pd.Series) -> pd.Series:
    """F1 of the longest common subsequence of tokens (arrays), by Hunt and
    Szymanski's method, quick where few tokens match."""
    from bisect import bisect_left

    def one(a, b) -> float:
        a, b = list(a if a is not None else ()), list(b if b is not None else ())
        places: dict[str, list[int]] = {}
        for j in range(len(b) - 1, -1, -1):
            places.setdefault(b[j], []).append(j)
        ends: list[int] = []
        for x in a:
            for j in places.get(x, ()):
                k = bisect_left(ends, j)
                ends[k : k + 1] = [j]
        n = len(ends)
        return 2 * n / (len(a) + len(b)) if n else 0.0

    return pd.Series([one(a, b) for a, b in zip(candidate, reference)], dtype="float64")
