import random
import statistics
from datetime import date, timedelta
from decimal import Decimal
from collections import Counter

from pyspark.sql import functions as F

from lexloom.operators import joins, ranking, splits, stats


def test_folds_are_a_stratified_partition(spark):
    rng = random.Random(1)
    rows = [(d, rng.choice("CG")) for d in range(200) for _ in range(rng.randint(1, 4))]
    df = spark.createDataFrame(rows, "PMID long, Type string")
    got = splits.stratified_folds(df, "PMID", "Type", 5, 42, 5).collect()
    assert sorted(r.PMID for r in got) == list(range(200))
    counts = Counter((r["class"], r.fold) for r in got)
    for c in {r["class"] for r in got}:
        own = [counts[(c, f)] for f in range(5)]
        assert max(own) - min(own) <= 1
    signs = Counter(tuple(sorted(Counter(t for d, t in rows if d == p).items())) for p in range(200))
    assert sum(r["class"] == -1 for r in got) == sum(n for n in signs.values() if n < 5)
    again = splits.stratified_folds(df.repartition(7), "PMID", "Type", 5, 42, 5).collect()
    assert {tuple(r) for r in again} == {tuple(r) for r in got}
    split = splits.fold_splits(df, spark.createDataFrame(got), "PMID", 5)
    for f in range(5):
        val = {r.PMID for r in split.where(f"fold = {f} AND split = 'val'").select("PMID").distinct().collect()}
        train = {r.PMID for r in split.where(f"fold = {f} AND split = 'train'").select("PMID").distinct().collect()}
        assert not val & train and len(val | train) == 200


def test_numbering_is_gapless_and_ordered(spark):
    values = [random.Random(i).choice([None, 1.0, 1.0, 5.5, -3.0, float(i)]) for i in range(500)]
    df = spark.createDataFrame(list(enumerate(values)), "k long, v double").repartition(9)
    got = sorted(ranking.number_rows(df, [F.col("v"), F.col("k")], "n").collect(), key=lambda r: r.n)
    assert [r.n for r in got] == list(range(500))
    keys = [(r.v is not None, r.v or 0.0, r.k) for r in got]
    assert keys == sorted(keys)
    assert ranking.number_rows(df.limit(0), [F.col("v")], "n").collect() == []


def test_trim_split_sample_batches(spark):
    df = spark.createDataFrame([(i, None if i == 7 else i % 10) for i in range(50)], "k long, v long")
    left = ranking.trim_sorted(df, [F.col("v").asc_nulls_last(), F.col("k")], [F.col("v").desc_nulls_first(), F.col("k").desc()], 6, 2)
    assert left.count() == 42 and 7 not in {r.k for r in left.collect()}
    parts = Counter(r.split for r in splits.ratio_split(df, "k", 0.7).collect())
    assert parts == {"train": 35, "test": 15}
    assert splits.seeded_sample(df, "k", 12).count() == 12 and splits.seeded_sample(df, "k", 99).count() == 50
    assert {r.k for r in splits.seeded_sample(df, "k", 12).collect()} == {r.k for r in splits.seeded_sample(df.repartition(5), "k", 12).collect()}
    sizes = Counter(r.batch for r in splits.batches(df, [F.col("k")], 8).collect())
    assert sorted(sizes.values()) == [2, 8, 8, 8, 8, 8, 8]
    ends = {r.k: (r.previous, r.next) for r in splits.neighbours(df, [], [F.col("k")], "k").collect()}
    assert ends[0] == (0, 1) and ends[49] == (48, 49)


def test_describe_and_density(spark):
    values = [1.0, 2.0, 2.0, 10.0, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    r = stats.describe(df, "v").collect()[0]
    assert (r["count"], r["mean"], r["min"], r["25%"], r["50%"], r["75%"], r["max"]) == (4, 3.75, 1.0, 1.75, 2.0, 4.0, 10.0)
    assert abs(r["std"] - statistics.stdev(values[:4])) < 1e-12
    long = {x.stat: x.value for x in stats.unpivoted(stats.describe(df, "v"), drop=["count"], digits=2).collect()}
    assert long["25%"] == 1.75 and "count" not in long
    assert {(x.bin, x["count"]) for x in stats.histogram(df, "v", 2.0).collect()} == {(0, 1), (1, 2), (5, 1)}
    grid = stats.density(df, "v", -50.0, 60.0, 1101).collect()
    assert abs(sum(x.density for x in grid) * 0.1 - 1) < 1e-3
    assert stats.auto_width(df, "v") > 0


def test_first_last_and_flags(spark):
    df = spark.createDataFrame([(1, "b", 3), (2, "a", None), (3, "b", 9), (4, None, 9)], "pos long, x string, v int")
    assert {r.pos for r in stats.keep_first(df, ["x"], "pos").collect()} == {1, 2, 4}
    assert [r.x for r in stats.first_seen(df, "x", "pos").collect()] == ["b", "a", None]
    assert {r.pos for r in stats.flag_maximum(df, "v").where("is_max").collect()} == {3, 4}
    assert {(r.x, r.v) for r in stats.last_write(df, ["x"], "v", "pos").collect()} == {("b", 9), ("a", None), (None, 9)}
    assert stats.mean_of_correct(df.withColumn("w", F.lit(9)), "v", "w").collect()[0].accuracy == 0.5
    assert [r.x for r in stats.value_counts(df, "x").collect()][0] == "b"
    assert stats.renamed_rows(df, "x", {"a": "z"}).where("x = 'z'").count() == 1


def test_numbers_follow_any_type(spark, monkeypatch):
    monkeypatch.setattr(ranking, "CUT_ROWS", 5)
    rng = random.Random(1)
    whole = [None, *[rng.randint(-50, 150) for _ in range(60)]]
    kinds = {"decimal(9,2)": lambda x: Decimal(x) / 4, "string": str, "date": lambda x: date(2020, 1, 1) + timedelta(x), "double": float, "array<int>": lambda x: [x], "boolean": lambda x: x > 3}
    for kind, make in kinds.items():
        values = [None if x is None else make(x) for x in whole]
        df = spark.createDataFrame([(v, "same") for v in values], f"v {kind}, w string").repartition(5)
        got = sorted(ranking.number_rows(df, [F.col("v")], "n").collect(), key=lambda r: r.n)
        assert [r.n for r in got] == list(range(len(values)))
        assert [r.v for r in got] == sorted(values, key=lambda v: (v is not None, v if v is not None else values[-1])), kind
    # One frequent first key is dealt by the next ones.
    hot = spark.createDataFrame([("hot", i % 7, i) for i in range(90)], "a string, b int, c int")
    assert [r.c for r in sorted(ranking.number_rows(hot, [F.col("a"), F.col("b")], "n").collect(), key=lambda r: r.n)][:13] and len(ranking._bounds(hot, ["a", "b"])) > 3


def test_sums_before(spark):
    df = spark.createDataFrame([(i, i % 5) for i in range(-1, 60)], "k long, v long")
    got = {r.k: r.s for r in ranking.sum_before(df, "k", "v", "s", width=7).collect()}
    assert got == {i: sum(j % 5 for j in range(-1, i)) for i in range(-1, 60)}


def test_trim_counts_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, None), (3, None)], "k int, x string")
    trim = lambda head, tail: sorted(tuple(r) for r in ranking.trim_sorted(df, [F.col("k")], [F.col("k").desc()], head, tail).select("k").collect())
    assert trim(1, 0) == [(1,), (2,), (3,), (3,)] and trim(0, 1) == [(1,), (1,), (2,), (3,)]
    assert trim(2, 2) == [(2,)] and trim(4, 4) == [] and trim(0, 0) == [(1,), (1,), (2,), (3,), (3,)]
    ties = spark.createDataFrame([(1, "a"), (1, "b")], "k int, x string")
    assert ranking.trim_sorted(ties, [F.col("k")], [F.col("k").desc()], 1, 0).count() == 1


def test_first_of_ties_and_nulls(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 2, "z"), ("c", None, "n"), ("d", 5, "p"), ("d", 5, "q"), ("d", 5, "p"), (None, None, None)], "k string, pos int, o string")
    got = sorted(((r.k, r.pos) for r in stats.keep_first(df, ["k"], "pos").collect()), key=str)
    assert got == sorted([("a", 1), ("b", 2), ("c", None), ("d", 5), (None, None)], key=str)


def test_maxima_of_null_groups(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("g", 5), ("g", None)], "g string, v int")
    assert {(r.g, r.v) for r in stats.flag_maximum(df, "v", ["g"]).where("is_max").collect()} == {(None, 2), ("g", 5)}


def test_lookup_of_repeated_keys(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    t = spark.createDataFrame([(1, "old", 1), (1, "new", 2), (None, "never", 3)], "k int, v string, pos int")
    assert {r.k: r.v for r in joins.with_default(df, t, "k", "v", "none", "pos").collect()} == {1: "new", 2: "none", None: "none"}
    assert {r.k: r.v for r in joins.with_default(df, t, "k", "v", "none").collect()}[1] == "old"
