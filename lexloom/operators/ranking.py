"""Gapless numbers, top rows and positional trims that no single task pays for."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import digest

#: Buckets into which one group is dealt when its rows are numbered by a hash.
RANK_BUCKETS = 512
#: A whole table's rows are numbered in buckets of about so many rows each, at
#: most MOST_CUTS buckets; bounds come from SAMPLED rows of a sample for each.
CUT_ROWS = 200_000
MOST_CUTS = 2_048
SAMPLED = 24
#: Keys from one entry of a two-level running sum to the next.
SUM_WIDTH = 4_096


def spread(df: DataFrame) -> DataFrame:
    """A small table dealt over all cores, before costly work on its rows: one
    that a scan would read in fewer parts than there are cores.  Larger tables
    stay as they are, so nothing grows with the data."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    part = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * part else df


def number_groups(df: DataFrame, groups: Sequence[str], bucket: Column, order: Sequence[Column], out: str, counts_from: DataFrame | None = None, few: bool = False) -> DataFrame:
    """Adds ``out``: 0, 1, 2, ... within each group, by ``bucket``, then
    ``order``.  Buckets are numbered apart and offset by prefix sums, so a group
    of any size is spread over many tasks.  ``bucket`` must be a function of the
    row that rises with the order wanted, or any hash if only a fixed order is.
    ``counts_from`` may give the same rows with fewer columns, to be counted
    without reading wide ones.  ``few`` promises that groups times buckets is a
    small bounded number, so that their offsets may be broadcast; otherwise the
    engine joins them by their size.

    Null group keys form a group; an empty table gives no rows."""
    names = {g: f"_g{i}" for i, g in enumerate(groups)}
    rows = df.withColumn("_bucket", bucket)
    counted = rows if counts_from is None else counts_from.withColumn("_bucket", bucket)
    counts = counted.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*(F.col(g).alias(n) for g, n in names.items()), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(*groups, "_bucket").orderBy(*order)
    rows = rows.withColumn("_in_bucket", F.row_number().over(within).cast("long") - 1)
    same = F.col("_bucket") == F.col("_b")
    for g, n in names.items():
        same = same & F.col(g).eqNullSafe(F.col(n))
    done = rows.join(F.broadcast(offsets) if few or not groups else offsets, same)
    return done.withColumn(out, F.col("_offset") + F.col("_in_bucket")).drop("_b", "_bucket", "_offset", "_in_bucket", *names.values())


def md5_bucket(text: Column, buckets: int = RANK_BUCKETS) -> Column:
    """The bucket of an md5 text: it rises with the text's order."""
    return F.shiftright(F.conv(F.substring(text, 1, 4), 16, 10).cast("int"), 16 - (buckets - 1).bit_length())


#: Types whose values can be written into a plan as bounds; dates and times go
#: as whole numbers of the same order.
_PLAIN = (T.IntegralType, T.FractionalType, T.StringType, T.BooleanType, T.BinaryType)


def _bounds(rows: DataFrame, keys: Sequence[str]) -> list[tuple]:
    """Sorted key tuples that cut a table into parts of about CUT_ROWS rows: at
    most MOST_CUTS, from a sample of at most about SAMPLED rows for each."""
    total = rows.count()
    cuts = min(MOST_CUTS, ceil(total / CUT_ROWS)) - 1
    if cuts < 1:
        return []
    sampled = rows.select(*keys).sample(min(1.0, 1.2 * SAMPLED * (cuts + 1) / total), seed=1).limit(2 * SAMPLED * (cuts + 1))
    # Ordered by the engine, as Python orders nulls and texts otherwise.
    found = [tuple(r) for r in sampled.orderBy(*keys).collect()]
    picked = [found[i * len(found) // (cuts + 1)] for i in range(1, cuts + 1)] if found else []
    return [x for i, x in enumerate(picked) if not i or x != picked[i - 1]]


def _lower_bound(bounds: Column, n: int, key: Column) -> Column:
    """How many of n sorted bounds are below the key, by binary search."""
    step = lambda at, _: F.when(at["lo"] >= at["hi"], at).when(F.get(bounds, F.floor((at["lo"] + at["hi"]) / 2).cast("int")) < key, F.struct((F.floor((at["lo"] + at["hi"]) / 2).cast("int") + 1).alias("lo"), at["hi"].alias("hi"))).otherwise(F.struct(at["lo"].alias("lo"), F.floor((at["lo"] + at["hi"]) / 2).cast("int").alias("hi")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(n.bit_length() + 1)), F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi")), step, lambda at: at["lo"])


def number_rows(df: DataFrame, order: Sequence[Column], out: str) -> DataFrame:
    """Adds the row number from 0 on in the ascending order of the given
    columns, nulls first: dealt by ranges at sampled bounds of the whole key,
    whatever its types, so that the parts in turn are in order.

    Rows that tie on the key follow a hash of their columns, so a frequent key
    is spread too and only equal rows share a part.  Keys of nested types are
    ordered by, but not dealt by: where the first is one, a single task numbers
    all.  An empty table gives no rows."""
    whole = [F.col(f"`{f.name}`") for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    keys = [f"_k{i}" for i in range(len(order))]
    rows = df.withColumns(dict(zip(keys, order)) | {"_tie": F.xxhash64(*whole)})
    cutting, kinds = [], dict(rows.dtypes)
    for k in [*keys, "_tie"]:
        kind = rows.schema[k].dataType
        number = {T.DateType: F.unix_date, T.TimestampType: F.unix_micros}.get(type(kind))
        if number is None and not isinstance(kind, _PLAIN):
            break
        rows = rows.withColumn(f"_cut{k}", number(k) if number else F.col(k))
        cutting.append(f"_cut{k}")
    kinds = dict(rows.dtypes)
    bounds = _bounds(rows, cutting) if cutting else []
    if not bounds:  # at most some CUT_ROWS rows, or a key that can't be dealt by
        return rows.withColumn(out, F.row_number().over(Window.orderBy(*keys, "_tie")).cast("long") - 1).drop(*keys, "_tie", *cutting)
    table = F.array(*(F.struct(*(F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(cutting, b))) for b in bounds))
    bucket = _lower_bound(table, len(bounds), F.struct(*cutting))
    return number_groups(rows, [], bucket, [*map(F.col, keys), F.col("_tie")], out).drop(*keys, "_tie", *cutting)


def sum_before(df: DataFrame, key: str, value: str, out: str, width: int = SUM_WIDTH) -> DataFrame:
    """Adds the sum of ``value`` over all rows of a smaller whole-number ``key``
    (each key once).  Runs of ``width`` keys are summed apart and offset by the
    sums of the runs before, the only rows that meet in one task."""
    rows = df.withColumn("_run", F.floor(F.col(key) / width))
    runs = rows.groupBy("_run").agg(F.sum(value).alias("_sum"))
    so_far = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(F.col("_run").alias("_r"), F.coalesce(F.sum("_sum").over(so_far), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("_run").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return rows.join(runs, F.col("_run") == F.col("_r")).withColumn(out, F.col("_offset") + F.col("_inside")).drop("_run", "_r", "_offset", "_inside")


def seeded(seed: int | str, key: Column) -> Column:
    """A text whose order is a shuffle fixed by the seed."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def trim_sorted(df: DataFrame, order: Sequence[Column], reverse: Sequence[Column], head: int, tail: int) -> DataFrame:
    """Rows without the first ``head`` in ``order`` and the last ``tail``, which
    are the first in ``reverse``: two bounded top lists, no sort of the table.

    Rows are told apart by a digest of all their columns, and ties in the order
    fall by it; of equal rows just as many go as the lists hold.  Where head and
    tail overlap nothing is left; an empty table gives no rows."""
    if head <= 0 and tail <= 0:
        return df
    names = df.columns
    rows = df.withColumn("_row", digest(*names))
    ends = [rows.orderBy(*by, "_row").limit(n).select("_row") for by, n in ((order, head), (reverse, tail)) if n > 0]
    gone = ends[0] if len(ends) == 1 else ends[0].unionByName(ends[1])
    gone = gone.groupBy(F.col("_row").alias("_gone")).agg(F.count(F.lit(1)).alias("_n_gone"))  # head + tail rows at most
    marked = rows.join(F.broadcast(gone), F.col("_row") == F.col("_gone"), "left")
    # Equal rows are one row and a count until some of them are given back.
    met = marked.where("_gone IS NOT NULL").groupBy("_row", "_n_gone").agg(F.count(F.lit(1)).alias("_n"), *(F.first(F.col(f"`{c}`")).alias(c) for c in names))
    back = met.where("_n > _n_gone").withColumn("_i", F.explode(F.expr("sequence(1L, _n - _n_gone)")))
    return marked.where("_gone IS NULL").select(*(f"`{c}`" for c in names)).unionByName(back.select(*(f"`{c}`" for c in names)))


def top_n(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group, with their rank from 1 on.  The engine
    cuts each group to n rows before its rows meet in one task."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= n)
