"""Mixing sources to target weights by Pfair scheduling (operator 1).

A source's documents, in a hashed order, form blocks.  Block k of a source of
weight w is released at slot floor(k / w) and due at ceil((k + 1) / w); each
slot goes to the released block with the earliest deadline.  Weights that sum to
one make this feasible on one "processor", so after any number t of slots each
source has had w t blocks, give or take less than one.

Weights hold over the whole run, whatever its length: they are rounded only
where that moves less than one block in all.  The schedule runs over all blocks
on the driver, in whole numbers, and gives each block its slot and first position; rows are numbered
within their source and meet their block.  The driver holds an entry for each
source and each block, of which there are about MOST_BLOCKS at most, never a
row.  Each document is given out once.  A source
that runs out leaves its slots empty, so the others go on in proportion.

Defined results: every source is told apart, whatever their number; null is a
source of its own; where weights are given, null and all sources that they do
not name share one weight; sources of weight zero come last; deadlines that tie
fall to the larger weight, then to the more frequent source; rows with a null
id and repeated rows are scheduled as any other; texts, null or long, play no
part; an empty table gives no rows; extra columns are kept by ``mixed`` and ignored by ``schedule``.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping, Sequence
from fractions import Fraction
from math import lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import RANK_BUCKETS, number_groups
from .common import pick

#: Rows of a block, at least: more where the table would have over MOST_BLOCKS,
#: so that the schedule, on the driver, is bounded.
BLOCK_ROWS = 64
MOST_BLOCKS = 1_000_000
PERIOD = 1_024
#: Slots, as a multiple of all blocks, for which sources that ran out keep theirs.
EMPTY_TURNS = 4
#: Rows of a source for each bucket that numbers them.
BUCKET_ROWS = 2_048
#: Sources, or blocks, up to which their table is sent to every executor.
BROADCAST_ROWS = 500_000
#: Without given weights a source's weight is its share of rows to this power.
TEMPERATURE = 0.7


def quotas(weights: Sequence[float], period: int = PERIOD) -> list[int]:
    """Slots of each source in a period, one at least, by largest remainder."""
    exact = np.array(weights, dtype=float) / sum(weights) * period
    whole = np.maximum(1, np.floor(exact).astype(int))
    while whole.sum() > period:
        whole[int(np.argmax(np.where(whole > 1, whole - exact, -np.inf)))] -= 1
    while whole.sum() < period:
        whole[int(np.argmax(exact - whole))] += 1
    return whole.tolist()


def pfair_period(slots: Sequence[int]) -> list[list[int]]:
    """Earliest deadline first over one period: the slots of each source's
    blocks, in order."""
    period = sum(slots)
    table: list[list[int]] = [[] for _ in slots]
    waiting = [(0, i) for i in range(len(slots))]  # (release, source)
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []  # (deadline, -quota, source)
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            _, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(len(table[i]) + 1) * period // slots[i]), -slots[i], i))
        _, _, i = heapq.heappop(ready)
        table[i].append(t)
        if len(table[i]) < slots[i]:
            heapq.heappush(waiting, (len(table[i]) * period // slots[i], i))
    return table


def exact_parts(weights: Sequence[float]) -> list[int]:
    """Whole numbers in the exact ratio of the weights as they are written in
    decimals; weights below zero count as zero."""
    exact = [max(Fraction(0), Fraction(repr(float(w)))) for w in weights]
    scale = lcm(*(f.denominator for f in exact))
    return [int(f * scale) for f in exact]


def block_parts(blocks: Sequence[int], weights: Sequence[float]) -> tuple[list[int], list[float]]:
    """The whole numbers to schedule by, and each source's true weight.

    They are the slots of a period of about PERIOD where such rounding moves
    less than one block, of all sources together, over the whole run; the exact
    ratio elsewhere."""
    parts = exact_parts(weights)
    whole = sum(parts)
    true = [p / (whole or 1) for p in parts]
    if whole and all(parts):
        slots = max(-(-b * whole // p) for b, p in zip(blocks, parts))
        period = max(PERIOD, 4 * len(parts))
        # Without this a source below one slot a period would be raised to it.
        fits = slots <= period and min(true) * period >= 1
        rounded = quotas(weights, period) if fits else parts
        if fits and sum(abs(q / period - w) for q, w in zip(rounded, true)) * slots < 1:
            return rounded, true
    return parts, true


def pfair_blocks(blocks: Sequence[int], parts: Sequence[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Earliest deadline first over all blocks: source, block and slot of each,
    in order of slots.  Source i has blocks[i] blocks and a share of
    parts[i] / sum(parts), in exact arithmetic.

    A source that has run out still takes its slots, empty, for as many slots
    as EMPTY_TURNS times all blocks.  From there on its slots are skipped, which
    leaves every block within its window: a part of a feasible set of windows
    is feasible.  So the steps are bounded by the blocks, whatever the weights.
    Sources of weight zero have no windows and follow the others."""
    whole, total, t, n = sum(parts), sum(blocks), 0, 0
    source, block, slot = np.zeros(total, np.int32), np.zeros(total, np.int64), np.zeros(total, np.int64)
    last = sum(b for b, p in zip(blocks, parts) if p)
    held = EMPTY_TURNS * total + PERIOD
    had = [0] * len(parts)
    waiting = [(0, i) for i, p in enumerate(parts) if p]  # (release, source)
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []  # (deadline, -part, source)
    while n < last:
        if not ready and waiting[0][0] > t:
            t = waiting[0][0]
        while waiting and waiting[0][0] <= t:
            _, i = heapq.heappop(waiting)
            if had[i] < blocks[i] or t < held:
                heapq.heappush(ready, (-(-(had[i] + 1) * whole // parts[i]), -parts[i], i))
        if not ready:
            continue
        _, _, i = heapq.heappop(ready)
        if had[i] < blocks[i]:
            source[n], block[n], slot[n] = i, had[i], t
            n += 1
        had[i] += 1
        heapq.heappush(waiting, (had[i] * whole // parts[i], i))
        t += 1
    for i, p in enumerate(parts):
        if not p:
            k = np.arange(blocks[i])
            source[n : n + len(k)], block[n : n + len(k)], slot[n : n + len(k)] = i, k, t + k
            n, t = n + len(k), t + len(k)
    return source, block, slot


def _scheduled(rows: DataFrame, weights: Mapping[str, float] | None, block_rows: int | None, seed: int) -> tuple[DataFrame, int] | None:
    """``rows`` (id, source, ...) with weight, block, slot and position, and
    their number; None without rows."""
    spark = rows.sparkSession
    counts = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    if not total:
        return None
    block_rows = block_rows or max(BLOCK_ROWS, -(-total // MOST_BLOCKS))
    named = counts.where("source IS NOT NULL")
    if weights is not None:
        named = named.where(F.col("source").isin([x for x in weights if x is not None]))
    # A row for each source, two columns, as Arrow.
    top = sorted(zip(*(c.to_pylist() for c in named.select("source", "n").toArrow().columns)), key=lambda r: (-r[1], r[0]))
    names, sizes = [x for x, _ in top], [n for _, n in top]
    given = [float(weights[x]) if weights is not None else (n / total) ** TEMPERATURE for x, n in top]
    rest = total - sum(sizes)
    if rest:
        given.append(float(weights.get(None, min(given, default=1.0))) if weights is not None else (rest / total) ** TEMPERATURE)
        sizes.append(rest)
    blocks = [-(-n // block_rows) for n in sizes]
    parts, shares = block_parts(blocks, given)
    source, block, slot = pfair_blocks(blocks, parts)
    filled = np.minimum(block_rows, np.array(sizes, dtype=np.int64)[source] - block * block_rows)
    plan = pa.table({"_source": source, "block": block, "slot": slot, "_start": np.cumsum(filled) - filled})
    placed = spark.createDataFrame(plan)
    bits = [min((RANK_BUCKETS - 1).bit_length(), (n // BUCKET_ROWS).bit_length()) for n in sizes]
    known = spark.createDataFrame(pa.table({"_name": pa.array(names, pa.string()), "_number": pa.array(range(len(names)), pa.int32()), "_share": pa.array(shares[: len(names)], pa.float64()), "_cut": pa.array(bits[: len(names)], pa.int32())}))
    # Small tables go to every executor; others are joined as any table.
    small = lambda df, n: F.broadcast(df) if n <= BROADCAST_ROWS else df
    others = {"_from": ("_number", len(names)), "weight": ("_share", shares[-1]), "_bits": ("_cut", bits[-1])}
    marked = rows.join(small(known, len(names)), F.col("source") == F.col("_name"), "left")
    marked = marked.withColumns({c: F.coalesce(of, F.lit(other)) for c, (of, other) in others.items()}).drop("_name", "_number", "_share", "_cut")
    order = F.xxhash64(F.lit(seed), "id")
    bucket = F.when(F.col("_bits") == 0, 0).otherwise(F.call_function("shiftrightunsigned", order, 64 - F.col("_bits")).cast("int"))
    light = marked.select("id", "_from", "_bits")
    # Hashes in unsigned order, as the buckets are.
    numbered = number_groups(marked, ["_from"], bucket, [order < 0, order, F.col("id")], "_row", counts_from=light, few=len(sizes) * RANK_BUCKETS <= BROADCAST_ROWS)
    numbered = numbered.withColumn("_block", F.expr(f"_row div {block_rows}L"))
    found = numbered.join(small(placed, len(plan)), (F.col("_from") == F.col("_source")) & (F.col("_block") == F.col("block")))
    found = found.withColumn("position", F.col("_start") + F.col("_row") % block_rows)
    return found.drop("_from", "_bits", "_row", "_block", "_source", "_start"), total


def schedule(docs: DataFrame, weights: Mapping[str, float] | None = None, block_rows: int | None = None, seed: int = 17, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """Per row: id, source, weight, block (within its source), slot and position
    (0, 1, 2, ... over all rows)."""
    rows = pick(docs, id=id_col, source=source_col).withColumn("source", F.col("source").cast("string"))
    found = _scheduled(rows, weights, block_rows, seed)
    if found is None:
        empty = rows.select("id", "source", *(F.lit(None).cast(t).alias(c) for c, t in (("weight", "double"), ("block", "long"), ("slot", "long"), ("position", "long"))))
        return empty.limit(0).withColumnRenamed("id", id_col).withColumnRenamed("source", source_col)
    return found[0].select(F.col("id").alias(id_col), F.col("source").alias(source_col), "weight", "block", "slot", "position")


def mixed(docs: DataFrame, weights: Mapping[str, float] | None = None, block_rows: int | None = None, seed: int = 17, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The documents in the order of the schedule, columns as they were: the
    partitions hold successive runs of positions, each run in order.  Every row
    stays, whatever its nulls; an empty table stays empty."""
    names = docs.columns
    at = {c: i for i, c in enumerate(names)}
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    rows = plain.withColumns({"id": F.col(f"c{at[id_col]}"), "source": F.col(f"c{at[source_col]}").cast("string")})
    found = _scheduled(rows, weights, block_rows, seed)
    if found is None:
        return docs
    placed, total = found
    parts = min(total, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    run = F.expr(f"cast(position * {parts}L div {total}L AS int)")
    ordered = placed.repartitionById(parts, run).sortWithinPartitions("position")
    return ordered.select(*(F.col(f"c{i}") for i in range(len(names)))).toDF(*names)
