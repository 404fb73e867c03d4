"""Directed labelled graphs as edge tables: building, comparing, distances."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edges_from_records(records: DataFrame, graph: str, src: str, dst: str, label: str, pos: str) -> DataFrame:
    """One edge for each (graph, source, target), the label written last."""
    got = records.groupBy(graph, src, dst).agg(F.max_by(F.col(label), F.col(pos)).alias("label"), F.max(pos).alias("pos"))
    return got.select(F.col(graph).alias("graph_id"), F.col(src).alias("src"), F.col(dst).alias("dst"), "label", "pos")


def edges_from_arrays(df: DataFrame, graph: str, src: str | Column, dst: str, label: str) -> DataFrame:
    """A source and parallel arrays of targets and labels, last label kept."""
    rows = df.select(F.col(graph).alias("graph_id"), (F.col(src) if isinstance(src, str) else src).alias("src"), F.posexplode(F.arrays_zip(F.col(dst).alias("dst"), F.col(label).alias("label"))).alias("pos", "e"))
    return edges_from_records(rows.select("graph_id", "src", "e.dst", "e.label", "pos"), "graph_id", "src", "dst", "label", "pos")


def nodes(edges: DataFrame) -> DataFrame:
    """Each graph's distinct ends of edges."""
    return edges.select("graph_id", F.explode(F.array("src", "dst")).alias("id")).distinct()


def difference(a: DataFrame, b: DataFrame, labels: bool = True) -> DataFrame:
    """Per graph: nodes and edges of either side alone, and edges of another
    label; their sum is a label-aware distance."""
    na, nb = nodes(a).withColumn("l", F.lit(1)), nodes(b).withColumn("r", F.lit(1))
    n = na.join(nb, ["graph_id", "id"], "full_outer").groupBy("graph_id").agg(F.sum((F.col("l").isNull() | F.col("r").isNull()).cast("long")).alias("node_changes"))
    ea = a.select("graph_id", "src", "dst", F.col("label").alias("la"), F.lit(1).alias("l"))
    eb = b.select("graph_id", "src", "dst", F.col("label").alias("lb"), F.lit(1).alias("r"))
    both = ea.join(eb, ["graph_id", "src", "dst"], "full_outer")
    alone = (F.col("l").isNull() | F.col("r").isNull()).cast("long")
    relabelled = F.when(F.col("l").isNotNull() & F.col("r").isNotNull() & ~F.col("la").eqNullSafe(F.col("lb")), 1).otherwise(0).cast("long")
    e = both.groupBy("graph_id").agg(F.sum(alone).alias("edge_changes"), F.sum(relabelled).alias("label_changes"))
    out = n.join(e, "graph_id", "full_outer").na.fill(0)
    return out.withColumn("distance", F.col("node_changes") + F.col("edge_changes") + (F.col("label_changes") if labels else F.lit(0)))


Edge = tuple[str, str, str | None]


def _numbered(edges: Sequence[Edge], labels: bool) -> tuple[int, tuple[tuple[int, int, str | None], ...]]:
    """Nodes as numbers by their degrees, so that many graphs of one shape are
    told once; the last label of a repeated edge."""
    kept = {(s, d): x if labels else None for s, d, x in edges}
    names = sorted({v for e in kept for v in e}, key=lambda v: (-sum(v == s for s, _ in kept), -sum(v == d for _, d in kept), v))
    at = {v: i for i, v in enumerate(names)}
    return len(names), tuple(sorted(((at[s], at[d], x) for (s, d), x in kept.items()), key=str))


@lru_cache(maxsize=200_000)
def _most_saved(na: int, ea: tuple, nb: int, eb: tuple, labels: bool) -> int:
    """The most that edges in common can save, over all ways to give each node
    of the first graph, the smaller, a node of the second: two for an edge that
    stays, one for an edge that only changes its label."""
    ga, gb = {(s, d): x for s, d, x in ea}, {(s, d): x for s, d, x in eb}
    # Nodes with edges to those before them first.
    order: list[int] = []
    while len(order) < na:
        order.append(max((v for v in range(na) if v not in order), key=lambda v: (sum((v == s and (d in order or d == v)) or (v == d and s in order) for s, d in ga), sum(v in e for e in ga), -v)))
    place = {v: i for i, v in enumerate(order)}
    decided = [[e for e in ga if max(place[e[0]], place[e[1]]) == i] for i in range(na)]
    after = [sum(len(x) for x in decided[i + 1 :]) for i in range(na)]
    # Nodes of one kind can take each other's place.
    kinds = [(frozenset((d, x) for (s, d), x in gb.items() if s == w), frozenset((s, x) for (s, d), x in gb.items() if d == w)) for w in range(nb)]
    worth = lambda e, f: 0 if f not in gb else 2 if not labels or ga[e] == gb[f] else 1
    most, best = 2 * min(len(ga), len(gb)), 0

    def search(i: int, given: dict[int, int], free: frozenset[int], saved: int) -> None:
        nonlocal best
        best = max(best, saved)
        if i == na or best == most:
            return
        u, tried = order[i], {}
        for w in free:
            if kinds[w] not in tried:
                to = given | {u: w}
                tried[kinds[w]] = (sum(worth(e, (to[e[0]], to[e[1]])) for e in decided[i]), w)
        for gain, w in sorted(tried.values(), reverse=True):
            rest = free - {w}
            if saved + gain + 2 * min(after[i], sum(s in rest or d in rest for s, d in gb)) > best:
                search(i + 1, given | {u: w}, rest, saved + gain)

    search(0, {}, frozenset(range(nb)), 0)
    return best


def edit_distance(one: Sequence[Edge], two: Sequence[Edge], labels: bool = False, most: int | None = None) -> int | None:
    """The least number of node and edge insertions and deletions (and label
    changes) that turn one graph into the other, node names aside.

    To give a node away never costs more than to delete it and insert another,
    so every node of the smaller graph is given one of the larger; what is left
    is the most that edges in common save, found by branch and bound.  Time is
    exponential in the nodes; over ``most`` of them, if given, the result is
    None."""
    (na, ea), (nb, eb) = _numbered(one, labels), _numbered(two, labels)
    if most is not None and max(na, nb) > most:
        return None
    if na > nb:
        na, ea, nb, eb = nb, eb, na, ea
    return nb - na + len(ea) + len(eb) - _most_saved(na, ea, nb, eb, labels)


def exact_distances(a: DataFrame, b: DataFrame, labels: bool = False, most: int | None = None) -> DataFrame:
    """Per graph the exact edit distance; a graph that one side lacks is empty
    there.  Null where a side is over ``most`` nodes, if given; edges past what
    they can have aren't gathered then, such a graph being known by its count
    alone."""

    def gathered(e: DataFrame, name: str) -> DataFrame:
        rows = e
        if most is not None:
            rows = e.join(e.groupBy("graph_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") <= most * most), "graph_id")
        rows = rows.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("src", "dst", "label"))).alias(name))
        return e.select("graph_id").distinct().join(rows, "graph_id", "left").withColumn(f"{name}_there", F.lit(True))

    both = gathered(a, "one").join(gathered(b, "two"), "graph_id", "full_outer")

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                sides = [[] if not r[f"{n}_there"] else r[n] for n in ("one", "two")]
                edges = [None if s is None else [(str(e["src"]), str(e["dst"]), e["label"]) for e in s] for s in sides]
                out.append(None if None in edges else edit_distance(edges[0], edges[1], labels, most))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], names=["graph_id", "distance"])

    kind = dict(both.dtypes)["graph_id"]
    spark = both.sparkSession
    # Small rows, long work: as many parts as there are cores, at least.
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = both.select("graph_id", "one", "one_there", "two", "two_there").repartition(parts, "graph_id")
    return dealt.mapInArrow(run, f"graph_id {kind}, distance long")
