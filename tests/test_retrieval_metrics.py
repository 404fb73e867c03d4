import random
import time
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.functions.text import tokenize
from lexloom.operators import backends, graphs, metrics, retrieval
from lexloom.streaming.incremental import apply_incrementally, watch_parquet


def vectors(spark, n=60, width=8):
    m = np.random.default_rng(3).normal(size=(n, width))
    return m, spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], "vec_id long, embedding array<double>")


@pytest.mark.parametrize("held", [0, 64_000_000])
def test_nearest_equals_brute_force(spark, monkeypatch, held):
    monkeypatch.setattr(retrieval, "QUERY_BYTES", held)
    monkeypatch.setattr(retrieval, "SLICE", 7)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 4)
    monkeypatch.setattr(retrieval, "VECTOR_BLOCK", 16)
    m, df = vectors(spark)
    q = df.where("vec_id < 10").withColumnRenamed("vec_id", "query_id")
    got = {}
    for r in retrieval.nearest(q, df, 5).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    for i in range(10):
        assert [got[i][k] for k in range(1, 6)] == np.argsort(-(unit @ unit[i]))[:5].tolist()
    far = retrieval.nearest(q, df, 60, least=0.5, skip_self=True).collect()
    assert {(r.query_id, r.vec_id) for r in far} == {(i, j) for i in range(10) for j in range(60) if i != j and unit[i] @ unit[j] >= 0.5}


def test_nearest_odd_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [2.0, 0.0])], "vec_id long, embedding array<double>")
    got = retrieval.nearest(df.withColumnRenamed("vec_id", "query_id"), df, 5).collect()
    assert {(r.query_id, r.vec_id) for r in got} == {(1, 1), (1, 4), (4, 1), (4, 4)}
    assert retrieval.nearest(df.limit(0).withColumnRenamed("vec_id", "query_id"), df, 5).count() == 0


def test_bm25_and_fusion(spark):
    docs = spark.createDataFrame([(1, "a a b"), (2, "b c"), (3, None), (4, "c c c")], "doc_id long, text string")
    q = spark.createDataFrame([(1, ["a"]), (2, ["c", "zz"])], "query_id long, terms array<string>")
    got = {(r.query_id, r["rank"]): r.doc_id for r in retrieval.bm25(docs, q, 5).collect()}
    assert got == {(1, 1): 1, (2, 1): 4, (2, 2): 2}
    a = spark.createDataFrame([(1, 7, 1), (1, 8, 2)], "query_id long, vec_id long, rank int")
    fused = {r.vec_id: r.score for r in retrieval.fuse([(a, 0.4), (a.where("vec_id = 8"), 0.6)], "query_id", "vec_id").collect()}
    assert abs(fused[7] - 0.4 / 61) < 1e-12 and abs(fused[8] - 1.0 / 62) < 1e-12
    texts = spark.createDataFrame([(7, "x"), (8, "y")], "vec_id long, t string")
    assert retrieval.stuff_prompt(a, texts, F.concat(F.lit("- "), "t"), "query_id", "vec_id", F.col("rank"), "\n").collect()[0].context == "- x\n- y"


def test_entity_scores(spark):
    gold = spark.createDataFrame([(1, 0, 3, "G"), (1, 5, 8, "C")], "d long, s int, e int, l string")
    pred = spark.createDataFrame([(1, 0, 3, "G"), (1, 5, 9, "C"), (1, 10, 11, "G")], "d long, s int, e int, l string")
    got = {r.l: (r.tp, r.fp, r.fn, round(r.f1, 4)) for r in metrics.entity_scores(pred, gold, ["d", "s", "e"], "l").collect()}
    assert got == {"G": (1, 1, 0, 0.6667), "C": (0, 1, 1, 0.0), None: (1, 2, 1, 0.4)}


def test_answer_metrics(spark):
    v = spark.createDataFrame([(1, 1, True), (1, 2, False), (1, 3, True), (2, 1, False), (3, 1, None)], "s long, r int, v boolean")
    cp = {r.s: round(r.context_precision, 4) for r in metrics.context_precision(v, "s", "r", "v").collect()}
    assert cp == {1: round((1 + 2 / 3) / 2, 4), 2: 0.0, 3: 0.0}
    assert {r.s: round(r.f, 4) for r in metrics.share_supported(v, "s", "v", "f").collect()} == {1: 0.6667, 2: 0.0, 3: 0.0}


def test_rouge(spark):
    pairs = spark.createDataFrame([(1, "the cat the", "the cat sat"), (2, "", "x"), (3, None, None)], "k long, a string, b string")
    got = {r.k: (r.shared, round(r.f1, 4)) for r in metrics.rouge_n(pairs, "k", "a", "b", 1).collect()}
    assert got == {1: (2, 0.6667), 2: (0, 0.0), 3: (0, 0.0)}
    long = pairs.select("k", metrics.rouge_l(tokenize(F.coalesce("a", F.lit(""))), tokenize(F.coalesce("b", F.lit("")))).alias("r"))
    assert {r.k: round(r.r, 4) for r in long.collect()} == {1: 0.6667, 2: 0.0, 3: 0.0}


def star(spark, drop=0, relabel=None):
    return spark.createDataFrame([("g", "s", f"t{i}", relabel if relabel and i == 0 else "X", i) for i in range(drop, 8)], "graph_id string, src string, dst string, label string, pos int")


def test_graph_distances(spark):
    a = star(spark)
    assert graphs.exact_distances(a, a).collect()[0].distance == 0
    assert graphs.exact_distances(a, star(spark, drop=1)).collect()[0].distance == 2
    assert graphs.exact_distances(a, star(spark, relabel="Y")).collect()[0].distance == 0
    assert graphs.exact_distances(a, star(spark, relabel="Y"), labels=True).collect()[0].distance == 1
    assert graphs.exact_distances(a, a, most=4).collect()[0].distance is None
    d = graphs.difference(a, star(spark, drop=1)).collect()[0]
    assert (d.node_changes, d.edge_changes, d.label_changes, d.distance) == (1, 1, 0, 2)
    arrays = spark.createDataFrame([("g", "s", ["a", "b", "a"], ["X", "Y", "Z"])], "g string, s string, d array<string>, l array<string>")
    assert {(r.dst, r.label) for r in graphs.edges_from_arrays(arrays, "g", "s", "d", "l").collect()} == {("a", "Z"), ("b", "Y")}


def test_backends(spark):
    class Brittle:
        name = "brittle"

        def generate(self, prompts):
            if any("bad" in p for p in prompts):
                raise RuntimeError("no")
            return [p.upper() for p in prompts]

    def relations():
        return backends.OfflineModel("relations")

    df = spark.createDataFrame([(1, "ok"), (2, "bad"), (3, "fine")], "k long, p string")
    got = {r.k: (r.reply, r.error) for r in backends.generate(df, "p", Brittle).collect()}
    assert got == {1: ("OK", None), 2: (None, "RuntimeError: no"), 3: ("FINE", None)}
    texts = spark.createDataFrame([(1, "we gave Aspirin to TP53 cells"), (2, None)], "k long, t string")
    found = {(r.surface, r.label) for r in backends.tag(texts, "k", "t", backends.OfflineTagger, chunk=2).collect()}
    assert ("TP53", "GENE") in found
    vec = backends.embed(texts, "k", "t", backends.OfflineEmbedder).collect()
    assert {len(r.embedding) for r in vec} == {64}
    asked = spark.createDataFrame([(1, "Aspirin (CHEMICAL); TP53 (GENE)")], "k long, p string")
    rel = backends.extract(asked, "p", relations, "relations array<struct<head:string,tail:string,predicate:string>>").collect()[0].parsed
    assert tuple(rel.relations[0]) == ("Aspirin", "TP53", "INHIBITOR")
    calls = spark.createDataFrame([(1, 0, 2), (1, 1, 4)], "k long, c int, v int")
    assert backends.last_reply(calls, "k", "c", "v").collect()[0].v == 4


def test_incremental(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    spark.createDataFrame([(1, "a"), (2, "b")], "k long, t string").write.parquet(src)
    schema = spark.read.parquet(src).schema
    for _ in range(2):
        apply_incrementally(watch_parquet(spark, src, schema), lambda b: b.withColumn("n", F.length("t")), out, ck, "k").awaitTermination()
        spark.createDataFrame([(2, "b"), (3, "ccc")], "k long, t string").write.mode("append").parquet(src)
    assert sorted((r.k, r.n) for r in spark.read.parquet(out).collect()) == [(1, 1), (2, 1), (3, 3)]


def test_index_recall_and_storage(spark, tmp_path):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    m = centres[rng.integers(0, 12, 900)] + 0.4 * rng.normal(size=(900, 16))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)] + [(900, None), (901, [0.0] * 16)], "vec_id long, embedding array<double>")
    q = df.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    built = retrieval.build_index(df, f"{tmp_path}/index", lists=24, sample=300)
    assert built.table.count() == 900
    index = retrieval.open_index(spark, f"{tmp_path}/index")
    exact = {(r.query_id, r.vec_id) for r in retrieval.nearest(q, df, 10).collect()}
    some = {(r.query_id, r.vec_id) for r in retrieval.probe(index, q, 10, n_lists=8).collect()}
    assert len(exact & some) / len(exact) >= 0.9
    assert {(r.query_id, r.vec_id) for r in retrieval.probe(index, q, 10, n_lists=24).collect()} == exact
    none = retrieval.build_index(df.limit(0), f"{tmp_path}/none")
    assert retrieval.probe(none, q, 3).collect() == []


def brute_distance(one, two, labels):
    """All ways to give nodes away, or to delete them."""
    ga, gb = {(s, d): x for s, d, x in one}, {(s, d): x for s, d, x in two}
    va, vb = sorted({v for e in ga for v in e}), sorted({v for e in gb for v in e})
    best = 10**9
    for to in permutations([*vb, *[None] * len(va)], len(va)):
        m = dict(zip(va, to))
        kept = {w for w in to if w is not None}
        cost = to.count(None) + len(vb) - len(kept)
        met = {(m[s], m[d]): x for (s, d), x in ga.items() if m[s] is not None and m[d] is not None}
        cost += len(ga) - len(met) + sum(e not in gb for e in met) + sum(e not in met for e in gb)
        cost += sum(labels and e in gb and gb[e] != x for e, x in met.items())
        best = min(best, cost)
    return best


@pytest.mark.parametrize("labels", [False, True])
def test_edit_distance_equals_brute_force(labels):
    rng = random.Random(3)
    for _ in range(60):
        graph = lambda names: [(rng.choice(names), rng.choice(names), rng.choice("XY")) for _ in range(rng.randint(0, 5))]
        a, b = graph("abcd"), graph("efg")
        assert graphs.edit_distance(a, b, labels) == graphs.edit_distance(b, a, labels) == brute_distance(a, b, labels), (a, b)


def test_edit_distance_of_larger_graphs():
    ring = lambda n, p: [(f"{p}{i}", f"{p}{(i + 1) % n}", "X") for i in range(n)]
    assert graphs.edit_distance(ring(12, "a"), ring(12, "b")) == 0
    assert graphs.edit_distance(ring(12, "a"), ring(12, "b")[:-1]) == 1
    assert graphs.edit_distance(ring(12, "a"), ring(12, "b"), most=9) is None


def test_calls_are_halved_timed_and_tried_again():
    seen = []

    def picky(items):
        seen.append(len(items))
        if "bad" in items:
            raise ValueError("bad one")
        return [x.upper() for x in items]

    got = backends._each(picky, ["a", "b", "bad", "c"])
    assert [x for x, _ in got] == ["A", "B", None, "C"] and "bad one" in got[2][1] and seen == [4, 2, 2, 1, 1]
    tries = []

    def shaky(items):
        tries.append(1)
        if len(tries) < 3:
            raise OSError("busy")
        return items

    assert backends._each(shaky, ["x"], backends.Patience(retries=3, wait=0.01)) == [("x", None)] and len(tries) == 3
    slow = backends._each(lambda items: time.sleep(1) or items, ["x"], backends.Patience(timeout=0.05))
    assert slow[0][0] is None and "Timeout" in slow[0][1]
    assert backends._each(lambda items: [], ["x"])[0][0] is None and backends._each(picky, []) == []


def test_labels_asked_for_and_overlaps(spark):
    class Nested:
        name = "nested"

        def tag(self, texts):
            return [[(0, 8, "GENE", 0.7), (0, 4, "CHEMICAL", 0.9), (9, 12, "OTHER", 0.8)] for _ in texts]

        def tag_labels(self, texts, labels):
            return [[e for e in own if e[2] in labels] for own in self.tag(texts)]

    df = spark.createDataFrame([(1, "abcd efg hij"), (2, None)], "k long, t string").where("t IS NOT NULL")
    found = lambda **how: {(r.label, r.surface) for r in backends.tag(df, "k", "t", Nested, **how).collect()}
    assert found() == {("CHEMICAL", "abcd"), ("OTHER", "hij")}
    assert found(flat=False) == {("CHEMICAL", "abcd"), ("OTHER", "hij"), ("GENE", "abcd efg")}
    assert found(labels=["GENE"]) == {("GENE", "abcd efg")}
    offline = {r.label for r in backends.tag(df, "k", "t", backends.OfflineTagger, labels=["GENE"]).collect()}
    assert offline <= {"GENE"}
