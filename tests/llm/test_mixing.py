import random

import numpy as np

from lexloom.llm import mixing

SCHEMA = "doc_id long, source string, text string, POSITION int, slot string"


def test_pfair_deviation():
    for weights in ([1, 1, 1], [0.5, 0.3, 0.2], [0.9, 0.05, 0.03, 0.02], [1] * 37, [100, 1]):
        q = mixing.quotas(weights)
        period = sum(q)
        assert period == mixing.PERIOD
        had = np.zeros(len(q))
        owner = {t: i for i, own in enumerate(mixing.pfair_period(q)) for t in own}
        assert len(owner) == period
        for t in range(period):
            had[owner[t]] += 1
            assert np.all(np.abs(had - np.array(q) * (t + 1) / period) < 1)


def brute(rows, weights, block):
    """Step through the slots one by one."""
    names = sorted(rows, key=lambda s: (-len(rows[s]), s))
    q = mixing.quotas([weights[s] for s in names], max(mixing.PERIOD, 4 * len(names)))
    owner = {t: i for i, own in enumerate(mixing.pfair_period(q)) for t in own}
    left, order, t = {s: len(rows[s]) for s in names}, [], 0
    while any(left.values()):
        s = names[owner[t % sum(q)]]
        take = min(block, left[s])
        order += [s] * take
        left[s] -= take
        t += 1
    return order


def table(spark, sizes):
    rows = [(i, s, "t%d" % i, 0, "x") for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA), rows


def test_schedule_matches_stepping(spark):
    sizes = {"hot": 900, "b": 200, "c": 37, "d": 1}
    docs, rows = table(spark, sizes)
    weights = {"hot": 0.4, "b": 0.3, "c": 0.2, "d": 0.1}
    got = sorted(mixing.schedule(docs, weights, block_rows=8).collect(), key=lambda r: r.position)
    assert [r.position for r in got] == list(range(len(rows)))
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    by = {s: [r for r in rows if r[1] == s] for s in sizes}
    assert [r.source for r in got] == brute(by, weights, 8)


def test_mixed_keeps_rows_and_order(spark):
    docs, rows = table(spark, {"a": 300, "b": 100})
    at = {r.doc_id: r.position for r in mixing.schedule(docs).collect()}
    got = mixing.mixed(docs)
    assert got.columns == docs.columns
    out = [tuple(r) for r in got.collect()]
    assert sorted(out) == sorted(rows)
    assert [at[r[0]] for r in out] == list(range(len(rows)))


def test_odd_tables(spark):
    rows = [(None, None, None, 1, "x"), (None, None, None, 1, "x"), (1, "a", "", 1, "x"), (1, "a", "", 1, "x"), (2, "zz", None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r.position for r in mixing.schedule(docs, {"a": 1.0}).collect()) == list(range(5))
    assert sorted(map(str, mixing.mixed(docs).collect())) == sorted(map(str, docs.collect()))
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.schedule(empty).collect() == [] and mixing.mixed(empty).collect() == []


def test_true_weights_over_a_long_run():
    # 20 equal sources, no multiple of 1/1024, and one far below it.
    for weights in ([0.05] * 20, [0.7, 0.3 - 1e-5, 1e-5]):
        blocks = [int(w * 200_000) for w in weights]
        parts, true = mixing.block_parts(blocks, weights)
        assert np.allclose(true, weights, rtol=1e-12)
        source, block, slot = mixing.pfair_blocks(blocks, parts)
        assert len(source) == sum(blocks) and np.all(np.diff(slot) > 0)
        for i, w in enumerate(true):
            own, at = block[source == i], slot[source == i]
            assert own.tolist() == list(range(blocks[i]))
            assert np.all(at >= np.floor(own / w - 1e-6)) and np.all(at < np.ceil((own + 1) / w + 1e-6))


def test_weight_column_is_true(spark):
    docs, rows = table(spark, {"s%02d" % i: 10 for i in range(20)})
    assert {round(r.weight, 12) for r in mixing.schedule(docs).collect()} == {0.05}


def test_extreme_weights_take_no_more_steps():
    source, block, slot = mixing.pfair_blocks([1000, 1000], mixing.exact_parts([1.0, 1e-9]))
    assert len(slot) == 2000 and slot[-1] > 990 * 10**9
    assert mixing.pfair_blocks([2, 3], [1, 0])[0].tolist() == [0, 0, 1, 1, 1]


def test_every_source_has_its_own_weight(spark):
    sizes = {"s%03d" % i: 3 for i in range(300)} | {"rare": 1}
    docs, rows = table(spark, sizes)
    got = mixing.schedule(docs, block_rows=1).collect()
    assert sorted(r.position for r in got) == list(range(len(rows)))
    assert len({r.slot for r in got}) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r.block)
    assert {s: sorted(b) for s, b in by.items()} == {s: list(range(n)) for s, n in sizes.items()}
    # A named source counts, however few rows it has.
    got = mixing.schedule(docs, {"rare": 0.75, "s000": 0.2, None: 0.05}, block_rows=1).collect()
    assert {(r.source if r.source in ("rare", "s000") else None, round(r.weight, 12)) for r in got} == {("rare", 0.75), ("s000", 0.2), (None, 0.05)}
    assert [r.slot for r in got if r.source == "rare"] == [0]
