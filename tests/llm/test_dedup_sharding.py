"""Exact duplicates and shards against plain Python."""

import hashlib
import random
import zlib
from collections import Counter

import pytest

from lexloom.llm import exact_dedup, minhash, sharding

SCHEMA = "doc_id long, text string, KEPT boolean, size int, `length` int"
SPACES = " \t\n\x0b\x0c\r"


def rows():
    rng = random.Random(6)
    base = ["", None, "a b", "ab", "a b", "é\U0001f600 x", "x" * 200, "x" * 128 + "y", "x" * 128 + "z", "long " * 20000]
    out = []
    for i in range(120):
        t = rng.choice(base)
        if t and rng.random() < 0.5:
            t = "".join(c + rng.choice(["", "", " ", "\n", "\x0b"]) for c in t[:300]) + t[300:]
        out.append((i, t, True, 1, 2))
    return out + [(None, "ab", None, None, None), (None, "only null id", None, None, None), (3, out[3][1], True, 1, 2)]


def squeeze(t):
    return "".join(c for c in t or "" if c not in SPACES)


@pytest.mark.parametrize("hash_all", [False, True])
def test_exact_dedup(spark, hash_all):
    data = rows()
    got = exact_dedup.exact_dedup(spark.createDataFrame(data, SCHEMA), hash_all=hash_all).collect()
    groups = {}
    for r in data:
        groups.setdefault(squeeze(r[1]), []).append(r)
    best = {k: min(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0)) for k, g in groups.items()}
    want = sorted(((r[0], best[squeeze(r[1])][0], len(groups[squeeze(r[1])]), r[0] == best[squeeze(r[1])][0] and len(r[1] or "") == len(best[squeeze(r[1])][1] or "")) for r in data), key=str)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got), key=str) == want
    if hash_all:
        assert Counter(r.full_hash for r in got) == Counter(hashlib.sha256(squeeze(r[1]).encode()).hexdigest() for r in data)


def test_only_texts_in_doubt_are_hashed(spark):
    data = [(i, "text %d" % i * (i + 1), True, 1, 2) for i in range(50)] + [(100, "text 3" * 4, True, 1, 2)]
    got = exact_dedup.exact_dedup(spark.createDataFrame(data, SCHEMA)).collect()
    assert {r.doc_id for r in got if r.full_hash} == {3, 100}


def test_keep_one_of_each(spark):
    docs = spark.createDataFrame([(1, "a b", None, 1, 1), (2, "ab", None, 1, 1), (3, "c", None, 1, 1)], SCHEMA)
    kept = exact_dedup.keep_one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]
    empty = docs.limit(0)
    assert exact_dedup.keep_one_of_each(empty).collect() == [] and exact_dedup.exact_dedup(empty).collect() == []


def test_shards(spark):
    data = [(i, None if i % 9 == 0 else "é" * (i % 5), True, 1, 2) for i in range(600)] + [(None, "x", None, None, None), (7, "seven", None, None, None)]
    docs = spark.createDataFrame(data, SCHEMA)
    got = sharding.shard(docs).collect()
    assert len(got) == len(data)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in data)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert set(by) <= set(range(16)) and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert len({r.shard for r in got if r.doc_id == 7}) == 1
    # One more shard takes rows only into itself, and about its share.
    more = {r.doc_id: r.shard for r in sharding.shard(docs, [1.0] * 17).collect()}
    for r in got:
        assert r.grown_shard == more[r.doc_id] and r.grown_shard in (r.shard, 16)
    assert 15 <= sum(r.grown_shard == 16 for r in got) <= 65


def test_weights_and_empty(spark):
    docs = spark.createDataFrame([(i, "", True, 1, 2) for i in range(2000)], SCHEMA)
    n = Counter(r.shard for r in sharding.shard(docs, [3.0, 1.0]).collect())
    assert 1350 < n[0] < 1650
    old = {r.doc_id: r.shard for r in sharding.shard(docs, [1.0, 1.0, 1.0]).collect()}
    new = {r.doc_id: r.shard for r in sharding.shard(docs, [1.0, 1.0, 2.0]).collect()}
    assert all(old[i] == new[i] or new[i] == 2 for i in old)
    assert sharding.shard(docs.limit(0)).collect() == []


def test_stages_are_cleared(spark):
    from lexloom.llm import common

    staged = common.stage(spark.range(3).toDF("a"), "x")
    assert staged.count() == 3 and common._STAGED
    common.clear_stages(spark)
    assert not common._STAGED
    with pytest.raises(Exception, match="FILE_NOT_EXIST|PATH_NOT_FOUND|does not exist"):
        staged.collect()


def test_keep_one_of_each_judges_rows(spark):
    same, near = " ".join("w%d" % i for i in range(60)), " ".join("w%d" % i for i in range(59)) + " x"
    far = " ".join("v%d" % i for i in range(60))
    schema = "doc_id long, text string"
    # A null id whose text is a copy; null ids of texts of their own; an id that
    # a dropped copy and another text share.
    rows = [(1, same), (None, same), (None, far), (None, far + " y"), (7, same), (7, "alone"), (7, None)]
    got = exact_dedup.keep_one_of_each(spark.createDataFrame(rows, schema)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [rows[0], rows[2], rows[3], rows[5], rows[6]]))
    # Both texts of id 7 have it for their least id.
    rows = [(1, same), (7, near), (7, far), (None, near), (7, None)]
    got = minhash.keep_one_of_each(spark.createDataFrame(rows, schema)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [rows[0], *rows[2:]]))
