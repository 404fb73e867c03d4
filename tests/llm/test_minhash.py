"""Near duplicates against brute force."""

import random
from itertools import combinations

import numpy as np
import pytest

from lexloom.llm import minhash, shingles
from lexloom.llm.components import components
from lexloom.llm.shingles import Shingler

SCHEMA = "doc_id long, text string, COMPONENT_ID string, digest int"


def brute_set(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows):
    sets = {i: brute_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocab = ["w%d" % i for i in range(400)] + ["É", "ß", "The"]
    texts = []
    for _ in range(n):
        words = [rng.choice(vocab) for _ in range(rng.choice([3, 8, 40, 150, 700]))]
        texts.append(" ".join(words))
        for _ in range(rng.choice([0, 0, 1, 3, 12])):
            copy = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            texts.append(rng.choice([" ", "\n", "\t "]).join(copy))
    texts += ["", " \n ", "a", "A", "a b", "x  y\tz", texts[0].upper()]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("block,hashes", [(minhash.BLOCK, minhash.BLOCK_HASHES), (4, minhash.BLOCK_HASHES), (minhash.BLOCK, 300)])
def test_equal_to_brute_force(spark, monkeypatch, block, hashes):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "BLOCK_HASHES", hashes)
    rows = corpus(11)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs).collect()}
    assert got == brute(rows)


def test_odd_rows(spark):
    long = " ".join(str(i % 977) + "q" for i in range(30000))
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (9, "A B c d e f"), (4, None), (5, ""), (6, long), (7, long + " end")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    got = sorted((tuple(r) for r in minhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(None, 2, None, True), (3, 2, 3, True), (3, 2, 3, True), (9, 2, 3, False), (4, 0, 4, True), (5, 0, 5, True), (6, 977, 6, True), (7, 978, 6, False)], key=str)
    kept = minhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(((r[0], r[1]) for r in kept.collect()), key=str) == sorted([(i, t) for i, t in rows if i not in (7, 9)], key=str)
    empty = spark.createDataFrame([], SCHEMA)
    assert minhash.near_duplicates(empty).collect() == [] and minhash.keep_one_of_each(empty).collect() == []


def test_shingles_match_words():
    texts = ["a b c d e", "a b c d e f", "A  B\tC\nD\x0bE", "b a c d e", "one two", "two one", "", "x"]
    sets = [frozenset(s.tolist()) for s in Shingler().sets(texts)]
    assert [len(s) for s in sets] == [1, 2, 1, 1, 1, 1, 0, 1]
    assert sets[0] == sets[2] and sets[0] < sets[1] and sets[0] != sets[3] and sets[4] != sets[5]


def test_bit_estimate(spark):
    rng = np.random.default_rng(2)
    both = rng.integers(0, 2**64, 900, dtype=np.uint64)
    rows = []
    for k in (0, 300, 600, 900):
        other = np.concatenate([both[:k], rng.integers(0, 2**64, 900 - k, dtype=np.uint64)])
        a, b = (minhash.pack_bits(minhash.minima(np.sort(s))).tolist() for s in (both, other))
        rows.append((k / (1800 - k), *a, *b))
    df = spark.createDataFrame(rows, "j double, " + ", ".join(f"l_{p} long" for p in minhash.PACKED) + ", " + ", ".join(f"r_{p} long" for p in minhash.PACKED))
    for r in df.select("j", minhash.estimate("l_", "r_").alias("e")).collect():
        assert abs(r.j - r.e) < 0.25


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {(r.a, r.root) for r in components(edges).collect()}
    assert got == {(i, 0) for i in range(1, 41)} | {(101, 100)}


def test_long_text_piece_by_piece(monkeypatch):
    text = "\t".join("word%d" % (i % 300) for i in range(4000)) + " " + "x" * 5000 + " é end"
    whole = Shingler().sets([text])[0]
    monkeypatch.setattr(shingles, "PIECE", 700)
    assert (Shingler().sets([text])[0] == whole).all()


def test_a_group_wider_than_its_centre(spark, monkeypatch):
    """Near copies of one text, and a chain that leads away from it: classes that
    the centre doesn't reach must still meet those of other blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 5)
    rng = random.Random(9)
    words = ["w%d" % i for i in range(300)]
    texts = []
    for _ in range(40):
        copy = list(words)
        copy[rng.randrange(300)] = "edit%d" % rng.randrange(10**6)
        texts.append(" ".join(copy))
    chain = list(words)
    for k in range(25):
        chain[10 * k : 10 * k + 10] = ["c%d-%d" % (k, j) for j in range(10)]
        texts.append(" ".join(chain))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)
