"""Token files and packing against plain encoding, on odd tables."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from lexloom.llm import packing, token_files
from lexloom.llm.tokens import resolve

SCHEMA = "doc_id long, text string, IDS string, `offset` int"


def table(spark):
    rng = random.Random(3)
    words = ["the", "Of", "tion,", "\n", "ééa", "$$", "naïve"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(40)]
    rows = [(i * 7 % 41, t) for i, t in enumerate(texts)] + [(100, None), (101, ""), (102, "the of " * 6000), (5, texts[0]), (None, "lost id"), (103, "a  b \n c")]
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA), rows


def ids_of(tok, text, end):
    return [*tok.encode(text or "", add_special_tokens=False).ids, end]


def test_token_files_round_trip(spark):
    docs, rows = table(spark)
    out = token_files.write_token_files(docs, parts=3)
    got = token_files.read_token_files(spark, out).collect()
    tok = Tokenizer.from_file(resolve(token_files.TOKENIZER))
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.ids) for r in got) == sorted((i is not None, i or 0, ids_of(tok, t, 0)) for i, t in rows)
    by_start = sorted(got, key=lambda r: r.start)
    assert [r.start for r in by_start] == np.cumsum([0, *(r.n_tokens for r in by_start)])[:-1].tolist()
    ids = [-1 if r.doc_id is None else r.doc_id for r in by_start]
    assert ids == sorted(ids)
    crcs = token_files.read_token_files(spark, out, token_files.crc_of, "long", "c").collect()
    assert {(r.doc_id, r.c) for r in crcs} == {(i, zlib.crc32(np.array(ids_of(tok, t, 0), "<u4").tobytes())) for i, t in rows}


def test_token_files_empty(spark):
    out = token_files.write_token_files(spark.createDataFrame([], SCHEMA))
    assert token_files.read_token_files(spark, out).collect() == []
    with pytest.raises(ValueError):
        token_files.local_path("s3://bucket/x")


@pytest.mark.parametrize("capacity,group_tokens", [(4096, 1 << 20), (64, 1000)])
def test_packing_is_whole_and_tight(spark, capacity, group_tokens):
    docs, rows = table(spark)
    got = packing.pack(docs, capacity=capacity, group_tokens=group_tokens, with_ids=True).collect()
    tok = Tokenizer.from_file(resolve(packing.TOKENIZER))
    pieces = {}
    for r in got:
        assert 0 < r.length <= capacity and len(r.ids) == 4 * r.length and zlib.crc32(bytes(r.ids)) == r.ids_crc32
        pieces.setdefault((r.doc_id, r.doc_tokens, r.start), []).append(np.frombuffer(r.ids, "<u4").tolist())
    want = {}
    for i, t in rows:
        ids = ids_of(tok, t, 2)
        for a in range(0, len(ids), capacity):
            want.setdefault((i, len(ids), a), []).append(ids[a : a + capacity])
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
    by_seq = {}
    for r in got:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity


def test_sequences_hold_the_ids(spark):
    docs, _ = table(spark)
    packed = packing.pack(docs, with_ids=True)
    rows = packed.collect()
    whole = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    for r in rows:
        assert whole[r.sequence_id][r.offset : r.offset + r.length] == np.frombuffer(r.ids, "<u4").tolist()


def test_packing_empty(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA)).collect() == []


def test_differencing_balances():
    rng = random.Random(1)
    sizes = [rng.randint(1, 4000) for _ in range(500)]
    found = packing.pack_sizes(sizes)
    assert sorted(i for w in found for i in w) == list(range(500))
    assert max(sum(sizes[i] for i in w) for w in found) <= 4096
    assert len(found) <= 1.05 * sum(sizes) / 4096 + 2
    assert packing.pack_sizes([4095] * 7) and packing.pack_sizes([]) == [] and len(packing.pack_sizes([4000, 4000])) == 2
