import random

import numpy as np
import pytest

from lexloom.llm.tokens import ChunkEncoder

ODD = ["", " ", "a", " a", "a ", "a  b", "a\n b", "a \nb", "x\n\n  y", "it's I'LL  don't", "¶ a ¶", "a b  c", "café é ́x", "\x1ca b\x1d c", "<|endoftext|> b", "A B\tc\r\nD", "123 45,6", "\U0001f600 你好 w", "Ġa Ġ", "e ́ f", "ΣΣ xΣ"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_equal_to_whole_text_encoding(name):
    rng = random.Random(5)
    pool = ODD + ["the", "of.\nThe", "tion,", "$$$", "\n", "  ", "\t", "Zürich", "¶", "x" * 90, "Tion", "TION.", "été,", "Été.", "a.b,", "..", ",", "x..", "Ab,"]
    texts = ODD + ["".join(rng.choice(pool) + rng.choice([" ", " ", " ", "", "\n"]) for _ in range(rng.randint(1, 30))) for _ in range(400)]
    enc = ChunkEncoder(name)
    for lo in (0, 0, 0):  # the second time from the memo
        got = []
        for i in range(lo, len(texts), 37):
            got += enc.encode_many(texts[i : i + 37])
        for t, g in zip(texts, got):
            want = enc.tok.encode(t, add_special_tokens=False).ids
            assert np.frombuffer(g, dtype="<u4").tolist() == want, repr(t)
    assert enc.encode_many([None, ""]) == [b"", b""]
