"""Chunk-memoised encoding with the ``tokenizers`` library, shared by the
token-file writer and the packer.

Natural text repeats its words, so each distinct chunk is handed to the
library once per worker and its ids are kept as packed bytes; the ids of many
documents are then gathered chunk by chunk.  Chunks are cut only where the
tokenizer's own pre-tokeniser is certain to cut: at blanks for byte-level
families, at white space for those that drop it, so the ids equal
those of encoding the whole text (``tests/llm/test_tokens.py`` holds this
against the library on adversarial texts).
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import trim

#: Chunks kept per worker, the first met; bounds its memory at some 160 MB.
MEMO_CHUNKS = 1_000_000
#: Longer chunks are encoded but not kept.
MEMO_CHARS = 64
#: Chunks joined into one call of the library.
JOINED = 2_000
#: Stands between chunks in a joined call where blanks leave no trace in the ids.
MARK = "¶"


def resolve(tokenizer: str) -> str:
    """A tokenizer file: an existing path as it is, else a name that the
    installed ``public_tokenizers`` package knows."""
    if os.path.exists(tokenizer):
        return tokenizer
    import public_tokenizers

    return public_tokenizers.path(tokenizer)


class ChunkEncoder:
    """Text to ids as packed little-endian unsigned integers.

    Two families are told apart by trial: byte-level ones encode the blank
    before a word as part of the word; the others drop white space.
    """

    def __init__(self, tokenizer: str, dtype: str = "<u4", memo_chunks: int = MEMO_CHUNKS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(resolve(tokenizer))
        self.tok.encode_special_tokens = True
        self.dtype = np.dtype(dtype)
        self.memo: dict[str, bytes] = {}
        self.memo_chunks = memo_chunks
        self.keeps_space = self._ids(" b") != self._ids("b")
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.blank_first = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.blank_first[[i for t, i in vocab.items() if t.startswith("Ġ")]] = True
        self.word_last = np.zeros(len(self.blank_first), dtype=bool)
        self.word_last[[i for t, i in vocab.items() if t.endswith("</w>")]] = not self.keeps_space
        self.folds_case = self._ids("AB Cd") == self._ids("ab cd")
        self.tails = {t: self._pack(self._ids(t)) for t in (".", ",") if self._ids(f"ab{t}") == [*self._ids("ab"), *self._ids(t)]}
        mark = self._ids(MARK)
        self.mark = mark[0] if len(mark) == 1 else None

    def _ids(self, text: str) -> list[int]:
        return self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _pack(self, ids) -> bytes:
        return np.array(ids, dtype=self.dtype).tobytes()

    def _fits(self, chunk: str) -> bool:
        """Whether a chunk may be encoded apart from its neighbours."""
        return not self.keeps_space or bool(chunk) and not chunk[0].isspace() and not chunk[-1].isspace()

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Each chunk's ids, a blank before each where blanks count.  Many go
        into one call; where they part again shows in the ids: a token that
        starts with the blank, one that ends a word, or a mark put between."""
        lead = " " if self.keeps_space else ""
        words = [c for c in chunks if c.isalpha()] if self.word_last.any() else []
        if words and len(words) < len(chunks):
            ids = dict(zip(words, self._encode_chunks(words)))
            rest = [c for c in chunks if c not in ids]
            ids.update(zip(rest, self._encode_chunks(rest)))
            return [ids[c] for c in chunks]
        out: list[bytes] = []
        for lo in range(0, len(chunks), JOINED):
            part = chunks[lo : lo + JOINED]
            cuts = None
            if self.keeps_space:
                flat = np.array(self._ids(lead + " ".join(part)), dtype=self.dtype)
                starts = np.flatnonzero(self.blank_first[flat])
                if len(starts) == len(part) and starts[0] == 0:
                    cuts = [*starts.tolist(), len(flat)]
            elif words:
                flat = np.array(self._ids(" ".join(part)), dtype=self.dtype)
                ends = np.flatnonzero(self.word_last[flat]) + 1
                if len(ends) == len(part) and ends[-1] == len(flat):
                    cuts = [0, *ends.tolist()]
            elif self.mark is not None and not any(MARK in c for c in part):
                flat = np.array(self._ids("".join(f"{c} {MARK} " for c in part)), dtype=self.dtype)
                marks = flat == self.mark
                if marks.sum() == len(part):
                    ends = np.flatnonzero(marks) - np.arange(len(part))
                    flat, cuts = flat[~marks], [0, *ends.tolist()]
            if cuts is None:
                out += [self._pack(e.ids) for e in self.tok.encode_batch_fast([lead + c for c in part], add_special_tokens=False)]
            else:
                raw, w = flat.tobytes(), self.dtype.itemsize
                out += [raw[a * w : b * w] for a, b in zip(cuts, cuts[1:])]
        return out

    def _stem(self, chunk: str) -> tuple[str, str]:
        """A word and the stop or comma after it, which every pre-tokeniser here
        cuts apart; a word in ASCII in lower case where case leaves no trace."""
        stem, tail = (chunk[:-1], chunk[-1]) if chunk[-1:] in self.tails and chunk[:-1].isalpha() else (chunk, "")
        return (stem.lower() if self.folds_case and stem.isascii() else stem), tail

    def _resolve(self, fresh: dict[str, None]) -> dict[str, bytes]:
        """Ids of chunks that the memo lacks, and of their stems."""
        get = self.memo.get
        stems = {c: self._stem(c) for c in fresh}
        todo = list(dict.fromkeys(s for s, _ in stems.values() if get(s) is None))
        found = dict(zip(todo, self._encode_chunks(todo)))
        for c, (s, t) in stems.items():
            if t or c != s:
                ids = found.get(s)
                found[c] = (get(s) if ids is None else ids) + (self.tails[t] if t else b"")
        return found

    def encode_column(self, column: pa.Array) -> list[bytes]:
        """Ids of each text of an Arrow column; null counts as empty.

        Splitting, finding distinct chunks and gathering their ids are Arrow's
        work; Python sees each distinct chunk of the column once."""
        if not len(column):
            return []
        column = pc.fill_null(column, "")
        split = pc.split_pattern(column, " ") if self.keeps_space else pc.ascii_split_whitespace(column)
        bounds = split.offsets.to_numpy()
        coded = split.values.dictionary_encode()
        index, chunks = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        known = list(map(self.memo.get, chunks))
        new = [c for c, ids in zip(chunks, known) if ids is None]
        found = self._resolve(dict.fromkeys(filter(self._fits, new))) if new else {}
        table = [found.get(c) if ids is None else ids for c, ids in zip(chunks, known)]
        apart = np.fromiter((ids is not None for ids in table), dtype=bool, count=len(table))[index]
        if self.keeps_space:
            # A text's first piece has no blank before it.
            first = bounds[:-1]
            heads = split.values.take(pa.array(first)).to_pylist()
            apart[first] = [not h or not h[-1].isspace() for h in heads]
            index = index.copy()
            index[first] = len(table) + np.arange(len(heads))
            table += [self._pack(e.ids) for e in self.tok.encode_batch_fast(heads, add_special_tokens=False)]
        gathered = pa.array([b"" if ids is None else ids for ids in table], pa.large_binary()).take(pa.array(index))
        ends = np.frombuffer(gathered.buffers()[1], dtype=np.int64)[: len(gathered) + 1][bounds]
        raw = gathered.buffers()[2].to_pybytes() if gathered.buffers()[2] else b""
        out = [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        wrong = np.concatenate([[0], np.cumsum(~apart)])[bounds]
        for i in np.flatnonzero(np.diff(wrong)).tolist():
            out[i] = self._pack(self._ids(column[i].as_py()))
        if len(self.memo) < self.memo_chunks:
            self.memo.update((c, ids) for c, ids in found.items() if len(c) <= MEMO_CHARS)
        return out

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        return self.encode_column(pa.array(texts, pa.string()))


@lru_cache(maxsize=1)
def worker_encoder(tokenizer: str, dtype: str, memo_chunks: int = MEMO_CHUNKS) -> ChunkEncoder:
    """The encoder of this Python worker: tasks that follow one another in a
    worker share its memo."""
    return ChunkEncoder(tokenizer, dtype, memo_chunks)


def release() -> None:
    """Frees the memo in a worker that turns to other work."""
    if worker_encoder.cache_info().currsize:
        worker_encoder.cache_clear()
        trim()
