"""Sets of hashed word shingles, vectorised over slices of many texts.

Words are runs of bytes other than blank and U+0009..U+000D of the text with
A-Z lowered.  A set holds one 64-bit hash for each distinct run of five words;
a text of one to four words has one hash for its whole sequence, a text without
words none."""

from __future__ import annotations

import re

import numpy as np

WORDS = 5
#: Bytes of a long text that are hashed at a time, to the end of a word.
PIECE = 1_000_000
_GAP = re.compile(rb"[ \t-\r]")
_RNG = np.random.default_rng(20240229)
_odd = lambda n: _RNG.integers(0, 2**64, n, dtype=np.uint64) | np.uint64(1)
_BYTE = _odd(256)
_BASE = int(_odd(1)[0])
_PLACE = _odd(WORDS)
_LENGTH = _odd(1)[0]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Shingler:
    def __init__(self) -> None:
        self.power = self.inverse = np.ones(1, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            n = max(n, 1 << 16)
            for name, base in (("power", _BASE), ("inverse", pow(_BASE, -1, 2**64))):
                steps = np.full(n, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def word_hashes(self, raw: bytes, starts_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each word, and for each text the number of its first word."""
        buf = np.frombuffer(raw, dtype=np.uint8)
        inside = ~_SPACE[buf]
        edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
        first, last = edge[::2], edge[1::2]
        self._grow(len(buf) + 1)
        sums = np.zeros(len(buf) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[buf] * self.power[: len(buf)], out=sums[1:])
        h = (sums[last] - sums[first]) * self.inverse[first]
        return mix(h + (last - first).astype(np.uint64) * _LENGTH), np.searchsorted(first, starts_of)

    def words(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of several texts, and where each text's begin.  One
        long text goes piece by piece, as each byte takes some fifty beside it."""
        if len(raws) > 1 or len(raws[0]) <= 2 * PIECE:
            starts = np.cumsum([0, *(len(r) + 1 for r in raws)])
            return self.word_hashes(b"\n".join([*raws, b""]), starts)
        found, lo, raw = [], 0, raws[0]
        while lo < len(raw):
            gap = _GAP.search(raw, lo + PIECE)
            hi = gap.start() if gap else len(raw)
            found.append(self.word_hashes(raw[lo:hi], np.zeros(1, np.int64))[0])
            lo = hi
        hashes = np.concatenate(found)
        return hashes, np.array([0, len(hashes)])

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        """Each text's set as a sorted array."""
        raws = [t.encode("utf-8", "replace").lower() for t in texts]
        if not raws:
            return []
        hashes, bounds = self.words(raws)
        n = len(hashes) - WORDS + 1
        if n > 0:
            runs = hashes[:n] * _PLACE[0]
            for k in range(1, WORDS):
                runs += hashes[k : n + k] * _PLACE[k]
            runs = mix(runs)
        out = []
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if hi - lo >= WORDS:
                s = np.sort(runs[lo : hi - WORDS + 1])
                out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
            elif hi > lo:
                own = np.array([hi - lo], dtype=np.uint64) * _LENGTH + (hashes[lo:hi] * _PLACE[: hi - lo]).sum(dtype=np.uint64)
                out.append(mix(own))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
        return out
