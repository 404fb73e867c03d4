"""Model-backed steps behind a small protocol.

A backend is made once in each Python worker and gets whole batches.  The
offline ones here are deterministic stand-ins: rules, not models.  Their results
carry the name ``offline`` and say nothing about the quality of a model."""

from __future__ import annotations

import hashlib
import json
import re
import time
from bisect import bisect_left
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import lru_cache
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import lenient_json


class TextModel(Protocol):
    """Replies to prompts; an exception for one prompt fails that row alone."""

    name: str

    def generate(self, prompts: Sequence[str]) -> Sequence[str]: ...


class Tagger(Protocol):
    """Entities (start, end, label, score) of each text, ends exclusive."""

    name: str

    def tag(self, texts: Sequence[str]) -> Sequence[Sequence[tuple[int, int, str, float]]]: ...


class Embedder(Protocol):
    name: str

    def embed(self, texts: Sequence[str]) -> np.ndarray: ...


#: How far before a word the offline tagger looks for the end of a sentence.
NEAR = 64


class OfflineTagger:
    """Words with a digit as GENE, capitalised ones inside a sentence as
    CHEMICAL; or given terms with their labels."""

    name = "offline"

    def __init__(self, terms: Mapping[str, str] | None = None):
        self.terms = {k.lower(): v for k, v in (terms or {}).items()}

    def tag(self, texts):
        out = []
        for text in texts:
            found = []
            for m in re.finditer(r"\w+(?:[-_]\w+)*", text or ""):
                w = m.group()
                if self.terms:
                    label = self.terms.get(w.lower())
                elif any(c.isdigit() for c in w) and any(c.isalpha() for c in w):
                    label = "GENE"
                else:
                    label = "CHEMICAL" if w[:1].isupper() and re.search(r"[^\s.!?]\s*$", text[max(0, m.start() - NEAR) : m.start()]) else None
                if label:
                    found.append((m.start(), m.end(), label, round(0.5 + min(len(w), 10) / 20, 3)))
            out.append(found)
        return out


class OfflineModel:
    """Replies from rules: ``relations`` gives typed JSON for the chemicals
    and genes named in a prompt, paired in turn, ``option`` an option number, ``echo`` the last
    line of the prompt."""

    name = "offline"

    def __init__(self, task: str = "echo"):
        self.task = task

    def generate(self, prompts):
        return [getattr(self, f"_{self.task}")(p or "") for p in prompts]

    def _echo(self, prompt: str) -> str:
        return prompt.rstrip().rpartition("\n")[2]

    def _option(self, prompt: str) -> str:
        m = re.search(r"(?:answer|option)\W*(?:is\W*)?([1-4])", prompt, re.I)
        return json.dumps({"option": int(m[1]) if m else None})

    def _relations(self, prompt: str) -> str:
        at = lambda kind: re.findall(rf"([^\s;]+) \({kind}\)", prompt)
        pairs = list(zip(at("CHEMICAL"), at("GENE")))
        return json.dumps({"relations": [{"head": a, "tail": b, "predicate": "INHIBITOR"} for a, b in pairs]})


class OfflineEmbedder:
    """Hashed bags of words, normalised."""

    name = "offline"

    def __init__(self, width: int = 64):
        self.width = width

    def embed(self, texts):
        out = np.zeros((len(texts), self.width))
        for row, text in zip(out, texts):
            for w in (text or "").lower().split():
                h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little")
                row[h % self.width] += 1 if h >> 63 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


@lru_cache(maxsize=4)
def _made(make: Callable[[], object]) -> object:
    return make()


@dataclass(frozen=True)
class Patience:
    """How long a call may take, how often one prompt is tried again, and the
    seconds before that, doubled each time up to ``longest``."""

    timeout: float | None = None
    retries: int = 0
    wait: float = 1.0
    longest: float = 50.0


def _call(call: Callable[[Sequence], Sequence], items: list, timeout: float | None) -> Sequence:
    if timeout is None:
        return call(items)
    # Not a with-block, which would wait for a call that hangs.
    pool = ThreadPoolExecutor(1)
    try:
        return pool.submit(call, items).result(timeout)
    finally:
        pool.shutdown(wait=False, cancel_futures=True)


def _each(call: Callable[[Sequence], Sequence], items: list, patience: Patience = Patience()) -> list[tuple[object, str | None]]:
    """Results with errors; a batch that fails is halved until the prompt that
    fails is alone, and that one is tried again as patience allows."""
    if not items:
        return []
    for attempt in range(1 + (patience.retries if len(items) == 1 else 0)):
        try:
            got = list(_call(call, items, patience.timeout))
            if len(got) != len(items):
                raise ValueError(f"{len(got)} replies to {len(items)} prompts")
            return [(x, None) for x in got]
        except Exception as failed:
            why = f"{type(failed).__name__}: {failed}"
        if len(items) > 1:
            half = len(items) // 2
            return _each(call, items[:half], patience) + _each(call, items[half:], patience)
        if attempt < patience.retries:
            time.sleep(min(patience.wait * 2**attempt, patience.longest))
    return [(None, why)]


def generate(df: DataFrame, prompt: str, make: Callable[[], TextModel], reply: str = "reply", error: str = "error", batch: int = 64, patience: Patience = Patience()) -> DataFrame:
    """Adds a model's reply, or its error, to every row; null prompts are sent
    as they are."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _made(make)
        for b in batches:
            prompts = b.column(names.index(prompt)).to_pylist()
            got = [r for i in range(0, len(prompts), batch) for r in _each(model.generate, prompts[i : i + batch], patience)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x for x, _ in got], pa.string()), pa.array([e for _, e in got], pa.string())], names=[*names, reply, error])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{fields}, `{reply}` string, `{error}` string")


def extract(df: DataFrame, prompt: str, make: Callable[[], TextModel], schema: str, out: str = "parsed") -> DataFrame:
    """Replies parsed leniently into a typed struct; rows whose reply failed or
    doesn't parse have null."""
    return generate(df, prompt, make).withColumn(out, lenient_json("reply", schema)).drop("reply")


def _flat(found: Sequence[tuple[int, int, str, float]]) -> list[tuple[int, int, str, float]]:
    """Of entities that overlap the best scored, then the first, then the longest."""
    kept: list[tuple[int, int, str, float]] = []
    for e in sorted(found, key=lambda e: (-e[3], e[0], -e[1], e[2])):
        at = bisect_left(kept, e)
        if (not at or kept[at - 1][1] <= e[0]) and (at == len(kept) or e[1] <= kept[at][0]):
            kept.insert(at, e)
    return kept


def tag(df: DataFrame, key: str, text: str, make: Callable[[], Tagger], threshold: float = 0.0, chunk: int | None = None, labels: Sequence[str] | None = None, flat: bool = True) -> DataFrame:
    """A row for each entity found: key, start, end, label, score, surface; null
    texts have none.

    ``labels`` are the kinds asked for: a tagger that has ``tag_labels`` is asked
    for them, any other's entities are kept by them.  ``flat`` leaves out all but
    the best of entities that overlap; otherwise they may be nested.  ``chunk``
    cuts long texts at blanks into pieces of about so many words."""
    kind = dict(df.dtypes)[key]
    wanted = None if labels is None else set(labels)

    def pieces(value: str) -> list[tuple[int, str]]:
        if not chunk:
            return [(0, value)]
        ends = [m.end() for m in re.finditer(r"\S+", value)][chunk - 1 :: chunk]
        cuts = [0, *[e for e in ends if e < len(value)], len(value)]
        return [(a, value[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = _made(make)
        for b in batches:
            rows, cols = [], [[], [], [], [], []]
            for i, value in enumerate(b.column(1).to_pylist()):
                own = pieces(value or "")
                ask = getattr(tagger, "tag_labels", None) if labels is not None else None
                said = ask([p for _, p in own], list(labels)) if ask else tagger.tag([p for _, p in own])
                for (at, _), found in zip(own, said):
                    fine = [e for e in found if e[3] >= threshold and (wanted is None or e[2] in wanted)]
                    for start, end, label, score in _flat(fine) if flat else fine:
                        rows.append(i)
                        for c, x in zip(cols, (at + start, at + end, label, score, value[at + start : at + end])):
                            c.append(x)
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=[key, "start", "end", "label", "score", "surface"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, start int, end int, label string, score double, surface string")


def embed(df: DataFrame, key: str, text: str, make: Callable[[], Embedder], out: str = "embedding") -> DataFrame:
    """(key, text, embedding): a vector collection, ready to be stored."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _made(make)
        for b in batches:
            vectors = model.embed(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(vectors.astype(np.float32)), pa.list_(pa.float32()))], names=[key, text, out])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, `{text}` string, {out} array<float>")


def last_reply(df: DataFrame, key: str, call: str, value: str) -> DataFrame:
    """Of several tool calls for one row the last one counts."""
    return df.groupBy(key).agg(F.max_by(value, call).alias(value))
