"""Toxicity by non-negative positive-unlabelled learning (operator 3).

Confirmed toxic documents are the positives, other text is unlabelled.  A
linear model over hashed words and word pairs minimises
``pi R+(P) + max(0, R-(U) - pi R-(P))``, pi being the share of toxic text; the
bracket is what the unlabelled risk leaves once the positives hidden in it are
taken off, and it may not fall below nought.

1. Features: the distinct words of a text, in lower case without ASCII
   punctuation, and its pairs of neighbouring words, hashed into BUCKETS.
2. Every text outside the held-out fold is counted: in how many texts, and in
   how many confirmed ones, a bucket occurs.  A bucket becomes a feature where
   the two shares differ by MIN_Z standard errors; there is no limit to their
   number but that of the buckets.
3. The weights are fitted on the driver, on confirmed texts and a sample of
   unlabelled ones; each is a bounded number of rows (``max_positive`` and
   ``max_unlabelled``; the README has their measured effect).

Defined results: null and empty texts get the score of a text without words;
with no confirmed toxic document every score is 0; rows with a null id are
scored as any other but not learnt from; repeated rows get equal scores; very
long texts are read whole; buckets that tie count alike; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXT_ROWS, pick, stage, text_slices, trimmed
from .scoring import fold, labelled, score_texts, sigmoid, texts_of
from .shingles import Shingler, mix

MAX_LABELS = 40_000
MAX_POSITIVE = 4_000
MAX_UNLABELLED = 12_000
#: Half of the buckets are for words, half for pairs.
BITS = 19
BUCKETS = 1 << BITS
#: A bucket must be in this many positives to be learnt from.
MIN_POSITIVE = 5
#: Least deviation, in standard errors, of a bucket's share among positives.
MIN_Z = 6.0
SLICE_CHARS = 1_000_000

#: ASCII punctuation becomes a blank before a text is split into words.
_BLANKED = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))
_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Hasher:
    """Texts to (row, bucket), each pair once, sorted; of ``wanted`` buckets (a
    flag for each) only, if given."""

    def __init__(self, wanted: np.ndarray | None = None) -> None:
        self.shingler, self.wanted = Shingler(), wanted

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not texts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        hashes, bounds = self.shingler.words([t.lower().encode("utf-8", "replace").translate(_BLANKED) for t in texts])
        # Short numbers sort faster.
        kind = np.uint32 if len(texts) << BITS < 1 << 32 else np.uint64
        row = np.repeat(np.arange(len(texts), dtype=kind), np.diff(bounds))
        inside = row[:-1] == row[1:]
        pairs = mix(hashes[:-1] * _LEFT + hashes[1:] * _RIGHT)
        half = np.uint64(65 - BITS)
        bucket = np.concatenate([(hashes >> half).astype(kind), (pairs >> half).astype(kind)[inside] + kind(BUCKETS // 2)])
        row = np.concatenate([row, row[:-1][inside]])
        if self.wanted is not None:
            kept = self.wanted[bucket]
            row, bucket = row[kept], bucket[kept]
        both = np.sort((row << kind(BITS)) | bucket)
        both = both[np.append(True, both[1:] != both[:-1])] if len(both) else both
        return (both >> kind(BITS)).astype(np.int64), (both & kind(BUCKETS - 1)).astype(np.int64)


@dataclass
class BucketModel:
    """A bias and the weights of the buckets that count."""

    bias: float
    buckets: np.ndarray
    weights: np.ndarray

    def scorer(self):
        table = np.zeros(BUCKETS)
        table[self.buckets] = self.weights
        hasher = Hasher(table != 0)

        def score(texts: list[str]) -> np.ndarray:
            row, bucket = hasher(texts)
            return sigmoid(self.bias + np.bincount(row, weights=table[bucket], minlength=len(texts)))

        return score


def fit_nnpu(rows: np.ndarray, cols: np.ndarray, positive: np.ndarray, n_words: int, prior: float, steps: int = 800, rate: float = 0.2, l2: float = 1e-5) -> tuple[float, np.ndarray]:
    """Bias and weights from (row, word) pairs.  Where the bracket of the risk
    is negative, its gradient is followed the other way, which takes back
    over-fitted unlabelled rows."""
    n_p, n_u = int(positive.sum()), int((~positive).sum())
    w, b = np.zeros(n_words), 0.0
    m, v, mb, vb = np.zeros(n_words), np.zeros(n_words), 0.0, 0.0
    n = len(positive)
    for t in range(1, steps + 1):
        g = b + np.bincount(rows, weights=w[cols], minlength=n)
        p = sigmoid(g)
        loss_minus = np.logaddexp(0, g)
        bracket = loss_minus[~positive].mean() - prior * loss_minus[positive].mean()
        d = np.zeros(n)
        if bracket >= 0:
            d[positive] += prior * (p[positive] - 1) / n_p - prior * p[positive] / n_p
            d[~positive] += p[~positive] / n_u
        else:
            d[positive] += prior * p[positive] / n_p
            d[~positive] -= p[~positive] / n_u
        gw, gb = np.bincount(cols, weights=d[rows], minlength=n_words) + l2 * w, d.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        w -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b -= rate * (mb / c1) / (math.sqrt(vb / c2) + 1e-8)
    return b, w


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: in how many texts a bucket is; -1 counts the texts."""
    hasher, seen, n = Hasher(), np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        for _, _, texts in text_slices(batch.column(0), SLICE_CHARS):
            seen += np.bincount(hasher(texts)[1], minlength=BUCKETS)
            n += len(texts)
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(seen[at], n), pa.int64())], names=["bucket", "n"])


def _rows(buckets: np.ndarray):
    """A map over (text, positive) to each text's places in ``buckets``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(BUCKETS, -1, np.int32)
        place[buckets] = np.arange(len(buckets))
        hasher = Hasher(place >= 0)
        for batch in batches:
            for lo, hi, texts in text_slices(batch.column(0), SLICE_CHARS):
                row, bucket = hasher(texts)
                lists = np.split(place[bucket], np.searchsorted(row, np.arange(1, len(texts))))
                yield pa.RecordBatch.from_arrays([batch.column(1)[lo:hi], pa.array(lists, pa.list_(pa.int32()))], names=["positive", "places"])

    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", prior: float | None = None, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> BucketModel | None:
    """``prior`` is the share of toxic text; None takes it from the labels."""
    known = stage(labelled(labels, id_col, label_col, MAX_LABELS), "toxic-labels")
    n, n_toxic = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not n_toxic:
        return None
    prior = prior if prior is not None else min(max(n_toxic / n, 1e-3), 0.9)
    confirmed = known.where("label = 1").orderBy(F.xxhash64("id"), "id").limit(max_positive).select("id", F.lit(True).alias("positive"))
    learnt = pick(docs, id=id_col, text=text_col).where("id IS NOT NULL").where(fold(F.col("id")) != 0)
    # Drawn from all text, toxic or not, as the risk takes it to be.
    others = learnt.select("id").orderBy(F.xxhash64("id"), "id").limit(max_unlabelled).distinct().select("id", F.lit(False).alias("positive"))
    few = lambda chosen: texts_of(docs, chosen, id_col, text_col).select("text", "positive")
    sample = stage(few(confirmed).unionByName(few(others)), "toxic-sample")

    all_counts = stage(learnt.select("text").mapInArrow(trimmed(_counts), "bucket int, n long"), "bucket-counts", TEXT_ROWS)
    every = all_counts.groupBy("bucket").agg(F.sum("n").alias("u"))
    own = sample.where("positive").select("text").mapInArrow(trimmed(_counts), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("p"))
    found = stage(own.join(every, "bucket").where(f"p >= {MIN_POSITIVE} OR bucket < 0"), "toxic-buckets")
    total = found.where("bucket < 0").first()
    if not total or not total.p or not total.u:
        return None
    # How far a bucket's share among positives is from its share in all text.
    share_p, share_u = F.col("p") / total.p, F.col("u") / total.u
    z = (share_p - share_u) / F.sqrt(share_u * (1 - share_u) / total.p + 1e-12)
    # At most BUCKETS numbers.
    best = found.where("bucket >= 0").where(F.abs(z) >= MIN_Z).select("bucket").toArrow().column(0).to_numpy()
    buckets = np.sort(best).astype(np.int64)
    if not len(buckets):
        return None

    # Bounded: max_positive + max_unlabelled rows of their places.
    got = sample.mapInArrow(_rows(buckets), "positive boolean, places array<int>").toArrow()
    rows = sorted((p, tuple(x)) for p, x in zip(got.column(0).to_pylist(), got.column(1).to_pylist()))
    at = np.repeat(np.arange(len(rows)), [len(x) for _, x in rows])
    cols = np.array([c for _, x in rows for c in x], dtype=np.int64)
    bias, weights = fit_nnpu(at, cols, np.array([p for p, _ in rows]), len(buckets), prior)
    used = np.abs(weights) > 1e-3
    return BucketModel(float(bias), buckets[used], weights[used])


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", model: BucketModel | None = None) -> DataFrame:
    """Per row: id, held_out, score, predicted (1 from a score of 0.5 on)."""
    model = model or train(docs, labels, id_col, text_col, label_col)

    def make():
        return model.scorer() if model else lambda texts: np.zeros(len(texts))

    return score_texts(docs, id_col, text_col, make).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
