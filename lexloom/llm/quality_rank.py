"""Quality by Bradley-Terry pairwise ranking (operator 4).

Each pair of a good and a poor training document is a comparison that the good
one has won; the chance of that is ``sigmoid(w . (x_good - x_poor))`` in
surface features x of their texts.  The weights minimise the logistic loss of
the feature differences; the threshold is a quantile of the training scores,
at the share of poor documents among them.  The score is mapped so that the
threshold becomes ``cut``.

Bounds: at most MAX_LABELS labelled rows are learnt from and at most MAX_PAIRS
pairs drawn from them; everything else runs over all rows.

Defined results: null and empty texts get the score of an empty text; with no
label, or labels of one kind only, every score is 0.5; rows with a null id are
scored as any other; repeated rows get equal scores; very long texts are
measured whole; pairs that tie count as any other; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trim
from .scoring import labelled, score_texts, sigmoid, texts_of
from .tokens import release

MAX_LABELS = 20_000
MAX_PAIRS = 60_000
CUT = 0.3

_SYMBOLS = b"#*$%&|<>"
_MARKS = b"!?"
_STRIP = bytes.maketrans(b"", b"")
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGITS = bytes(range(48, 58))


def features(text: str) -> list[float]:
    """Surface features of one text, each about 0 to 1, finite for any text."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n, size = len(words), max(len(raw), 1)
    per = max(n, 1)
    count = lambda chars: size - len(raw.translate(_STRIP, chars)) if raw else 0
    lines = [x for x in raw.split(b"\n") if x.strip()]
    pairs = len(set(zip(words, words[1:]))) if n > 1 else n
    symbols, marks, upper, lower, digits = map(count, (_SYMBOLS, _MARKS, _UPPER, _LOWER, _DIGITS))
    letters = max(upper + lower, 1)
    distinct = len(set(words))
    repeats = 1 - pairs / max(n - 1, 1) if n > 1 else 0.0
    return [
        min(symbols / per, 1.0),
        1.0 if symbols > 0.05 * per else 0.0,
        min(marks / per, 1.0),
        upper / letters,
        1.0 if upper > 0.3 * letters else 0.0,
        digits / size,
        1 - distinct / per,
        repeats,
        1.0 if repeats > 0.3 else 0.0,
        1 - len(set(lines)) / max(len(lines), 1),
        min(np.log1p(n) / 10, 1.0),
        min((size / per) / 20, 1.0),
        min(len(max(words, key=len, default=b"")) / 200, 1.0),
    ]


@dataclass
class RankModel:
    """Weights over standardised features, the threshold and a scale."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float
    scale: float
    cut: float = CUT

    def rank(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.spread) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.scale * (self.rank(x) - self.threshold) + np.log(self.cut / (1 - self.cut)))


def fit_rank(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 30, seed: int = 7, cut: float = CUT) -> RankModel | None:
    """Newton's method on the pairwise logistic loss; None without both kinds."""
    good, poor = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(poor):
        return None
    mean, spread = x.mean(axis=0), x.std(axis=0)
    spread[spread < 1e-9] = 1.0
    z = (x - mean) / spread
    rng = np.random.default_rng(seed)
    n = min(MAX_PAIRS, len(good) * len(poor))
    if n < MAX_PAIRS:
        a, b = (m.ravel() for m in np.meshgrid(good, poor))
    else:
        a, b = rng.choice(good, n), rng.choice(poor, n)
    diff = z[a] - z[b]
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(diff @ w)
        grad = diff.T @ (p - 1) / len(diff) + l2 * w
        hess = (diff * (p * (1 - p))[:, None]).T @ diff / len(diff) + l2 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    s = np.sort(z @ w)
    at = int(round(len(s) * float(np.mean(y == 0))))
    at = min(max(at, 1), len(s) - 1)
    return RankModel(mean, spread, w, float((s[at - 1] + s[at]) / 2), 1.0, cut)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labels: int = MAX_LABELS) -> RankModel | None:
    chosen = texts_of(docs, labelled(labels, id_col, label_col, max_labels), id_col, text_col)

    def run(batches):
        for batch in batches:
            x = [features(t or "") for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(x, pa.list_(pa.float64()))], names=["label", "x"])

    # Bounded by max_labels rows; sorted, so that a fit repeats exactly.
    got = chosen.select("text", "label").mapInArrow(run, "label int, x array<double>").collect()
    if not got:
        return None
    rows = sorted((list(r.x), r.label) for r in got)
    return fit_rank(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", model: RankModel | None = None) -> DataFrame:
    """Per row: id, held_out, score, predicted (score at or over the cut)."""
    model = model or train(docs, labels, id_col, text_col, label_col)
    cut = model.cut if model else CUT

    def make():
        if model is None:
            return lambda texts: np.full(len(texts), 0.5)
        return lambda texts: model.score(np.array([features(t) for t in texts]))

    out = score_texts(docs, id_col, text_col, make)
    return out.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The documents that the ranker accepts, columns as they were.  The score
    is computed beside the row, so no text is shuffled.  Rows with null ids,
    empty and null texts and repeated rows are judged by their text alone; with
    no model, for want of labels of both kinds, every row stays; an empty table
    stays empty."""
    model = train(docs, labels, id_col, text_col, label_col)
    if model is None:
        return docs

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        release()
        for texts in batches:
            yield pd.Series(model.score(np.array([features(t or "") for t in texts]).reshape(len(texts), -1)) if len(texts) else [], dtype="float64")
        trim()

    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    return plain.where(score(f"c{names.index(text_col)}") >= model.cut).toDF(*names)
