"""What the two learned scorers share: the hold-out rule, bounded labelled
samples, and Arrow passes over texts that leave ids untouched (null ones too)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, text_slices, trimmed
from .tokens import release

HOLD_OUT_FOLDS = 5
SLICE_CHARS = 2_000_000


def fold(key: Column) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % HOLD_OUT_FOLDS).cast("int")


def labelled(labels: DataFrame, id_col: str, label_col: str, bound: int) -> DataFrame:
    """At most ``bound`` labelled ids outside the held-out fold, those of least
    hash, so that the choice doesn't depend on how rows are dealt.

    An id with labels of both kinds gives none; null ids and labels give none."""
    rows = pick(labels, id=id_col, label=label_col).where("id IS NOT NULL AND label IN (0, 1)").where(fold(F.col("id")) != 0)
    one = rows.groupBy("id").agg(F.min("label").cast("int").alias("label"), F.max("label").cast("int").alias("most")).where("label = most")
    return one.select("id", "label").orderBy(F.xxhash64("id"), "id").limit(bound)


def texts_of(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``chosen`` (a bounded table of distinct ids) with a text for each: of
    several rows of one id the text of least hash, so the result is as bounded
    as ``chosen``, however often an id is repeated."""
    rows = pick(docs, id=id_col, text=text_col)
    few = chosen.withColumnRenamed("id", "_chosen")
    met = rows.join(F.broadcast(few), F.col("id") == F.col("_chosen")).drop("_chosen")
    extra = [c for c in chosen.columns if c != "id"]
    one = met.groupBy("id", *extra).agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("_m"))
    return one.select("id", F.col("_m.text").alias("text"), *extra)


def score_texts(docs: DataFrame, id_col: str, text_col: str, make: Callable[[], Callable[[list[str]], np.ndarray]]) -> DataFrame:
    """Per row: id, held_out, score.  ``make`` is called once per task and gives
    a function from texts to scores; null text goes in as empty."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        score = make()
        for batch in batches:
            done = [score(texts) for _, _, texts in text_slices(batch.column(1), SLICE_CHARS)]
            scores = np.concatenate(done) if done else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    scored = pick(docs, id=id_col, text=text_col).mapInArrow(trimmed(run), f"id {kind}, score double")
    return scored.select(F.col("id").alias(id_col), (fold(F.col("id")) == 0).alias("held_out"), "score")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * np.asarray(x, dtype=np.float64)))
