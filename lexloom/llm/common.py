"""What the corpus operators share: column picking, stages in the shared
folder, slices of texts in workers, and bitmaps of keys."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that every text contract here means: blank and U+0009..U+000D.
SPACE = " \t\n\x0b\x0c\r"


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under new names: ``pick(df, id="doc_id")``.

    Taken by position, so other columns whose names clash (in any letter case)
    with these or with names used inside an operator do no harm."""
    at = {new: df.columns.index(old) for new, old in columns.items()}
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return plain.select(*(F.col(f"c{i}").alias(new) for new, i in at.items()))


#: Folders made where a session names none, by application.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.  A
    local temporary folder only where that is unset and everything runs in one
    process, as in tests; on a cluster an unset folder is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        found = _OWN.setdefault(app, "") or "file://" + tempfile.mkdtemp(prefix="lexloom-")
        _OWN[app] = found
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Stages that this process has written and not yet removed.
_STAGED: list[str] = []


#: Rows of whole texts that go to a worker at once: a batch lies in the memory
#: of executor and worker outside their heaps.
TEXT_ROWS = 1_000


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """Batches of so many rows for jobs run inside; the session's own after."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if rows is not None:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        if rows is not None:
            spark.conf.set(key, before)


#: Narrow rows of a stage's file, about.
FILE_ROWS = 50_000


def stage(df: DataFrame, name: str, rows: int | None = None, about: int | None = None) -> DataFrame:
    """Write to the shared folder and read back: the lineage ends there, and a
    lost executor costs no more than the tasks it was running.  ``rows`` bounds
    the batches that go to workers on the way.  ``about``, a count of narrow
    rows expected, keeps a small table from being written as many files, each
    of which costs the file system more than its rows do."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    if about is not None and about < FILE_ROWS * int(spark.conf.get("spark.sql.shuffle.partitions")):
        df = df.coalesce(8 + about // FILE_ROWS)
    with arrow_rows(spark, rows):
        df.write.parquet(path)
    _STAGED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_stages(spark: SparkSession) -> None:
    """Remove all stages of this process.  Results that still read them must be
    written first."""
    while _STAGED:
        drop_staged(spark, _STAGED.pop())


def drop_staged(spark: SparkSession, path: str) -> None:
    """Remove a stage by Hadoop's file system, whatever store it is in."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def trim() -> None:
    """Hands memory that a worker no longer uses back to the machine; workers
    stay alive between tasks, beside the executor's own heap."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries than glibc
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A map over batches that trims when its task ends."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def column_slices(column: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Runs of rows with about ``size`` bytes of text, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(column):
        before = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + size)))
        yield lo, hi
        lo = hi


def text_slices(column: pa.Array, size: int) -> Iterator[tuple[int, int, list[str]]]:
    """Such runs with their texts, null as empty: a worker holds few texts as
    Python strings, whatever a batch holds."""
    for lo, hi in column_slices(column, size):
        yield lo, hi, [t or "" for t in column.slice(lo, hi - lo).to_pylist()]


#: A bitmap over hashed keys has 2^16 to 2^20 words of 64 bits, some 16 bits for
#: each key while that lasts: at most 1,048,576 rows of 16 bytes.
WORD_BITS = 16
MOST_WORD_BITS = 20


def _place(key: str, bits: int) -> tuple[str, str]:
    """The word of a key, from the top bits of its hash, and its bit there."""
    return f"cast(shiftrightunsigned(xxhash64({key}), {64 - bits}) AS int)", f"cast(shiftrightunsigned(xxhash64({key}), {58 - bits}) & 63L AS int)"


@dataclass(frozen=True)
class Bitmap:
    """Keys as set bits: a table of bounded size, small enough to broadcast.  It
    may answer yes for a key that is not there, never no for one that is."""

    table: DataFrame
    bits: int


def bitmap_of(df: DataFrame, key: str) -> Bitmap:
    """A bitmap sized by the count of the rows, which should be a written table
    or a cheap one, as it is read twice."""
    wanted = (max(df.count(), 1) // 4).bit_length()  # 16 bits a key, 64 a word
    bits = min(max(WORD_BITS, wanted), MOST_WORD_BITS)
    word, bit = _place(key, bits)
    return Bitmap(df.select(F.expr(word).alias("_word"), F.expr(bit).alias("_bit")).groupBy("_word").agg(F.expr("bit_or(shiftleft(1L, _bit))").alias("_bits")), bits)


def flag_by_bitmap(df: DataFrame, key: str, bitmap: Bitmap, out: str) -> DataFrame:
    """Adds ``out``: whether the bitmap may hold the row's key.  No row is
    shuffled."""
    word, bit = _place(key, bitmap.bits)
    found = df.join(F.broadcast(bitmap.table), F.expr(word) == F.col("_word"), "left")
    return found.withColumn(out, F.expr(f"coalesce((shiftright(_bits, {bit}) & 1L) = 1L, false)")).drop("_word", "_bits")


def where_in_bitmap(df: DataFrame, key: str, bitmap: Bitmap) -> DataFrame:
    return flag_by_bitmap(df, key, bitmap, "_maybe").where("_maybe").drop("_maybe")


def drop_rows(docs: DataFrame, id_col: str, text_col: str, dropped: DataFrame, quick: Mapping[str, Callable[[Column, Column], Column]], exact: Mapping[str, Callable[[Column, Column], Column]]) -> DataFrame:
    """``docs`` without the rows that ``dropped`` names, columns as they were.
    A row is known by all of ``quick`` and ``exact``, each made from its id and
    text and a column of ``dropped``; nulls equal each other.  Rows that the
    bitmap of the quick ones clears pass as they are; only the rest, the dropped
    and a few by chance, take the exact ones too and are shuffled for the exact
    anti-join."""
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    row = F.col(f"c{names.index(id_col)}"), F.col(f"c{names.index(text_col)}")
    known = dropped.select(*(F.col(k).alias(f"_d_{k}") for k in (*quick, *exact)))
    key = ", ".join(f"_{k}" for k in quick)
    bitmap = bitmap_of(known.select(*(F.col(f"_d_{k}").alias(f"_{k}") for k in quick)), key)
    marked = flag_by_bitmap(plain.withColumns({f"_{k}": f(*row) for k, f in quick.items()}), key, bitmap, "_maybe")
    clear = marked.where(~F.col("_maybe"))
    rest = marked.where("_maybe").withColumns({f"_{k}": f(*row) for k, f in exact.items()})
    same = reduce(lambda a, b: a & b, (F.col(f"_{k}").eqNullSafe(F.col(f"_d_{k}")) for k in (*quick, *exact)))
    kept = rest.join(known, same, "left_anti")
    return clear.select(*plain.columns).unionByName(kept.select(*plain.columns)).toDF(*names)
