"""Token-id files (operator 5).

Format, per part: ``part-N.ids``, a flat file of little-endian unsigned
integers (16 bits if the vocabulary allows, else 32); ``part-N.off``,
little-endian signed 64-bit offsets, one more than the part has documents,
counted from the part's first id; ``part-N.doc``, the documents' ids as signed
64-bit integers, a null id as the least one.  ``manifest.json`` lists the parts
in order with their bases, the prefix sums of their counts: a document starts
at base + offset.  All files can be memory-mapped.

Documents are dealt by ranges of id, so the parts in order hold them in
ascending order, null ids first; rows that share an id are ordered by the hash
of their text.  A part is written under another name and renamed, so a task
that runs twice leaves one whole part.

Defined results: null text counts as empty and has the end id alone; repeated
rows are all written; very long texts are encoded whole; an empty table gives a manifest without parts; other
columns are ignored.
"""

from __future__ import annotations

import contextlib
import glob
import json
import os
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column_slices, fresh_path, pick, trimmed
from .tokens import resolve, worker_encoder

TOKENIZER = "byte_bpe_50k.json"
NO_ID = -(2**63)
#: Bytes of input for each part, about.
PART_BYTES = 256_000_000
#: Texts encoded at a time; bounds a worker's memory.
SLICE_BYTES = 16_000_000
#: Rows, and bytes of ids, read back at a time.
READ_ROWS = 4_096
READ_BYTES = 8_000_000


@dataclass(frozen=True)
class Part:
    number: int
    docs: int
    tokens: int
    doc_base: int
    token_base: int


def local_path(path: str) -> str:
    """Where a shared folder is mounted: flat files are written and mapped by
    path, so the folder must be one that every machine has mounted."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"token files need a mounted folder, not {path}")
    return path


def id_type(tokenizer: str) -> str:
    with open(resolve(tokenizer), encoding="utf-8") as f:
        said = json.load(f)
    most = max([*said["model"]["vocab"].values(), *(t["id"] for t in said.get("added_tokens", []))])
    return "<u2" if most < 2**16 else "<u4"


def text_bytes(docs: DataFrame, text_col: str) -> int:
    """Bytes of all texts: what the plan says of its files, which costs nothing,
    or a sum where it can't say."""
    planned = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if planned < 1 << 50:
        return planned
    return pick(docs, text=text_col).agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def write_token_files(docs: DataFrame, out_dir: str | None = None, tokenizer: str = TOKENIZER, end_id: int = 0, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encodes and writes every document; returns the folder.  There are as many
    parts as shuffle partitions, or more if one would hold over PART_BYTES."""
    spark = docs.sparkSession
    out_dir = out_dir or fresh_path(spark, "tokens")
    folder, kind = local_path(out_dir), id_type(tokenizer)
    os.makedirs(folder, exist_ok=True)
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-text_bytes(docs, text_col) // PART_BYTES))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, number = worker_encoder(tokenizer, kind), TaskContext.get().partitionId()
        end, width = np.array([end_id], dtype=kind).tobytes(), np.dtype(kind).itemsize
        n_docs, n_ids = 0, 0
        temp = f"{folder}/.{number}-{uuid.uuid4().hex}"
        try:
            # All three files grow slice by slice; a worker holds no more of them.
            with open(f"{temp}.ids", "wb") as ids, open(f"{temp}.off", "wb") as off, open(f"{temp}.doc", "wb") as doc:
                np.zeros(1, dtype="<i8").tofile(off)
                for batch in batches:
                    batch.column(0).cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False).astype("<i8").tofile(doc)
                    for lo, hi in column_slices(batch.column(1), SLICE_BYTES):
                        encoded = encoder.encode_column(batch.column(1).slice(lo, hi - lo))
                        ends = n_ids + np.cumsum([len(e) // width + 1 for e in encoded], dtype="<i8")
                        ends.tofile(off)
                        ids.write(end.join(encoded) + end)
                        n_docs, n_ids = n_docs + len(encoded), int(ends[-1])
            if n_docs:
                for x in ("ids", "off", "doc"):
                    os.replace(f"{temp}.{x}", f"{folder}/part-{number:06d}.{x}")
        finally:
            for x in ("ids", "off", "doc"):
                with contextlib.suppress(FileNotFoundError):
                    os.remove(f"{temp}.{x}")
        if n_docs:
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([n_docs], pa.int64()), pa.array([n_ids], pa.int64())], names=["number", "docs", "tokens"])

    rows = pick(docs, id=id_col, text=text_col).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange(parts, F.col("id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("id").asc_nulls_first(), "tie")
    # One row for each part, whatever the number of documents.
    counts = sorted(tuple(r) for r in ordered.select("id", "text").mapInArrow(trimmed(write), "number int, docs long, tokens long").collect())
    for left in glob.glob(f"{folder}/.*-*.???"):  # of attempts whose executor was lost
        os.remove(left)
    found, doc_base, token_base = [], 0, 0
    for number, n_docs, n_tokens in counts:
        found.append({"number": number, "docs": n_docs, "tokens": n_tokens, "doc_base": doc_base, "token_base": token_base})
        doc_base, token_base = doc_base + n_docs, token_base + n_tokens
    with open(f"{folder}/manifest.json", "w", encoding="utf-8") as f:
        json.dump({"dtype": kind, "end_id": end_id, "docs": doc_base, "tokens": token_base, "parts": found}, f)
    return out_dir


def manifest(out_dir: str) -> tuple[str, list[Part]]:
    with open(f"{local_path(out_dir)}/manifest.json", encoding="utf-8") as f:
        said = json.load(f)
    return said["dtype"], [Part(**p) for p in said["parts"]]


def crc_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def read_token_files(spark: SparkSession, out_dir: str, value: Callable[[np.ndarray], object] | None = None, value_type: str = "array<long>", value_name: str = "ids", id_name: str = "doc_id") -> DataFrame:
    """Per document: id, start, n_tokens, and ``value`` of its mapped ids (the
    ids themselves if none is given).  One task maps one part."""
    kind, parts = manifest(out_dir)
    folder = local_path(out_dir)
    value = value or (lambda ids: ids.tolist())
    schema = f"{id_name} long, start long, n_tokens long, {value_name} {value_type}"
    if not parts:
        return spark.createDataFrame([], schema)
    arrow_value = {"long": pa.int64(), "array<long>": pa.list_(pa.int64())}[value_type]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at in (i for b in batches for i in b.column(0).to_pylist()):
            part = parts[at]
            name = f"{folder}/part-{part.number:06d}"
            offsets, names = np.memmap(f"{name}.off", "<i8", "r"), np.memmap(f"{name}.doc", "<i8", "r")
            ids = np.memmap(f"{name}.ids", kind, "r")
            lo = 0
            while lo < part.docs:
                hi = int(np.searchsorted(offsets, offsets[lo] + READ_BYTES // ids.itemsize))
                hi = min(max(hi, lo + 1), lo + READ_ROWS, part.docs)
                own = offsets[lo : hi + 1]
                got = [value(ids[a:b]) for a, b in zip(own[:-1], own[1:])]
                who = pa.array(np.array(names[lo:hi]), pa.int64(), mask=np.array(names[lo:hi]) == NO_ID)
                yield pa.RecordBatch.from_arrays([who, pa.array(own[:-1] + part.token_base, pa.int64()), pa.array(np.diff(own), pa.int64()), pa.array(got, arrow_value)], names=[id_name, "start", "n_tokens", value_name])
                lo = hi

    return spark.range(0, len(parts), 1, len(parts)).mapInArrow(trimmed(read), schema)
