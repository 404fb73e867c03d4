"""Packing into windows by Karmarkar-Karp multiway differencing (operator 7).

A document's ids (its end id last) are cut into pieces: whole windows first,
then one remainder.  Pieces are dealt by hash into groups of about
GROUP_TOKENS; in a group each whole window is a sequence, and the remainders
are partitioned into the fewest windows that differencing can balance within
the capacity.  Differencing keeps a heap of partial partitions; it takes the
two with the largest spread and adds them with opposing imbalances, the fullest
window of one onto the emptiest of the other, until one partition is left.
Whenever its fullest window exceeds the capacity the window count rises and the
group is partitioned anew.

Only lengths reach the groups.  A piece counts as GROUP_TOKENS / GROUP_ITEMS at
least when groups are formed, so a group's tokens and its items are bounded
whatever the data, by hash in expectation: equal rows are spread by their place in the
input.

Defined results: null text counts as empty and gives the end id alone; repeated
rows are all packed; null ids are packed as any other; very long texts are cut
into whole windows and a remainder; pieces that tie in length are ordered by
their ids' crc32 and place; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column_slices, pick, stage, trim, trimmed
from .token_files import SLICE_BYTES
from .tokens import MEMO_CHUNKS, worker_encoder

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
CAPACITY = 4_096
GROUP_TOKENS = 1 << 20
#: Items of a group at most: a piece counts as its share of the group at least.
GROUP_ITEMS = 1 << 15
#: Windows that one group can have, far more than its tokens allow.
GROUP_WINDOWS = 1 << 24
#: Rows of a file for which the driver holds one sum of tokens.
RUN_ROWS = 1_024


def differencing(sizes: Sequence[int], windows: int) -> list[list[int]]:
    """Item numbers of each of ``windows`` near-equal windows."""
    if windows == 1:
        return [list(range(len(sizes)))]
    # A partial partition: sums of its non-empty windows, falling, and for each
    # the tree of its items.
    heap: list[tuple[int, int, np.ndarray, list]] = [(-s, i, np.array([s], dtype=np.int64), [i]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    serial = len(heap)
    while len(heap) > 1:
        _, _, a, ta = heapq.heappop(heap)
        _, _, b, tb = heapq.heappop(heap)
        shared = len(a) + len(b) - windows
        if shared <= 0:
            sums, trees = np.concatenate([a, b]), ta + tb
        else:
            # The last ``shared`` of a meet the last ``shared`` of b, crosswise.
            ka, kb = len(a) - shared, len(b) - shared
            sums = np.concatenate([a[:ka], a[ka:] + b[kb:][::-1], b[:kb]])
            trees = ta[:ka] + list(zip(ta[ka:], tb[kb:][::-1])) + tb[:kb]
        order = np.argsort(-sums, kind="stable")
        sums, trees = sums[order], [trees[i] for i in order.tolist()]
        spread = int(sums[0]) - (int(sums[-1]) if len(sums) == windows else 0)
        heapq.heappush(heap, (-spread, serial, sums, trees))
        serial += 1
    out: list[list[int]] = []
    for tree in heap[0][3] if heap else []:
        items, todo = [], [tree]
        while todo:
            t = todo.pop()
            if isinstance(t, tuple):
                todo += t
            else:
                items.append(t)
        out.append(items)
    return out


def pack_sizes(sizes: Sequence[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Windows within the capacity.  Sizes are at most the capacity, so as many
    windows as items always suffice."""
    if not len(sizes):
        return []
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        found = differencing(sizes, windows)
        fullest = max(sum(sizes[i] for i in w) for w in found)
        if fullest <= capacity:
            return found
        # The share by which the fullest overflows, one more at least.
        windows = min(len(sizes), max(windows + 1, int(windows * (1 + 0.5 * (fullest - capacity) / capacity))))


def cut_pieces(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, memo_chunks: int = MEMO_CHUNKS, slice_bytes: int = SLICE_BYTES, places: bool = False) -> DataFrame:
    """Per piece: id, start, length, ids_crc32, doc_tokens, salt, and its ids as
    little-endian 32-bit integers if wanted; with ``places`` also its row's file
    and place there."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "salt", *(["ids"] if with_ids else []), *(["file", "at"] if places else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer, "<u4", memo_chunks)
        end, width, salt = np.array([end_id], dtype="<u4").tobytes(), 4, 0
        for batch in batches:
            for lo, hi in column_slices(batch.column(1), slice_bytes):
                row, start, length, crc, whole, ids = [], [], [], [], [], []
                for i, e in zip(range(lo, hi), encoder.encode_column(batch.column(1).slice(lo, hi - lo))):
                    e += end
                    n = len(e) // width
                    for a in range(0, n, capacity):
                        piece = e[a * width : (a + capacity) * width]
                        row.append(i)
                        start.append(a)
                        length.append(len(piece) // width)
                        crc.append(zlib.crc32(piece))
                        whole.append(n)
                        ids.append(piece)
                salts = np.arange(salt, salt + len(row), dtype=np.int64)
                salt += len(row)
                cols = [batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, whole, salts)), *([pa.array(ids, pa.binary())] if with_ids else [])]
                cols += [batch.column(k).take(pa.array(row, pa.int64())) for k in range(2, batch.num_columns)]
                yield pa.RecordBatch.from_arrays(cols, names=names)
                trim()

    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, salt long" + ", ids binary" * with_ids + ", file string, at long" * places
    rows = pick(placed_rows(docs), id=id_col, text=text_col, file="_file", at="_at") if places else pick(docs, id=id_col, text=text_col)
    return rows.mapInArrow(trimmed(run), schema)


def placed_rows(docs: DataFrame) -> DataFrame:
    """Adds each row's file and place there (_file, _at), or its partition and
    place there for rows that come from no file."""
    try:
        return docs.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    except AnalysisException:
        at = F.monotonically_increasing_id()
        return docs.select("*", F.format_string("part-%d", F.shiftright(at, 33)).alias("_file"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"))


def file_order(path: str) -> tuple[int, str]:
    """Files in the order of the partitions that wrote them."""
    found = re.match(r"part-(\d+)", path.rsplit("/", 1)[-1])
    return int(found[1]) if found else -1, path


def deal_runs(pieces: DataFrame, group_tokens: int) -> DataFrame:
    """``pieces`` with their group: the rows' order is cut whenever another
    ``group_tokens`` tokens, or GROUP_ITEMS items, are full."""
    run, weight = F.expr(f"at div {RUN_ROWS}L"), F.greatest("length", F.lit(group_tokens // GROUP_ITEMS))
    # Bounded: a row for each file and RUN_ROWS rows of it.
    sums = pieces.groupBy("file", run.alias("run")).agg(F.sum(weight).alias("n")).toArrow().to_pylist()
    sums.sort(key=lambda r: (*file_order(r["file"]), r["run"]))
    n = np.array([r["n"] for r in sums], dtype=np.int64)
    table = pa.table({"_file": pa.array([r["file"] for r in sums], pa.string()), "_run": pa.array([r["run"] for r in sums], pa.int64()), "_serial": np.arange(len(n)), "_before": np.cumsum(n) - n})
    runs = F.broadcast(pieces.sparkSession.createDataFrame(table))
    met = pieces.join(runs, (F.col("file") == F.col("_file")) & (run == F.col("_run"))).drop("file", "_file", "_run")
    within = Window.partitionBy("_serial").orderBy("at", "start").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_before") + F.coalesce(F.sum(weight).over(within), F.lit(0))
    return met.withColumn("_tokens", before).withColumn("group", F.expr(f"_tokens div {group_tokens}L")).drop("_tokens", "_before", "_serial", "at", "salt")


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, group_tokens: int = GROUP_TOKENS, memo_chunks: int = MEMO_CHUNKS, slice_bytes: int = SLICE_BYTES, in_order: bool = False, batch_rows: int | None = None) -> DataFrame:
    """Per piece: id, start, length, ids_crc32, doc_tokens, sequence_id and
    offset within the sequence (and its ids).

    ``memo_chunks``, ``slice_bytes`` and ``batch_rows`` (texts sent to a worker at
    once) trade a worker's memory for its time.
    With ``in_order`` groups are successive runs of the rows as their files hold
    them, so that sequence_id follows that order, group by group."""
    pieces = stage(cut_pieces(docs, tokenizer, end_id, capacity, id_col, text_col, with_ids, memo_chunks, slice_bytes, in_order), "pieces", batch_rows)
    if in_order:
        dealt = deal_runs(pieces, group_tokens)
    else:
        total = pieces.agg(F.coalesce(F.sum(F.greatest("length", F.lit(group_tokens // GROUP_ITEMS))), F.lit(0))).first()[0]
        groups = max(1, -(-total // group_tokens))
        dealt = pieces.withColumn("group", F.pmod(F.xxhash64("id", "start", "ids_crc32", "salt"), F.lit(groups))).drop("salt")

    def run(table: pa.Table) -> pa.Table:
        length, group = table.column("length").to_numpy(), table.column("group")[0].as_py()
        # A fixed order, so that a group that runs again is packed alike.
        order = np.lexsort([table.column("start").to_numpy(), table.column("ids_crc32").to_numpy(), -length])
        window, offset, n = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64), 0
        part = [i for i in order.tolist() if length[i] < capacity]
        for i in order.tolist():
            if length[i] >= capacity:
                window[i], n = n, n + 1
        sizes = [int(length[i]) for i in part]
        for items in pack_sizes(sizes, capacity):
            at = 0
            for j in sorted(items):
                window[part[j]], offset[part[j]] = n, at
                at += sizes[j]
            n += 1
        table = table.drop_columns(["group"])
        return table.append_column("sequence_id", pa.array(group * GROUP_WINDOWS + window, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema if f.name != "group")
    packed = dealt.groupBy("group").applyInArrow(run, f"{fields}, sequence_id long, offset long")
    return packed.withColumnRenamed("id", id_col)


def sequences(packed: DataFrame, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """From ``pack(..., with_ids=True)``: per sequence_id its length and its ids,
    padded to the capacity.  A sequence is bounded by the capacity."""
    whole = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))

    def run(batches):
        for batch in batches:
            ids = []
            for parts in batch.column(2).to_pylist():
                flat = np.frombuffer(b"".join(p["ids"] for p in parts), dtype="<u4")
                ids.append(np.pad(flat, (0, capacity - len(flat)), constant_values=pad_id).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int64()))], names=["sequence_id", "length", "ids"])

    return whole.mapInArrow(trimmed(run), "sequence_id long, length long, ids array<long>")
