"""Retrieval: vectors and keywords, fusion, reranking, prompts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import TOKEN, let, tokenize
from .lexicon import LITERAL_TERMS
from .ranking import spread, top_n

#: Queries and vectors that meet in one task where queries are dealt in blocks.
QUERY_BLOCK = 1_024
VECTOR_BLOCK = 8_192
#: Up to so many bytes of queries go to every executor; vectors then stay put.
QUERY_BYTES = 64_000_000
#: Rows of vectors that meet the queries at once.
SLICE = 2_048
_FOUND = "q long, d long, score double"


def _blocks(df: DataFrame, key: str, rows: int) -> int:
    return max(1, -(-df.count() // rows))


def _unit(column: pa.Array | pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors scaled to length one, and which of them count: those of the given
    width, without nulls, and not zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    fits = sizes == width
    flat = column.filter(pa.array(fits)).flatten() if width else pa.array([], pa.float64())
    rows = np.zeros((len(column), width))
    if width and fits.any():
        rows[fits] = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
    norm = np.linalg.norm(rows, axis=1) if width else np.zeros(len(column))
    whole = np.isfinite(norm) & (norm > 0)
    return np.divide(rows, norm[:, None], out=np.zeros_like(rows), where=whole[:, None]), whole


def _best(scores: np.ndarray, ids: np.ndarray, k: int, least: float | None) -> np.ndarray:
    """Places of the k best, ties by id."""
    fine = np.flatnonzero(scores >= least) if least is not None else np.arange(len(scores))
    if len(fine) > 4 * k:
        fine = fine[scores[fine] >= np.partition(scores[fine], len(fine) - k)[len(fine) - k]]
    return fine[np.lexsort([ids[fine], -scores[fine]])[:k]]


def _found(q: list, d: list, score: list) -> dict:
    return {"q": pa.array(np.concatenate(q) if q else [], pa.int64()), "d": pa.array(np.concatenate(d) if d else [], pa.int64()), "score": pa.array(np.concatenate(score) if score else [], pa.float64())}


def _against_all(asked: pa.Table, width: int, vectors: DataFrame, k: int, least: float | None, skip_self: bool) -> DataFrame:
    """Every part of (id, v) passes on its own k best for each query; vectors are
    read where they are."""
    unit, whole = _unit(asked.column("v"), width)
    own, unit = asked.column("id").to_numpy()[whole], unit[whole]
    held = vectors.sparkSession.sparkContext.broadcast((own, unit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, matrix = held.value
        ids = [np.zeros(0, np.int64)] * len(queries)
        top = [np.zeros(0)] * len(queries)
        worst = np.full(len(queries), -np.inf if least is None else np.nextafter(least, -np.inf))
        for batch in batches:
            for lo in range(0, len(batch), SLICE):
                part = batch.slice(lo, SLICE)
                rows, fits = _unit(part.column(1), width)
                at, rows = part.column(0).to_numpy(zero_copy_only=False)[fits], rows[fits]
                if not len(at):
                    continue
                for first in range(0, len(queries), QUERY_BLOCK):
                    scores = matrix[first : first + QUERY_BLOCK] @ rows.T
                    if skip_self:
                        scores[at[None, :] == queries[first : first + QUERY_BLOCK, None]] = -np.inf
                    for i in np.flatnonzero(scores.max(axis=1) >= worst[first : first + QUERY_BLOCK]).tolist():
                        new = np.flatnonzero(scores[i] >= max(worst[first + i], -2.0))
                        s, d = np.concatenate([top[first + i], scores[i, new]]), np.concatenate([ids[first + i], at[new]])
                        best = _best(s, d, k, least)
                        top[first + i], ids[first + i] = s[best], d[best]
                        if len(best) == k:
                            worst[first + i] = s[best[-1]]
        sizes = [len(x) for x in ids]
        if sum(sizes):
            yield pa.RecordBatch.from_pydict(_found([np.repeat(queries, sizes)], ids, top))

    return vectors.mapInArrow(run, _FOUND)


def _in_blocks(q: DataFrame, v: DataFrame, keys: Sequence[str], width: int, k: int, least: float | None, skip_self: bool) -> DataFrame:
    """Queries and vectors (id, v, and the block's keys) that share a block meet
    in a task as one matrix product, which passes on its own k best."""

    def run(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        ids, (unit, whole) = table.column("id").to_numpy(), _unit(table.column("v"), width)
        left, right = np.flatnonzero(asks & whole), np.flatnonzero(~asks & whole)
        out: tuple[list, list, list] = [], [], []
        for lo in range(0, len(left) if len(right) else 0, QUERY_BLOCK):
            for i, own in zip(left[lo : lo + QUERY_BLOCK].tolist(), unit[left[lo : lo + QUERY_BLOCK]] @ unit[right].T):
                if skip_self:
                    own[ids[right] == ids[i]] = -np.inf
                best = _best(own, ids[right], k, -2.0 if least is None else least)
                for column, x in zip(out, (np.full(len(best), ids[i]), ids[right[best]], own[best])):
                    column.append(x)
        return pa.table(_found(*out))

    both = q.withColumn("asks", F.lit(True)).unionByName(v.withColumn("asks", F.lit(False)))
    return both.groupBy(*keys).applyInArrow(run, _FOUND)


def _pairs(df: DataFrame, key: str, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v"))


def nearest(queries: DataFrame, vectors: DataFrame, k: int, query_key: str = "query_id", key: str = "vec_id", column: str = "embedding", least: float | None = None, skip_self: bool = False) -> DataFrame:
    """Exact cosine top-k: (query, vec, score, rank), scores at least ``least``,
    ties by id.

    Up to QUERY_BYTES of queries, by a count, go to every executor, and vectors
    meet them where they are read.  More queries are dealt into blocks, each of
    which meets each block of vectors in a task of bounded size.  Either way a
    task passes on its own top k, and a window merges these.  Null, zero and
    shorter vectors, and rows with a null id, match nothing; repeated queries
    count once for each time they stand there."""
    q, v = _pairs(queries, query_key, column), _pairs(vectors, key, column)
    n, width = q.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    if n * max(width, 1) * 8 <= QUERY_BYTES:
        met = _against_all(q.toArrow(), width, v, k, least, skip_self)
    else:
        nq, nv = max(1, -(-n // QUERY_BLOCK)), _blocks(vectors, key, VECTOR_BLOCK)
        block = lambda blocks: F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
        every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
        met = _in_blocks(q.withColumn("i", block(nq)).withColumn("j", every(nv)), v.withColumn("j", block(nv)).withColumn("i", every(nq)), ["i", "j"], width, k, least, skip_self)
    best = top_n(met, ["q"], [F.col("score").desc(), F.col("d")], k)
    return best.select(F.col("q").alias(query_key), F.col("d").alias(key), "score", "rank")


@dataclass(frozen=True)
class VectorIndex:
    """An inverted index over vectors: centroids, and a table (id, v, list)."""

    centroids: np.ndarray
    table: DataFrame


def _lists_of(vectors: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """The n nearest lists of each vector, nearest first."""
    return np.argsort(-(vectors @ centroids.T), axis=1, kind="stable")[:, :n]


def build_index(vectors: DataFrame, path: str, key: str = "vec_id", column: str = "embedding", lists: int = 64, sample: int = 20_000, rounds: int = 12) -> VectorIndex:
    """Fits centroids by spherical k-means on at most ``sample`` vectors (those
    of least hash, so a fit repeats), deals *every* vector to its nearest and
    writes the table in directories by list, the centroids beside it.  Vectors
    that ``nearest`` would leave out are left out.  With fewer vectors than
    lists there are as many lists as vectors."""
    spark = vectors.sparkSession
    v = _pairs(vectors, key, column)
    width = v.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0]
    held = v.orderBy(F.xxhash64("id", "v"), "id").limit(sample).toArrow()
    unit, whole = _unit(held.column("v"), width)
    unit = unit[whole]
    centroids = unit[:: max(1, len(unit) // lists)][:lists].copy()
    for _ in range(rounds):
        own = _lists_of(unit, centroids, 1)[:, 0] if len(unit) else np.zeros(0, int)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, unit)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norm > 0, sums / np.maximum(norm, 1e-300), centroids)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, fits = _unit(batch.column(1), width)
            at = pa.array(np.flatnonzero(fits))
            own = _lists_of(rows[fits], centroids, 1)[:, 0] if fits.any() else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(own, pa.int32())], names=["id", "v", "list"])

    v.mapInArrow(deal, "id long, v array<double>, list int").repartition("list", F.pmod(F.xxhash64("id"), F.lit(16))).write.mode("overwrite").partitionBy("list").parquet(f"{path}/lists")
    spark.createDataFrame(pa.table({"list": pa.array(range(len(centroids)), pa.int32()), "v": pa.array(list(centroids), pa.list_(pa.float64()))})).coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    """A stored index; its centroids are few and come to the driver."""
    rows = spark.read.parquet(f"{path}/centroids").orderBy("list").toArrow()
    width = max((len(x) for x in rows.column("v").to_pylist()), default=0)
    schema = "id long, v array<double>, list int"
    return VectorIndex(_unit(rows.column("v"), width)[0], spark.read.schema(schema).parquet(f"{path}/lists"))


def probe(index: VectorIndex, queries: DataFrame, k: int, n_lists: int = 8, query_key: str = "query_id", key: str = "vec_id", column: str = "embedding", least: float | None = None, skip_self: bool = False) -> DataFrame:
    """``nearest`` among the vectors of each query's ``n_lists`` nearest lists:
    approximate, exact where all lists are probed.  A list is dealt into blocks
    of VECTOR_BLOCK vectors, so a hot one is spread over tasks."""
    centroids, width = index.centroids, index.centroids.shape[1] if index.centroids.ndim == 2 else 0
    q = _pairs(queries, query_key, column)

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, fits = _unit(batch.column(1), width)
            at = pa.array(np.flatnonzero(fits))
            own = _lists_of(rows[fits], centroids, n_lists).astype(np.int32) if fits.any() else []
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(list(own), pa.list_(pa.int32()))], names=["id", "v", "lists"])

    asked = q.mapInArrow(lists, "id long, v array<double>, lists array<int>").select("id", "v", F.explode("lists").alias("list"))
    blocks = index.table.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / VECTOR_BLOCK).cast("int").alias("_n")).withColumnRenamed("list", "_list")
    sized = lambda df: df.join(blocks, F.col("list") == F.col("_list"))
    asked = sized(asked).select("id", "v", "list", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("block"))
    vectors = sized(index.table).select("id", "v", "list", F.pmod(F.xxhash64("id"), "_n").cast("int").alias("block"))
    met = _in_blocks(asked, vectors, ["list", "block"], width, k, least, skip_self)
    best = top_n(met, ["q"], [F.col("score").desc(), F.col("d")], k)
    return best.select(F.col("q").alias(query_key), F.col("d").alias(key), "score", "rank")


def rerank(found: DataFrame, score: Column, n: int = 4, query_key: str = "query_id", key: str = "vec_id") -> DataFrame:
    """The best ``n`` of each query's candidates by another score."""
    return top_n(found.withColumn("rerank_score", score), [query_key], [F.col("rerank_score").desc(), F.col(key)], n, "rerank")


def term_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf, length)."""
    tokens = docs.select(key, F.transform(tokenize(text), F.lower).alias("t"))
    rows = tokens.select(key, F.size("t").alias("length"), F.explode("t").alias("term"))
    return rows.groupBy(key, "length", "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25(docs: DataFrame, queries: DataFrame, k: int, key: str = "doc_id", text: str = "text", query_key: str = "query_id", terms: str = "terms", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """Okapi top-k for queries given as term arrays: (query, doc, score, rank).

    Terms are single tokens in lower case.  Only postings of terms asked for
    leave a document's row: up to LITERAL_TERMS of them are picked inside it,
    more are met by a join.  Documents without a term asked for, and null texts,
    have no rank."""
    asked = queries.select(query_key, F.explode(F.array_distinct(terms)).alias("term"))
    wanted = asked.select("term").distinct()
    n, mean = spread(docs.select(text)).agg(F.count(F.lit(1)), F.avg(F.regexp_count(text, F.lit(TOKEN)))).first()
    few = [r[0] for r in wanted.limit(LITERAL_TERMS + 1).collect()]
    tokens = spread(docs.select(key, text)).select(key, let(F.transform(tokenize(text), F.lower), lambda t: F.struct(F.size(t).alias("length"), (F.filter(t, lambda x: x.isin(few)) if few and len(few) <= LITERAL_TERMS else t).alias("t"))).alias("d"))
    rows = tokens.select(key, "d.length", F.explode("d.t").alias("term"))
    if len(few) > LITERAL_TERMS:
        rows = rows.join(wanted, "term", "left_semi")
    tf = rows.groupBy(key, "length", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count("tf").alias("df"))  # of tf, so that both uses of the table are one
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.lit(mean or 1.0)))
    scored = tf.join(df, "term").withColumn("w", weight).join(asked, "term")
    total = scored.groupBy(query_key, key).agg(F.sum("w").alias("score"))
    return top_n(total, [query_key], [F.bround("score", 9).desc(), F.col(key)], k)


def fuse(lists: Sequence[tuple[DataFrame, float]], query_key: str, key: str, constant: int = 60) -> DataFrame:
    """Weighted reciprocal rank fusion: sum of weight / (constant + rank)."""
    arms = [d.select(query_key, key, (F.lit(w) / (F.lit(constant) + F.col("rank"))).alias("s")) for d, w in lists]
    union = arms[0]
    for a in arms[1:]:
        union = union.unionByName(a)
    return union.groupBy(query_key, key).agg(F.sum("s").alias("score"))


def stuff_prompt(found: DataFrame, contents: DataFrame, template: Column, query_key: str, key: str, order: Column, sep: str = "\n\n") -> DataFrame:
    """Each query's retrieved documents through a template, joined in order."""
    rows = found.join(contents, key).withColumn("_t", template).withColumn("_o", order)
    got = rows.groupBy(query_key).agg(F.array_sort(F.collect_list(F.struct("_o", "_t"))).alias("_a"))
    return got.select(query_key, F.array_join(F.transform("_a", lambda x: x["_t"]), sep).alias("context"))


def contexts_by_seed(chunks: DataFrame, seeds: DataFrame, most: int = 3, least: float = 0.5, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """For each seed chunk up to ``most`` others that are similar enough."""
    return nearest(seeds.withColumnRenamed(key, "seed_id"), chunks, most, "seed_id", key, column, least, skip_self=True)


