"""Near duplicates by b-bit MinHash (operator 2).

A document's set holds its distinct shingles of five words; documents are
linked from a Jaccard similarity of 0.75 on, and the classes wanted are the
connected components of the links.

1. Signature: 128 minima under random linear permutations.  Bands of four
   minima give 32 keys; a pair at 0.75 shares none of them with chance
   (1 - 0.75^4)^32 = 5e-6.  The low 2 bits of the minima, packed, are kept.
2. Documents with equal sets form one class at once, so a group of copies of
   any size is one candidate.  A class is known by a 64-bit hash of its set's
   digest, as its least id may be another's too.
3. Classes that share a band key are joined to a pseudo-random member of the
   bucket: as many edges as members.  Where a bucket has just two classes, their
   bit counts must allow a similarity: with collision chance 1/4, the estimate
   is (matches / 128 - 1/4) / (3/4), and 0.5 is over five deviations below 0.75.
4. The components of these edges are candidate groups, a class being in one at
   most.  Only for these are full sets made, in a second scan that a bitmap of
   fixed size keeps to the texts wanted.  Each group is checked exactly on full
   sets inside tasks, by an inverted index.
5. A group over BLOCK classes is dealt into blocks, and its centre, the class
   that most candidates met in, goes to every block.  Blocks are checked apart;
   classes that this links with the centre, directly or not, are one component
   already, so no pair of them is looked at again.  Only the others meet the
   other blocks.  A group of near copies thus costs what its rows cost, and no
   link is lost.  Tasks return spanning forests of links, never pairs.

Defined results: null text counts as empty; empty sets are linked with nothing;
rows with a null id have no component (null) and are kept; of rows that share
id and text all have one result; rows that share an id but not the text follow
each its own text's class; a long text is hashed piece by piece and its set is
whole; an empty table gives no rows; other columns are ignored.  Ids are whole
numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import TEXT_ROWS, bitmap_of, drop_rows, pick, stage, text_slices, trim, trimmed, where_in_bitmap
from .components import components
from .shingles import Shingler, mix
from .tokens import release

MINIMA = 128
BAND_ROWS = 4
BITS = 2
#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Least estimate from bit counts that goes on to the exact check.
ESTIMATE = 0.5
#: Classes of one candidate group, and hashes of their sets, that a block holds;
#: a task holds two at most.
BLOCK = 512
BLOCK_HASHES = 1 << 20
SLICE_CHARS = 1_000_000

_RNG = np.random.default_rng(77)
_A = (_RNG.integers(0, 2**32, MINIMA, dtype=np.uint64) | 1).astype(np.uint32)[:, None]
_B = _RNG.integers(0, 2**32, MINIMA, dtype=np.uint64).astype(np.uint32)[:, None]
_ROW = _RNG.integers(0, 2**64, BAND_ROWS, dtype=np.uint64) | np.uint64(1)
_BAND = _RNG.integers(0, 2**64, MINIMA // BAND_ROWS, dtype=np.uint64)
_PER_LONG = 64 // BITS
_SHIFT = (np.arange(_PER_LONG, dtype=np.uint64) * np.uint64(BITS))[None, :]
PACKED = [f"s{i}" for i in range(MINIMA * BITS // 64)]
BANDS = [f"b{i}" for i in range(MINIMA // BAND_ROWS)]


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of a set under each permutation."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)[None, :]
    best = None
    for lo in range(0, x.shape[1], 1024):
        part = (_A * x[:, lo : lo + 1024] + _B).min(axis=1)
        best = part if best is None else np.minimum(best, part)
    return best


def band_keys(m: np.ndarray) -> np.ndarray:
    return mix((m.reshape(-1, BAND_ROWS).astype(np.uint64) * _ROW).sum(axis=1, dtype=np.uint64) + _BAND).view(np.int64)


def pack_bits(m: np.ndarray) -> np.ndarray:
    low = (m & np.uint32(2**BITS - 1)).astype(np.uint64).reshape(-1, _PER_LONG)
    return np.bitwise_or.reduce(low << _SHIFT, axis=1).view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """From (id, text): id, n, digest of the set, band keys, and packed low bits;
    all but n are null for empty sets.  A third column, ``key``, is kept."""
    keyed = len(docs.columns) > 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        shingler = Shingler()
        for batch in batches:
            for lo, hi, texts in text_slices(batch.column(1), SLICE_CHARS):
                n, digest, longs = [], [], np.zeros((len(texts), len(BANDS) + len(PACKED)), np.int64)
                for row, s in zip(longs, shingler.sets(texts)):
                    n.append(len(s))
                    digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    if len(s):
                        m = minima(s)
                        row[: len(BANDS)], row[len(BANDS) :] = band_keys(m), pack_bits(m)
                none = np.array(n, np.int64) == 0
                cols = [batch.column(0)[lo:hi], pa.array(n, pa.int64()), pa.array(digest, pa.binary()), *(pa.array(c, pa.int64(), mask=none) for c in longs.T)]
                cols += [batch.column(2)[lo:hi]] if keyed else []
                yield pa.RecordBatch.from_arrays(cols, names=["id", "n", "digest", *BANDS, *PACKED, *(["key"] if keyed else [])])

    return docs.mapInArrow(trimmed(run), "id long, n long, digest binary, " + ", ".join(f"{c} long" for c in (*BANDS, *PACKED)) + ", key binary" * keyed)


def estimate(left: str, right: str):
    """Collision-corrected similarity from bit counts of the packed low bits."""
    ones = (1 << 64) // 3  # 0101...
    differ = " + ".join(f"bit_count((({left}{p} ^ {right}{p}) | shiftrightunsigned({left}{p} ^ {right}{p}, 1)) & {ones}L)" for p in PACKED)
    chance = 1 / 2**BITS
    return ((F.lit(1.0) - F.expr(differ) / MINIMA) - chance) / (1 - chance)


def set_table(docs: DataFrame) -> DataFrame:
    """From (id, text): id, the full set, packed, and its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        shingler = Shingler()
        for batch in batches:
            for lo, hi, texts in text_slices(batch.column(1), SLICE_CHARS):
                sets = [s.tobytes() for s in shingler.sets(texts)]
                digests = [hashlib.blake2b(s, digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(sets, pa.binary()), pa.array(digests, pa.binary())], names=["id", "hashes", "digest"])

    return docs.mapInArrow(trimmed(run), "id long, hashes binary, digest binary")


def linked(sets: list[np.ndarray], side: np.ndarray, tight: np.ndarray | None = None, percent: int = PERCENT) -> np.ndarray:
    """For each set the number of the first set of its component.  Pairs of the
    same non-zero side are not compared, as they have met in another task, nor
    pairs of tight sets, which are in one component already."""
    m = len(sets)
    root = np.arange(m)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = int(root[i])
        return i

    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), sizes)
    _, token = np.unique(flat, return_inverse=True)
    order = np.argsort(token, kind="stable")
    posts, ends = owner[order], np.cumsum(np.bincount(token))
    begins = np.concatenate([[0], ends[:-1]])
    at = np.concatenate([[0], np.cumsum(sizes)])
    tight = np.zeros(m, bool) if tight is None else tight
    first = np.zeros(m, bool)
    if tight.any():
        # Each pair is seen from a set that is not tight.
        first = tight
    for i in np.flatnonzero(~first).tolist():
        own = token[at[i] : at[i + 1]]
        lo, n = begins[own], ends[own] - begins[own]
        shared = n > 1
        lo, n = lo[shared], n[shared]
        if not len(n):
            continue
        places = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        common = np.bincount(posts[places], minlength=m)
        hit = 100 * common >= percent * (sizes + sizes[i] - common)
        hit[: i + 1] &= first[: i + 1]
        if side[i]:
            hit &= side != side[i]
        for j in np.flatnonzero(hit).tolist():
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
    return np.array([find(i) for i in range(m)])


_LINKS = "a long, b long, g long, blocks int, block int, loose boolean"
_DEALT = ("id", "g", "blocks", "block", "centre", "tight", "hashes", "i", "j")


def _check(table: pa.Table) -> pa.Table:
    """A candidate group, a block of one with the group's centre, or what must
    still meet of two blocks: (a, b) for each class that is linked, b standing
    for its component.

    Of a block every class comes back, ``loose`` unless it is in the centre's
    component, for which the centre stands."""
    ids = table.column("id").to_numpy()
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    sets = [np.frombuffer(h, dtype=np.uint64) for h in table.column("hashes").take(pa.array(order)).to_pylist()]
    block, tight = table.column("block").to_numpy()[order], table.column("tight").to_numpy()[order]
    i, j, g, blocks, centre = (table.column(c)[0].as_py() for c in ("i", "j", "g", "blocks", "centre"))
    root = linked(sets, np.where(block == i, 1, 2) if i != j else np.zeros(len(ids), np.int64), tight if i != j else None)
    to, loose = ids[root], np.ones(len(ids), bool)
    given = root != np.arange(len(ids))
    if blocks > 1 and i == j:
        loose = root != root[np.searchsorted(ids, centre)]
        to, given = np.where(loose, to, centre), block == i
    if len(ids) > 500:
        del sets
        trim()
    n = int(given.sum())
    return pa.table({"a": pa.array(ids[given], pa.int64()), "b": pa.array(to[given], pa.int64()), "g": pa.array([g] * n, pa.int64()), "blocks": pa.array([blocks] * n, pa.int32()), "block": pa.array(block[given], pa.int32()), "loose": pa.array(loose[given], pa.bool_())})


def _links(sets: DataFrame, any_blocked: bool) -> DataFrame:
    """(a, root) over all candidate groups, from (id, g, blocks, centre, hashes):
    each class that is linked with another, and what stands for its component."""
    dealt = sets.withColumns({"block": F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"), "tight": F.lit(False)})
    own = F.when(F.col("id") == F.col("centre"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    apart = dealt.withColumn("i", F.explode(own)).withColumn("j", F.col("i"))
    found = stage(apart.select(*_DEALT).groupBy("g", "i", "j").applyInArrow(_check, _LINKS), "links")
    inside = found.where("blocks = 1").select("a", F.col("b").alias("root"))
    if not any_blocked:
        return inside
    parts = found.where("blocks > 1")
    stars = parts.where("a <> b").select("a", "b")
    # At most a group's blocks for each group.
    loose = parts.where("loose").groupBy(F.col("g").alias("_g")).agg(F.collect_set("block").alias("with_loose"))
    if loose.isEmpty():
        return inside.unionByName(stars.withColumnRenamed("b", "root"))
    others = F.when(F.col("loose"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.col("with_loose"))
    met = parts.join(stage(loose, "loose", about=0), F.col("g") == F.col("_g")).withColumn("other", F.explode(others)).where("other <> block")
    met = met.select(F.col("a").alias("_id"), (~F.col("loose")).alias("_tight"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    pairs = dealt.drop("tight").join(met, F.col("id") == F.col("_id")).withColumnRenamed("_tight", "tight")
    across = pairs.select(*_DEALT).groupBy("g", "i", "j").applyInArrow(_check, _LINKS).select("a", "b")
    return inside.unionByName(components(stars.unionByName(across), "blocked-links"))


def text_key(text: Column) -> Column:
    """What tells texts apart: SHA-256, null as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_key: bool = False) -> DataFrame:
    """Per row: id, n_shingles, component_id, kept (and its text's key); odd rows
    as the module says."""
    rows = pick(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    extra = ["key"] if with_key else []
    sigs = stage(signatures(rows.withColumn("key", text_key(F.col("text"))) if with_key else rows), "signatures", TEXT_ROWS)

    named = sigs.where("n > 0 AND id IS NOT NULL")
    # All numbers, so that copies meet in a hash table and nothing is sorted.
    merged = named.groupBy("digest").agg(F.min("id").alias("rep"), *(F.first(c).alias(c) for c in ("n", *BANDS, *PACKED)))
    classes = stage(merged.select(F.xxhash64("digest").alias("class"), "digest", "rep", "n", F.array(*BANDS).alias("bands"), *PACKED), "classes")

    keys = classes.select("class", F.explode("bands").alias("key"))
    # XOR with the key, itself random, makes the choice of the centre random.
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min(F.col("class").bitwiseXOR(F.col("key"))).alias("least")).where("members > 1")
    shared = shared.select(F.col("key").alias("_key"), F.col("least").bitwiseXOR(F.col("key")).alias("centre"), (F.col("members") == 2).alias("pair"))
    edges = keys.join(shared, F.col("key") == F.col("_key")).where("class <> centre").groupBy("class", "centre").agg(F.min("pair").alias("pair"))
    edges = stage(edges, "star-edges")
    bits = lambda to: classes.select(F.col("class").alias(f"{to}class"), *(F.col(p).alias(f"{to}{p}") for p in PACKED))
    pairs = edges.where("pair").join(bits("l_"), F.col("class") == F.col("l_class")).join(bits("r_"), F.col("centre") == F.col("r_class"))
    likely = pairs.where(estimate("l_", "r_") >= ESTIMATE).select(F.col("class").alias("a"), F.col("centre").alias("b"))
    candidates = components(likely.unionByName(edges.where("NOT pair").select(F.col("class").alias("a"), F.col("centre").alias("b"))), "candidates")

    members = candidates.select(F.col("a").alias("member"), F.col("root").alias("g")).unionByName(candidates.select(F.col("root").alias("member"), F.col("root").alias("g")).distinct())
    n = 2 * candidates.count()  # nodes at most
    degrees = edges.groupBy(F.col("centre").alias("_centre")).agg(F.count(F.lit(1)).alias("degree"))
    sized = members.join(classes.select(F.col("class").alias("member"), "n", "rep"), "member").join(degrees, F.col("member") == F.col("_centre"), "left")
    sized = stage(sized.select("member", "g", "n", "rep", F.coalesce("degree", F.lit(0)).alias("degree")), "members", about=n)
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_HASHES)).cast("int")
    # Written, so that a hot group can be split over tasks when it meets its size.
    sizes = stage(sized.groupBy("g").agg(blocks.alias("blocks"), F.max_by("member", "degree").alias("centre")).withColumnRenamed("g", "_g"), "sizes", about=n)
    groups = stage(sized.join(sizes, F.col("g") == F.col("_g")).select("member", "g", "blocks", "centre", "rep"), "groups", about=n)
    any_blocked = not groups.where("blocks > 1").isEmpty()

    wanted = where_in_bitmap(rows.where("id IS NOT NULL"), "id", bitmap_of(groups, "rep"))
    # A class by one of its rows: its least id may have rows of other texts.  Rows
    # are made one, and meet their group, by one exchange on the same keys.
    made = set_table(wanted.select("id", "text")).select(F.xxhash64("digest").alias("class"), "id", "hashes").dropDuplicates(["class", "id"])
    sets = made.join(groups, (F.col("class") == F.col("member")) & (F.col("id") == F.col("rep")))
    sets = stage(sets.select(F.col("class").alias("id"), "g", "blocks", "centre", "hashes"), "group-sets", TEXT_ROWS)
    inside = _links(sets, any_blocked)

    # A component is named by the least id of its classes.  Written, so that a hot
    # component can be split over tasks.
    linked_to = inside.unionByName(inside.select(F.col("root").alias("a"), "root").distinct())
    of_class = stage(linked_to.join(classes.select("class", "rep"), F.col("a") == F.col("class")).select("a", "root", "rep"), "linked", about=n)
    least = stage(of_class.groupBy("root").agg(F.min("rep").alias("least")).withColumnRenamed("root", "_root"), "least", about=n)
    named_by = of_class.join(least, F.col("root") == F.col("_root")).select("a", "least")
    roots = classes.select("digest", "class", "rep").join(named_by, F.col("class") == F.col("a"), "left").select(F.col("digest").alias("_digest"), F.coalesce("least", "rep").alias("component"))
    out = sigs.select("id", "n", "digest", *extra).join(roots, F.col("digest") == F.col("_digest"), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"), *extra)


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those linked to one of smaller id, columns as they
    were.  Rows are told apart by id and text: rows with a null id and rows whose
    texts are empty or null stay, repeated rows stay or go together, a row of
    another text stays whatever its id, and an empty table stays empty.  Only
    texts that the bitmap of dropped ids lets through are shuffled."""
    quick, exact = {"id": lambda i, t: i.cast("long")}, {"key": lambda i, t: text_key(t)}
    dropped = near_duplicates(docs, id_col, text_col, with_key=True).where(~F.col("kept")).select(F.col(id_col).alias("id"), "key").distinct()
    return drop_rows(docs, id_col, text_col, stage(dropped, "dropped"), quick, exact)
