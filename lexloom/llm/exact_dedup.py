"""Exact duplicates by progressive refinement (operator 9).

Texts are compared without their white space.  One scan takes each text's
length and the hash of a short prefix, which are written without the text; a
group that is alone at its length, or at its length and prefix, needs nothing
more.  Rows of groups still in doubt are known by id and number of code points,
and a second scan squeezes and hashes only those texts in full; it never moves
a text, as the rows in doubt reach it as a bitmap of bounded size.  A set bit by
chance only costs a hash; the final grouping is by length, prefix hash and
SHA-256 together.  Where every digest is owed (``hash_all``) one scan takes all
of them.

Defined results: null text counts as empty; all texts of white space alone are
equal; very long texts are compared whole; rows with a null id take part and
are kept only if no row with an id shares their text; of rows that share id,
text and length each is judged as the same document (all kept or all dropped);
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, bitmap_of, drop_rows, flag_by_bitmap, pick, stage

PREFIX_CHARS = 128


def squeezed(text: Column) -> Column:
    """The text without white space; null as empty."""
    return reduce(lambda t, c: F.replace(t, F.lit(c)), SPACE, F.coalesce(text, F.lit("")))


def points(text: Column) -> Column:
    return F.length(F.coalesce(text, F.lit("")))


def prefix_hash(squeezed: Column) -> Column:
    return F.xxhash64(F.substring(squeezed, 1, PREFIX_CHARS))


def _judged(docs: DataFrame, id_col: str, text_col: str, hash_all: bool) -> DataFrame:
    """Per row: id, keep_id, group_size, kept, full_hash, points, length and
    prefix."""
    rows = pick(docs, id=id_col, text=text_col)
    text = F.col("text")
    bare = rows.select("id", points(text).alias("points"), squeezed(text).alias("squeezed"))
    shape = ("id", "points", F.length("squeezed").alias("length"), prefix_hash(F.col("squeezed")).alias("prefix"))
    full = F.sha2("squeezed", 256).alias("full_hash")

    # Levels 1 and 2: length, then length and prefix hash, from one aggregate.
    level2 = stage(bare.select(*shape, *([full] if hash_all else [])), "exact-shapes")
    doubt = stage(level2.groupBy("length", "prefix").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "exact-doubt")
    if hash_all:
        alone, level3 = None, level2
        doubtful = flag_by_bitmap(level3, "length, prefix", bitmap_of(doubt, "length, prefix"), "_doubtful").where("_doubtful").drop("_doubtful")
    else:
        # Level 3: the full hash, only of rows that may be in doubt.
        inner = doubt.select(F.col("length").alias("_l"), F.col("prefix").alias("_p"))
        suspects = stage(level2.join(inner, (F.col("length") == F.col("_l")) & (F.col("prefix") == F.col("_p"))).select("id", "points").distinct(), "exact-suspects")
        known = bitmap_of(suspects, "id, points")
        again = flag_by_bitmap(rows.withColumn("points", points(text)), "id, points", known, "_doubtful").where("_doubtful")
        again = again.select("id", "points", squeezed(text).alias("squeezed"))
        level3 = doubtful = stage(again.select(*shape, full), "exact")
        alone = flag_by_bitmap(level2, "id, points", known, "_doubtful").where("NOT _doubtful").withColumn("full_hash", F.lit(None).cast("string"))

    key = ["length", "prefix", "full_hash"]
    best = F.min(F.struct((-F.col("points")).alias("minus"), F.col("id").isNull().alias("no_id"), F.col("id")))
    groups = doubtful.groupBy(*key).agg(best.alias("best"), F.count(F.lit(1)).alias("size")).where("size > 1")
    groups = groups.select(*(F.col(k).alias(f"g_{k}") for k in key), F.col("best.id").alias("keep"), (-F.col("best.minus")).alias("keep_points"), "size")
    # Written, so that both sides of the join are plain exchanges and a hot group
    # can be split over tasks.
    groups = stage(groups, "exact-groups")
    same = reduce(lambda a, b: a & b, (F.col(k) == F.col(f"g_{k}") for k in key))
    single = F.col("size").isNull()
    out = level3.join(groups, same, "left").select(
        "id",
        F.when(single, F.col("id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("id").eqNullSafe(F.col("keep")) & (F.col("points") == F.col("keep_points")))).alias("kept"),
        "full_hash",
        "points",
        "length",
        "prefix",
    )
    if alone is None:
        return out
    return out.unionByName(alone.select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "full_hash", "points", "length", "prefix"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_all: bool = False) -> DataFrame:
    """Per row: id, keep_id, group_size, kept, and full_hash (null where the
    cascade did not need it, unless ``hash_all``).

    Of equal texts the row with the most code points in its original text, then
    the smallest id, stays."""
    return _judged(docs, id_col, text_col, hash_all).select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", "full_hash")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without the rows that ``exact_dedup`` drops, columns as
    they were.  Rows are told apart by id, length and text, so one of another
    text stays whatever its id, null ones too; of texts that are null, empty or
    blank one row stays; repeated rows stay or go together; an empty table stays
    empty.  Only texts that the bitmap of dropped rows lets through are
    shuffled."""
    quick = {"id": lambda i, t: i, "points": lambda i, t: points(t)}
    exact = {"length": lambda i, t: F.length(squeezed(t)), "prefix": lambda i, t: prefix_hash(squeezed(t)), "full_hash": lambda i, t: F.sha2(squeezed(t), 256)}
    # Rows that are dropped have equals, so their full hash is there.
    dropped = _judged(docs, id_col, text_col, False).where(~F.col("kept")).select(*quick, *exact).distinct()
    return drop_rows(docs, id_col, text_col, stage(dropped, "dropped"), quick, exact)
