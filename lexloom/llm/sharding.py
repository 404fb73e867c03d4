"""Weighted rendezvous sharding (operator 8): every record goes to the shard
with the largest ``-weight / ln(u)``, u being a hash of record key and shard.

A shard's score for a key depends on that pair alone, so one more shard takes
rows only into itself, and a change of weight moves rows only to or from that
shard.  Everything is built of SQL functions.

Defined results: null and empty texts have size 1; null keys all share the key
of the empty string, apart from no row; equal keys share a shard; slots number
every row, repeated ones too, without a gap; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import RANK_BUCKETS, number_groups
from .common import pick, stage


def _unit(key: Column, shard: int) -> Column:
    """A number in (0, 1) from 52 bits of md5 over "key:shard"."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(float(2**52))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key.  Ties, which need equal hashes, go to the lower shard."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    scores = [F.struct((F.lit(float(w)) / -F.ln(_unit(text, s))).alias("score"), F.lit(-s).alias("minus")) for s, w in enumerate(weights)]
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return (-best["minus"]).cast("int")


def shard(docs: DataFrame, weights: Sequence[float] = (1.0,) * 16, grown_by: float = 1.0, id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None) -> DataFrame:
    """Per row: id, size, text_crc32, shard, slot within the shard, and
    grown_shard, its shard once a further one of weight ``grown_by`` is added."""
    rows = pick(docs, id=id_col, text=text_col, key=key_col or id_col)
    text = F.coalesce("text", F.lit(""))
    now = rows.select("id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.col("key").cast("string").alias("key"))
    both = now.withColumn("home", rendezvous(F.col("key"), weights))
    # The newcomer only has to beat the present winner.
    new = len(weights)
    key = F.coalesce("key", F.lit(""))
    score = lambda s, w: F.lit(float(w)) / -F.ln(_unit(key, s))
    home = F.element_at(F.array(*(F.struct(F.lit(float(w)).alias("w"), F.lit(f":{s}").alias("tag")) for s, w in enumerate(weights))), F.col("home") + 1)
    bits = F.conv(F.substring(F.md5(F.concat(key, home["tag"])), 1, 13), 16, 10).cast("double")
    held = home["w"] / -F.ln((bits + 0.5) / F.lit(float(2**52)))
    both = both.withColumn("grown", F.when(score(new, grown_by) > held, F.lit(new)).otherwise(F.col("home")))
    light = stage(both, "shards")
    bucket = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("id").cast("string"), F.col("crc").cast("string"), F.lit("slot"))), 1, 8), 16, 10).cast("long") % RANK_BUCKETS
    order = [F.col("id").asc_nulls_first(), F.col("size"), F.col("crc")]
    numbered = number_groups(light, ["home"], bucket.cast("int"), order, "slot", few=True)
    return numbered.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.col("home").alias("shard"), "slot", F.col("grown").cast("int").alias("grown_shard"))
