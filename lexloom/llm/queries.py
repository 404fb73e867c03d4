"""The thin queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, minhash, mixing, packing, pii, quality_rank, quality_rules, sharding, token_files, toxicity


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(documents(spark, sf_dir))


def op2_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


def op3_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(documents(spark, sf_dir), labels(spark, sf_dir))


def op4_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rank.quality_scores(documents(spark, sf_dir), labels(spark, sf_dir))
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))  # as the contract fixes it


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_files.write_token_files(documents(spark, sf_dir), end_id=0)
    return token_files.read_token_files(spark, out, token_files.crc_of, "long", "ids_crc32")


def op6_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.cascade(documents(spark, sf_dir), owed=("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    base_failed = (F.col("n_words") < quality_rules.BASE_WORDS) | (100 * F.col("n_repeat_words") > quality_rules.BASE_REPEAT_PERCENT * F.col("n_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), "kept")


def op7_differencing_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op8_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_dedup(documents(spark, sf_dir), hash_all=True)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.col("full_hash").alias("text_sha256"))


def op10_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find_personal_data(documents(spark, sf_dir))
    counts = (pii.counted(F.col("base"), k).alias(f"n_{k}") for k in pii.BASE_KINDS)
    found = F.size("spans").cast("long")
    return out.select("doc_id", *counts, F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"), pii.counted(F.col("spans"), "secret").alias("n_secret"), found.alias("n_spans"), (found > 0).alias("has_personal_data"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pfair_mix": op1_pfair_mix,
    "op2_bbit_minhash": op2_bbit_minhash,
    "op3_nnpu_toxicity": op3_nnpu_toxicity,
    "op4_pairwise_quality": op4_pairwise_quality,
    "op5_token_files": op5_token_files,
    "op6_rule_cascade": op6_rule_cascade,
    "op7_differencing_packs": op7_differencing_packs,
    "op8_rendezvous_shards": op8_rendezvous_shards,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_boosted_pii": op10_boosted_pii,
}

ORACLE_SQL: dict[str, str] = {
    # All pairs that share a shingle, and every class's reach.
    "op2_bbit_minhash": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
             s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END) AS g FROM w),
             n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
             p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
             l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * shared >= 75 * (nx.n + ny.n - shared)),
             e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
             r AS (SELECT doc_id, doc_id AS to_id FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.to_id = e.x),
             c AS (SELECT doc_id, min(to_id) AS component_id FROM r GROUP BY 1)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
    """,
    "op6_rule_cascade": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
             w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
             g AS (SELECT doc_id, i, words[i:i + 2] AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 4)),
             r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
             c AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
             m AS (SELECT doc_id,
                          len(words)::BIGINT AS n_words,
                          length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
                          length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
                          (len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
                           - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
                          length(regexp_replace(text, '[^!?]', '', 'g')) AS n_marks,
                          length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) AS n_capitals
                   FROM w)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
               n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed,
               NOT (n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words
                    OR 10 * n_symbols > n_words
                    OR word_chars < 2 * n_words OR word_chars > 15 * n_words
                    OR (n_dup_lines >= 10 AND 10 * n_dup_lines > n_words)
                    OR 10 * n_capitals > 4 * word_chars
                    OR 2 * n_marks > n_words) AS kept
        FROM m LEFT JOIN c USING (doc_id)
    """,
    # crc32 byte by byte from its table, which its polynomial gives.
    "op8_rendezvous_shards": r"""
        WITH tab AS (SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY n) AS t FROM (SELECT unnest(range(256)) AS n)),
             b AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)) AS bytes FROM documents),
             c AS (SELECT doc_id, size, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32 FROM b, tab),
             s AS (SELECT *, unnest(range(17)) AS s FROM c),
             h AS (SELECT *, 1 / -ln((('0x' || substr(md5(doc_id || ':' || s), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE) AS score FROM s),
             g AS (SELECT doc_id, any_value(size) AS size, any_value(text_crc32) AS text_crc32, arg_max(s, score) FILTER (s < 16) AS shard, arg_max(s, score) AS grown_shard FROM h GROUP BY doc_id)
        SELECT doc_id, size, text_crc32, 'key' AS law, shard::INTEGER AS shard,
               row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5(doc_id || ':' || text_crc32 || ':slot'), 1, 8))::BIGINT % 512, doc_id, size, text_crc32) - 1 AS slot,
               grown_shard::INTEGER AS grown_shard
        FROM g
    """,
    "op9_exact_dedup": r"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
             h AS (SELECT doc_id, points, sha256(t) AS text_sha256 FROM d)
        SELECT doc_id,
               first_value(doc_id) OVER w AS keep_id,
               count(*) OVER (PARTITION BY text_sha256) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept,
               text_sha256
        FROM h WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)
    """,
}
