"""Extra columns whose names clash, in any letter case, do no harm anywhere."""

import pytest

from lexloom.llm import exact_dedup, minhash, mixing, packing, pii, quality_rank, quality_rules, sharding, token_files, toxicity

NAMES = ["doc_id", "text", "source", "DOC_ID", "Text", "_bucket", "_maybe", "c0", "id", "ID", "hashes", "position", "kept", "_in_bucket", "score"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, ("word%d " % (i % 7)) * (20 + i % 3), "s%d" % (i % 3), *([i] * (len(NAMES) - 3))) for i in range(40)]
    return spark.createDataFrame(rows, ", ".join(f"x{i} {'string' if i in (1, 2) else 'long'}" for i in range(len(NAMES)))).toDF(*NAMES)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2, i) for i in range(40)], "a long, b int, c int, d long").toDF("doc_id", "quality", "toxic", "LABEL")


@pytest.mark.parametrize(
    "apply",
    [
        lambda d, t: exact_dedup.exact_dedup(d),
        lambda d, t: minhash.near_duplicates(d),
        lambda d, t: mixing.schedule(d),
        lambda d, t: packing.pack(d),
        lambda d, t: pii.find_personal_data(d),
        lambda d, t: quality_rank.quality_scores(d, t),
        lambda d, t: toxicity.toxicity_scores(d, t),
        lambda d, t: quality_rules.cascade(d),
        lambda d, t: sharding.shard(d),
        lambda d, t: token_files.read_token_files(d.sparkSession, token_files.write_token_files(d)),
    ],
)
def test_one_row_each(docs, labels, apply):
    assert sorted(r.doc_id for r in apply(docs, labels).select("doc_id").collect()) == list(range(40))


@pytest.mark.parametrize("keep", [exact_dedup.keep_one_of_each, minhash.keep_one_of_each, mixing.mixed])
def test_columns_stay(docs, keep):
    out = keep(docs)
    assert out.columns == NAMES and 0 < len(out.collect()) <= 40


def test_good_ones_keep_their_columns(docs, labels):
    assert quality_rank.keep_good(docs, labels).columns == NAMES
    quality_rank.keep_good(docs, labels).collect()
