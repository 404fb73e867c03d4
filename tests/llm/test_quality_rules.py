import random
import re

import pytest
from pyspark.sql import functions as F

from lexloom.llm import quality_rules as rules

SCHEMA = "doc_id long, text string, n_words string, KEPT int, _text string"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {j for at in seen.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def rows():
    rng = random.Random(4)
    pool = ["a", "b", "c", "Der", "é\U0001f600", "##", "|", "x" * 40, "!!"]
    texts = ["".join(rng.choice(pool) + rng.choice([" ", " ", "\n", "\t", "  ", "\x0b"]) for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 9, 60, 300]))) for _ in range(120)]
    texts += [None, "", " \n\x0c", "a a a a", "a b a b a b", "a\nb\na\n\n \n ", "\na b c\r\na b c\r\n", " a b", " ".join(["w"] * 5000), " ".join(str(i) for i in range(20000))]
    return [(i, t, "x", 1, "y") for i, t in enumerate(texts)] + [(None, "a b c d", None, None, None), (0, texts[0], "x", 1, "y")]


def test_measures_equal_brute_force(spark):
    data = rows()
    docs = spark.createDataFrame(data, SCHEMA)
    got = rules.measures(docs).collect()
    want = sorted(((r[0] is None, r[0] or 0, *brute(r[1])) for r in data))
    assert sorted((r.id is None, r.id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want


@pytest.mark.parametrize("sample", [0, 5, 1000])
def test_order_never_changes_the_verdict(spark, sample):
    docs = spark.createDataFrame(rows(), SCHEMA)
    lazy = rules.cascade(docs, sample_rows=sample)
    full = rules.cascade(docs, owed=("n_words", "n_repeat_words"), sample_rows=sample)
    plain = rules.measures(docs)
    keep = ~sum((r.rejects(plain).cast("int") for r in rules.RULES), start=plain["n_words"] * 0).cast("boolean")
    want = sorted(((r.id, r.k) for r in plain.select("id", keep.alias("k")).collect()), key=str)
    for out in (lazy, full):
        assert sorted(((r.doc_id, r.kept) for r in out.collect()), key=str) == want


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert rules.cascade(empty).collect() == []
    assert len(rules.order_rules(empty)) == len(rules.RULES)


def test_cheap_and_selective_rules_come_first(spark):
    docs = spark.createDataFrame([(i, "a b " * 2, "x", 1, "y") for i in range(20)], SCHEMA)
    assert rules.order_rules(docs)[0].name == "few_words"


def test_dear_rules_come_last(spark):
    """Two rules that reject alike; the one whose measure takes longer waits."""
    docs = spark.createDataFrame([(i, "a b " * 500, "x", 1, "y") for i in range(400)], SCHEMA)
    dear = F.size(F.filter(F.transform(F.sequence(F.lit(1), F.lit(3000)), lambda i: F.sha2(F.concat("_text", i.cast("string")), 256)), lambda h: h == "")).cast("long")
    known = [rules.Measure("dear", dear), rules.Measure("cheap", F.size("_words").cast("long"))]
    pair = [rules.Rule("a_dear", ("dear",), lambda m: m["dear"] == 0), rules.Rule("b_cheap", ("cheap",), lambda m: m["cheap"] > 0)]
    assert [r.name for r in rules.order_rules(docs, pair, measures=known, sample_rows=20)] == ["b_cheap", "a_dear"]
    # What is owed costs nothing.
    assert [r.name for r in rules.order_rules(docs, pair, measures=known, sample_rows=20, owed=("dear", "cheap"))] == ["a_dear", "b_cheap"]


def test_rejected_texts_never_reach_later_measures(spark):
    docs = spark.createDataFrame([(1, "few words", "x", 1, "y"), (2, "w " * 80, "x", 1, "y")], SCHEMA)
    trap = F.when(F.size("_words") < 50, F.raise_error(F.lit("reached"))).otherwise(F.lit(0)).cast("long")
    known = [*rules.base_measures(), rules.Measure("trap", trap)]
    pair = [rules.RULES[0], rules.Rule("trap", ("trap",), lambda m: m["trap"] > 0)]
    got = {r.doc_id: r.rejected_by for r in rules.cascade(docs, ordered=pair, measures=known, owed=("n_words",)).collect()}
    assert got == {1: "few_words", 2: None}
    with pytest.raises(Exception, match="reached"):
        rules.cascade(docs, ordered=pair[::-1], measures=known).collect()


def test_the_query_computes_only_what_is_owed_for_every_row(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    out = rules.cascade(docs, owed=("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    for pattern in ("[^!?]+", "p{Lu}"):
        lines = [x for x in plan.split("\n") if pattern in x]
        assert lines and all("CASE WHEN" in x and x.index("CASE WHEN") < x.index(pattern) for x in lines)
