import random

import pytest
from pyspark.sql import functions as F

from lexloom.functions.text import tokenize
from lexloom.operators import joins, spans

SPAN = "array<struct<start:int,end:int,label:string>>"


def one(spark, value, column, kind):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column.alias("r")).collect()[0].r


def test_overlap_fixture(spark):
    got = one(spark, [(0, 5, "G"), (3, 12, "C"), (12, 14, "G"), (0, 3, "X")], spans.resolve_overlaps("c"), SPAN)
    assert [tuple(x) for x in got] == [(0, 3, "X"), (3, 12, "C"), (12, 14, "G")]


def test_overlaps_equal_greedy(spark):
    rng = random.Random(2)
    for _ in range(20):
        given = [(s, s + rng.randint(1, 15), "L") for s in (rng.randint(0, 60) for _ in range(25))]
        want = []
        for s in sorted(given, key=lambda x: (x[0] - x[1], x[0])):
            if all(s[1] <= k[0] or k[1] <= s[0] for k in want):
                want.append(s)
        assert [tuple(x) for x in one(spark, given, spans.resolve_overlaps("c"), SPAN)] == sorted(want)


def test_merge_fixture(spark):
    ents = [("G", "aa", 0, 2), ("G", "bb", 3, 5), ("C", "c", 5, 6), ("C", "d", 8, 9)]
    kind = "array<struct<label:string,text:string,start:int,end:int>>"
    got = [tuple(x) for x in one(spark, ents, spans.merge_adjacent("c"), kind)]
    assert got == [("G", "aa bb", 0, 5), ("C", "c", 5, 6), ("C", "d", 8, 9)]
    assert [tuple(x) for x in one(spark, got, spans.merge_adjacent("c"), kind)] == got
    assert one(spark, [], spans.merge_adjacent("c"), kind) == []


@pytest.mark.parametrize("tokens,want,at", [("a b c b c", "b c", 1), ("a", "a b", None), ("a b", "x", None), ("a b", "", None)])
def test_first_subsequence(spark, tokens, want, at):
    df = spark.createDataFrame([(tokens.split(), want.split())], "t array<string>, w array<string>")
    assert df.select(spans.first_subsequence(F.col("t"), F.col("w")).alias("r")).collect()[0].r == at


def test_subsequence_matches(spark):
    docs = spark.createDataFrame([(1, "x a b c d e f g"), (2, "a b"), (3, "a b c d e x"), (4, "")], "d long, t string").select("d", tokenize("t").alias("tokens"))
    items = spark.createDataFrame([(10, "a b c d e f"), (11, "b"), (12, ""), (13, "d e")], "i long, t string").select("i", tokenize("t").alias("tokens"))
    got = {tuple(r) for r in spans.subsequence_matches(docs, items, "d", "i").collect()}
    assert got == {(1, 10, 1), (1, 11, 2), (2, 11, 1), (3, 11, 1), (1, 13, 4), (3, 13, 3)}


def placed(text):
    import re

    return [(m.start(), m.end(), m.group()) for m in re.finditer(r"\w+(?:[-_]\w+)*|\S", text)]


def test_alignment_equals_brute_force(spark):
    texts = {1: "Ab, cd-ef  gh!", 2: "é x", 3: "", 4: "  lead a"}
    docs = spark.createDataFrame(list(texts.items()), "d long, t string")
    tokens = spans.exploded_tokens(docs, "d", "t")
    assert {(r.d, r.idx, r.start, r.end, r.token) for r in tokens.collect()} == {(d, i, *p) for d, t in texts.items() for i, p in enumerate(placed(t))}
    points = [(d, i, i) for d, t in texts.items() for i in range(len(t) + 2)]
    got = {(r.d, r.point): r.idx for r in spans.char_to_token(docs, spark.createDataFrame(points, "d long, _id long, point int"), "d", "t").collect()}
    for d, t in texts.items():
        for i in range(len(t) + 2):
            if (d, i) in got or placed(t):
                assert got.get((d, i)) == next((k for k, (s, e, _) in enumerate(placed(t)) if s <= i < e), None)
    cuts = [(d, s * 100 + e, s, e) for d, t in texts.items() for s in range(len(t)) for e in range(s, len(t) + 1)]
    found = {(r.d, r.start, r.end): (r.start_tok, r.end_tok) for r in spans.contract_to_tokens(docs, spark.createDataFrame(cuts, "d long, _id long, start int, end int"), "d", "t").collect()}
    for d, _, s, e in cuts:
        inside = [k for k, (a, b, _) in enumerate(placed(texts[d])) if s <= a and b <= e]
        assert found.get((d, s, e)) == ((inside[0], inside[-1]) if inside else None)


def relation_fixture(spark, subject="Arg1:T1"):
    rel = spark.createDataFrame([(1, "INHIBITOR", "Arg2:T2", subject)], "PMID long, Predicate string, Object string, Subject string")
    texts = spark.createDataFrame([(1, "abc de XYZ1")], "PMID long, Text string")
    ments = spark.createDataFrame([(1, "T1", "CHEMICAL", 0, 3, "abc"), (1, "T2", "GENE", 7, 11, "XYZ1"), (1, "T2", "GENE", 9, 11, "later")], "PMID long, Arg string, Type string, Start_offset int, End_offset int, String string")
    return rel, texts, ments


def test_relation_rows_and_records(spark):
    rel, texts, ments = relation_fixture(spark)
    rows = joins.relation_rows(rel, texts, ments, strict=True)
    r = rows.collect()[0]
    assert (r.Subject, r.Subject_Type, r.Object, r.Object_Start, r.Relation) == ("abc", "CHEMICAL", "XYZ1", 7, "INHIBITOR")
    rec = spans.relation_records(rows, texts, text="Text").collect()[0]
    assert rec.tokenized_text == ["abc", "de", "XYZ1"]
    assert [tuple(n) for n in rec.ner] == [(0, 0, "CHEMICAL", "abc"), (2, 2, "GENE", "XYZ1")]
    assert rec.relations[0].head.mention == "abc" and rec.relations[0].tail.position == [2, 2]


def test_missing_mention(spark):
    args = relation_fixture(spark, "Arg1:T9")
    assert joins.relation_rows(*args).count() == 0
    with pytest.raises(Exception, match="no mention"):
        joins.relation_rows(*args, strict=True).collect()


def test_mention_rows(spark):
    a = spark.createDataFrame([(1, "T", "A"), (2, None, "B")], "PMID long, Title string, Abstract string")
    m = spark.createDataFrame([(1, "GENE-N", "x"), (1, "C", None), (2, "C", "y")], "PMID long, Type string, String string")
    got = joins.mention_rows(a, m, merge_types={"GENE-N": "GENE"}).collect()
    assert [(r.PMID, r.Text, r.Type) for r in got] == [(1, "T A", "GENE")]
    assert joins.shared_keys(a, m, "PMID").count() == 2


def test_runs_and_offsets(spark):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(["a", "a", None, None, "b", "a"])], "k int, i int, x string")
    assert [r.run for r in spans.runs(df, ["k"], [F.col("i")], "x").orderBy("i").collect()] == [1, 1, 2, 2, 3, 4]
    off = spans.running_offset(df, ["k"], [F.col("i")], F.lit(2)).orderBy("i").collect()
    assert [r.offset for r in off] == [0, 2, 4, 6, 8, 10]


def test_highlight_and_back(spark):
    kind = "tokens array<string>, ner array<struct<start_tok:int,end_tok:int,label:string>>"
    df = spark.createDataFrame([(["a", ",", "b", "c", "d", "."], [(2, 3, "G"), (4, 4, "C")]), ([], [])], kind)
    got = [[tuple(x) for x in r.h] for r in df.select(spans.highlight("tokens", "ner").alias("h")).collect()]
    assert got == [[("a,", None), ("b c", "G"), ("d", "C"), (".", None)], []]
    back = spark.createDataFrame([([("a, ", None), ("b-x c", "G"), ("d", "")],)], "e array<struct<token:string,label:string>>")
    r = back.select(spans.tokens_and_labels("e").alias("r")).collect()[0].r
    assert r.tokens == ["a", ",", "b-x", "c", "d"] and [tuple(x) for x in r.ner] == [(2, 3, "G")]


def test_long_texts_are_placed(spark):
    text = " ".join(["ab", "c-d,", "é"] * 3000)
    docs = spark.createDataFrame([(1, text), (2, None)], "d long, t string")
    want = [(i, *p) for i, p in enumerate(placed(text))]
    every = spans.exploded_tokens(docs, "d", "t")
    assert [tuple(r)[1:] for r in every.orderBy("idx").collect()] == want
    some = spans.exploded_tokens(docs, "d", "t", lambda t: t.rlike("^c"))
    assert [tuple(r)[1:] for r in some.orderBy("idx").collect()] == [w for w in want if w[3][0] == "c"]


def test_clusters_of_overlaps(spark):
    given = [(10, 12, "A"), (0, 4, "B"), (3, 11, "C"), (12, 15, "D"), (20, 21, "E")]
    got = one(spark, given, spans.overlap_clusters("c"), SPAN)
    assert [[tuple(x) for x in c] for c in got] == [[(0, 4, "B"), (3, 11, "C"), (10, 12, "A")], [(12, 15, "D")], [(20, 21, "E")]]
    assert one(spark, [], spans.resolve_overlaps("c"), SPAN) == [] and one(spark, None, spans.resolve_overlaps("c"), SPAN) is None


def test_records_keep_whole_relations_only(spark):
    rows = [(1, "a", "G", 0, 1, "b", "C", 2, 3, "R"), (1, "a", "A", 0, 1, " ", "C", 1, 2, "Q"), (2, "x", "G", 0, 1, "?", "C", 9, 10, "R")]
    rel = spark.createDataFrame(rows, "k long, Subject string, Subject_Type string, Subject_Start int, Subject_End int, Object string, Object_Type string, Object_Start int, Object_End int, Relation string")
    docs = spark.createDataFrame([(1, "a b"), (2, "x"), (3, "y")], "k long, text string")
    got = spans.relation_records(rel, docs, "k").collect()
    assert [r.k for r in got] == [1] and [x.relation_text for x in got[0].relations] == ["R"]
    assert [tuple(n) for n in got[0].ner] == [(0, 0, "A", "a"), (1, 1, "C", "b")]
