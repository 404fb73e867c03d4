import re

from pyspark.sql import functions as F

from lexloom.functions import text as X
from lexloom.functions import vectors as V
from lexloom.operators import lexicon


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column.alias("r")).collect()[0].r


def test_tokenizer(spark):
    assert one(spark, "CD4-T_x éa b, x!", X.tokenize("c")) == ["CD4-T_x", "éa", "b", ",", "x", "!"]
    assert one(spark, "", X.tokenize("c")) == [] and one(spark, None, X.tokenize("c")) is None


def test_context_prefix_by_line_break(spark):
    assert one(spark, "PubMedID: 1\nText: . Hello", X.strip_context_prefix("c")) == "PubMedID: 1\n . Hello"
    assert one(spark, "PubMedID: 1\\nText: . Hello", X.clean_content("c")) == "Hello"


def test_document_lists(spark):
    raw = "[Document(page_content='a b', metadata={'relevance_score': 0.5}), Document(page_content=\"it's\", metadata={'relevance_score': 0.7})]"
    assert one(spark, raw, X.page_contents("c")) == ["a b", "it's"]
    assert one(spark, raw, X.page_contents("c", literal=True)) == ["a b"]
    assert one(spark, raw, F.round(X.mean_present(X.relevance_scores("c")), 6)) == 0.6
    assert [d.page_content for d in one(spark, raw, X.python_documents("c"))] == ["a b", "it's"]
    assert one(spark, "no list", X.python_documents("c")) is None


def test_means_and_wide(spark):
    assert one(spark, [0.5, None, 0.7], X.mean_present("c"), "array<double>") == 0.6
    assert one(spark, [None], X.mean_present("c"), "array<double>") is None
    row = spark.createDataFrame([(["a"],)], "c array<string>").select(*X.wide("c", "p", 2)).collect()[0]
    assert (row.p_1, row.p_2) == ("a", None)


def test_options_and_templates(spark):
    assert one(spark, None, X.numbered_options(F.lit("a"), "c")) == "1) a 2) nan"
    assert one(spark, None, X.numbered_options(F.lit("a"), "c", null_literal=None)) is None
    assert one(spark, "x", X.template("<{a}|{b}>", a="c", b=F.lit(1))) == "<x|1>"
    assert one(spark, {"A": "x", "B": None}, X.as_python_dict("c"), "map<string,string>") == "{'A': 'x', 'B': 'None'}"


def test_escapes_keep_their_order(spark):
    assert one(spark, r"a\nb", X.decode_escapes("c")) == "a\nb"
    assert one(spark, r"a\\nb", X.decode_escapes("c")) == "a\nb"
    assert one(spark, None, X.decode_escapes("c")) is None


def test_detokenize_and_punctuation(spark):
    assert one(spark, ["a", ",", "b", "…"], X.detokenize("c"), "array<string>") == "a, b …"
    assert one(spark, "a , b ! c", X.tidy_punctuation("c")) == "a, b! c"


def test_lenient_json(spark):
    parse = X.lenient_json("c", "k int, s string")
    assert one(spark, 'Sure:\n{"k": 1, "s": "a\tb"} ok', parse).k == 1
    assert one(spark, "nothing", X.has_fields(parse, ["k"])) is False
    assert one(spark, '{"s": "x"}', X.has_fields(parse, ["k"])) is False


def test_option_letter(spark):
    for text, want in (("The answer is (2).", 2), ("c) because", 3), ("Answer: d", 4), ("hmm", None), (None, None), ("Option 1 fits", 1)):
        assert one(spark, text, X.option_letter("c")) == want, text


def test_chunks(spark):
    assert one(spark, "abcdefg", X.chunks("c", 3)) == ["abc", "def", "g"]
    assert one(spark, "abcdef", X.chunks("c", 4, 2)) == ["abcd", "cdef", "ef"]
    assert one(spark, "", X.chunks("c", 3)) == [] and one(spark, None, X.chunks("c", 3)) is None
    long = "First one. Second two.\n\nThird " + "x" * 30
    got = one(spark, long, X.split_recursively("c", F.lit(12)))
    assert "".join(got) == long and max(map(len, got)) <= 12


def test_array_batches(spark):
    assert one(spark, [1, 2, 3, 4, 5], X.array_batches("c", 2), "array<int>") == [[1, 2], [3, 4], [5]]
    assert one(spark, [], X.array_batches("c", 2), "array<int>") == [] and one(spark, None, X.array_batches("c", 2), "array<int>") is None


def test_lookup_and_pick(spark):
    assert one(spark, "b", X.lookup({"a": 1, "b": 2}, F.col("c"), -1)) == 2
    assert one(spark, "z", X.lookup({"a": 1}, F.col("c"), -1)) == -1
    assert one(spark, "k", X.pick_by_hash(["x", "y"], "c")) in ("x", "y")
    assert one(spark, "A+B(1)", X.strip_characters("c", "+=()")) == "AB1" and one(spark, "Arg1:T7", X.part("c", ":", 1)) == "T7"


def test_vectors(spark):
    assert one(spark, [3.0, 4.0], V.normalise("c"), "array<double>") == [0.6, 0.8]
    assert one(spark, [0.0], V.normalise("c"), "array<double>") == [0.0] and one(spark, [0.0], V.cosine("c", "c"), "array<double>") is None


def test_lexicon_matching(spark):
    terms = lexicon.clean_terms(spark.createDataFrame([("A + B(1)",), ("B1 + ",)], "v string"), "v", " + ", "+=()")
    assert sorted(r.term for r in terms.collect()) == ["A", "B1"]
    p = lexicon.alternation(["Hepatitis C", "É+"])
    assert re.match(r"\(\?iu\)", p)
    df = spark.createDataFrame([(1, "hepatitis c é+", "HEPATITIS C"), (2, None, "x"), (1, "hepatitis c é+", "HEPATITIS C")], "k int, a string, b string")
    assert lexicon.match_any(df, ["a", "b"], p).count() == 1
    assert lexicon.match_any(df, ["a", "b"], p, dedupe=False).count() == 4
    assert one(spark, ["no", "É+"], lexicon.any_item_matches("c", p), "array<string>") is True


def test_large_lexicon_equals_pattern(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["Alpha beta", "gamma", None, "alphabet", "x ALPHA."])], "k int, t string")
    many = [f"none{i}" for i in range(300)] + ["alpha"]
    assert sorted(r.k for r in lexicon.filter_by_terms(df, ["t"], many).collect()) == [0, 3, 4]


def test_lexicons_of_any_size_agree(spark):
    texts = ["Idiots!", "ßtraße", "STRASSE", "\u212aelvin", "ſaft", "İx", "ÉTÉ", "plain", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    terms = ["idiot", "straße", "kelvin", "saft", "été", "i̇x", ""]
    few = sorted(r.k for r in lexicon.filter_by_terms(df, ["t"], terms).collect())
    many = sorted(r.k for r in lexicon.filter_by_terms(df, ["t"], terms + [f"none{i}" for i in range(300)]).collect())
    assert few == many and 0 in few
    twice = spark.createDataFrame([("idiot", "idiots"), ("x", "IDIOT")], "a string, b string")
    assert lexicon.filter_by_terms(twice, ["a", "b"], terms + [f"none{i}" for i in range(300)], dedupe=False).count() == 3
    assert lexicon.filter_by_terms(df, ["t"], []).count() == 0


def test_hits_by_many_terms(spark, monkeypatch):
    df = spark.createDataFrame([(1, "A a b"), (2, "b"), (3, None)], "k int, t string")
    terms = spark.createDataFrame([("a",), ("B",), ("zz",), (None,)], "term string")
    want = {("a", 1, 2), ("B", 2, 2)}
    assert {tuple(r) for r in lexicon.hits_by_term(df, "t", terms, "k").collect()} == want
    monkeypatch.setattr(lexicon, "LITERAL_TERMS", 1)
    assert {tuple(r) for r in lexicon.hits_by_term(df, "t", terms, "k").collect()} == want
