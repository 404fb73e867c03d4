from pyspark.sql import functions as F

from lexloom.operators import backends
from lexloom.plans import pipelines


def test_span_corpus(spark):
    abstracts = spark.createDataFrame([(i, "Title", "about TP53 and aspirin") for i in range(12)], "PMID long, Title string, Abstract string")
    rows = [(i, "T1", "GENE-Y", 12, 16, "TP53") for i in range(12)] + [(i, "T2", "CHEMICAL", 21, 28, "aspirin") for i in range(12)] + [(0, "T3", "CHEMICAL", 12, 28, "TP53 and aspirin"), (1, "T3", "CHEMICAL", 13, 15, "P5")]
    mentions = spark.createDataFrame(rows, "PMID long, Arg string, Type string, Start_offset int, End_offset int, String string")
    got = pipelines.span_corpus(abstracts, mentions, k=3, min_class_size=2).where("split = 'val'").collect()
    assert sorted(r.PMID for r in got) == list(range(12))
    by = {r.PMID: [tuple(e) for e in r.entities] for r in got}
    assert by[5] == [(2, 3, "GENE"), (4, 5, "CHEMICAL")] and by[0] == [(2, 5, "CHEMICAL")] and by[1] == by[5]


def test_relations_to_edges(spark):
    texts = spark.createDataFrame([("g1", "we gave Aspirin to TP53 cells"), ("g2", "nothing")], "k string, t string")
    edges = pipelines.extract_relations(texts, "k", "t", backends.OfflineTagger, lambda: backends.OfflineModel("relations"), "{text}\n{entities}").collect()
    assert [(r.graph_id, r.src, r.dst, r.label) for r in edges] == [("g1", "Aspirin", "TP53", "INHIBITOR")]


def test_exam_path(spark):
    q = spark.createDataFrame([("which HIV drug", "why", 2, "a", None, "c", "d", "single"), ("other", "why", 1, "hiv", "b", "c", "d", "single"), ("HIV", None, 1, "a", "b", "c", "d", "single"), ("HIV", "e", 1, "a", "b", "c", "d", "multi")], "question string, exp string, cop int, opa string, opb string, opc string, opd string, choice_type string")
    lex = spark.createDataFrame([("HIV + x(1)",)], "Virus string")
    terms = pipelines.term_list({"Virus": (lex, " + ", "+=()")})
    subset = pipelines.exam_subset(q, terms, ["question", "opa"])
    assert sorted(terms) == ["HIV", "x1"] and subset.count() == 3
    prompts = {r.question for r in pipelines.exam_prompts(subset).collect()}
    assert prompts == {"which HIV drug 1) a 2) nan 3) c 4) d", "other 1) hiv 2) b 3) c 4) d"}
    docs = "[Document(page_content='PubMedID: 1\\\\nText: . Hello', metadata={'relevance_score': 0.5}), Document(page_content='b', metadata={'relevance_score': 0.7})]"
    row = pipelines.parsed_answers(spark.createDataFrame([("q", docs)], "question string, RETRIEVED_DOCUMENTS string")).collect()[0]
    assert (row.page_content_1, row.page_content_2, row.page_content_3, round(row.mean_relevance_score, 6)) == ("Hello", "b", None, 0.6)
    assert pipelines.chosen_options(spark.createDataFrame([(1, "Answer: b")], "k int, r string"), "k", "r").collect()[0].Extracted_Answer == 2


def test_retrieval_answers(spark):
    texts = spark.createDataFrame([(1, "aspirin dose"), (2, "weather report")], "vec_id long, text string")
    vectors = backends.embed(texts, "vec_id", "text", backends.OfflineEmbedder)
    q = backends.embed(spark.createDataFrame([(9, "aspirin dose"), (8, "unrelated")], "query_id long, question string"), "query_id", "question", backends.OfflineEmbedder)
    out = pipelines.answer_questions(q, vectors, texts, F.col("text"), "{context}\nQ: {question}", backends.OfflineModel, rerank=lambda d: F.length("text"))
    got = {r.query_id: (r.context, r.reply) for r in out.collect()}
    assert got == {9: ("aspirin dose", "Q: aspirin dose"), 8: (None, "Q: unrelated")}
    made = pipelines.synthesise_questions(texts, "vec_id", "text", backends.OfflineModel, "ask about {context}", size=8, per_document=1).collect()
    assert {(r.vec_id, r.reply) for r in made} == {(1, "ask about aspirin"), (2, "ask about weather")}
