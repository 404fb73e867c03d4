"""Queries that write by each sink and read back by each source, and those of
operators that need a table of their own making."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..operators import backends, graphs, lexicon, ranking, retrieval, spans, splits, stats
from ..sources import readers, writers
from ..sources.scratch import scratch
from . import pipelines
from .queries import mentions, printed_documents, query, table


def schema_of(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)


@query
def csv_with_index(spark, sf_dir):
    """Whole documents as CSV with a running number, quotes and line breaks and all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    writers.write_csv(docs, path := scratch(spark, "csv"), index=True, order=["doc_id"])
    back = readers.read_csv(spark, path, schema_of("idx long, doc_id long, text string, source string"))
    return back.select("idx", "doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"), "source")


@query
def csv_without_order(spark, sf_dir):
    """A running number where no order is given: that of the columns' values."""
    parts = table(spark, sf_dir, "part").select(F.col("p_retailprice").cast("decimal(12,2)").alias("price"), "p_partkey")
    writers.write_csv(parts, path := scratch(spark, "csv"), index=True)
    return readers.read_csv(spark, path, schema_of("idx long, price decimal(12,2), p_partkey long")).select("idx", "p_partkey")


@query
def tsv_with_header(spark, sf_dir):
    table(spark, sf_dir, "part").select("p_partkey", "p_type").write.csv(path := scratch(spark, "tsv"), sep="\t", header=True)
    return readers.read_csv(spark, path, schema_of("p_partkey long, p_type string"), sep="\t", multi_line=False)


@query
def tsv_without_header(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 7 == 0, "nan").otherwise(F.col("p_type")).alias("p_type"))
    parts.write.csv(path := scratch(spark, "tsv"), sep="\t", header=False, quote="")
    return readers.read_tsv(spark, path, schema_of("p_partkey long, p_type string"))


@query
def json_lines(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    writers.write_json_lines(turns, path := scratch(spark, "jsonl"))
    return readers.read_json_lines(spark, path, turns.schema).select("conv_id", "turn", F.md5("text").alias("text_md5"))


@query
def json_array(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    spark.createDataFrame([(writers.json_array(nations),)], "value string").write.text(path := scratch(spark, "json"))
    return readers.read_json_array(spark, path, nations.schema)


@query
def keyed_json(spark, sf_dir):
    nations = table(spark, sf_dir, "nation")
    entry = F.struct(F.col("n_nationkey").cast("string"), F.struct("n_name", "n_regionkey"))
    nations.agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value")).write.text(path := scratch(spark, "keyed"))
    return readers.read_keyed_json(spark, path, schema_of("n_name string, n_regionkey int"), "key")


@query
def text_lines(spark, sf_dir):
    table(spark, sf_dir, "part").select("p_type").write.text(path := scratch(spark, "lines"))
    return stats.value_counts(readers.read_lines(spark, path), "line")


@query
def whole_texts(spark, sf_dir):
    table(spark, sf_dir, "nation").select(F.col("n_name").alias("value"), "n_nationkey").write.partitionBy("n_nationkey").text(path := scratch(spark, "texts"))
    found = readers.read_whole_texts(spark, f"{path}/*")
    return found.select(F.regexp_extract("path", "n_nationkey=([0-9]+)", 1).alias("key"), "text")


@query
def rows_to_documents(spark, sf_dir):
    docs = readers.rows_as_documents(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey"), "c_custkey")
    return docs.select(F.col("metadata")["source"].alias("source"), "page_content")


@query
def rows_in_memory(spark, sf_dir):
    kind = "k int, v string"
    return readers.from_rows(spark, [(1, "a"), (2, None)], kind).unionByName(readers.empty(spark, kind))


@query
def stored_vectors(spark, sf_dir):
    table(spark, sf_dir, "embeddings").write.parquet(path := scratch(spark, "vectors"))
    return readers.open_vectors(spark, path).select("vec_id", F.bround(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))


@query
def span_annotations(spark, sf_dir):
    nations = table(spark, sf_dir, "nation")
    pair = F.concat(F.lit("["), F.to_json(F.struct("n_name")).substr(F.lit(11), F.length(F.to_json(F.struct("n_name"))) - 11), F.lit(', {"entities": [[0, '), F.length("n_name"), F.lit(', "NATION"]]}]'))
    whole = nations.agg(F.concat(F.lit('{"classes": ["NATION"], "annotations": ['), F.array_join(F.collect_list(pair), ", "), F.lit("]}")).alias("value"))
    whole.write.text(path := scratch(spark, "spans"))
    return readers.read_span_annotations(spark, path).select("text", F.explode("entities").alias("e")).select("text", "e.start", "e.end", "e.label")


@query
def append_and_resume(spark, sf_dir):
    """A job that broke off after a third of its rows goes on with the others."""
    orders, path = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), scratch(spark, "done")
    writers.append_rows(orders.where("o_orderkey % 3 = 0"), path)
    writers.resume(orders, path, "o_orderkey", lambda d: d)
    return spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_orderkey").alias("n_keys"))


@query
def replaced_table(spark, sf_dir):
    table(spark, sf_dir, "nation").write.parquet(path := scratch(spark, "table"))
    writers.overwrite_in_place(spark.read.parquet(path).where("n_regionkey <> 1").withColumn("n_name", F.lower("n_name")), path)
    return spark.read.parquet(path).select("n_nationkey", "n_name")


@query
def folds_on_disk(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag")
    folds = splits.stratified_folds(lines, "l_orderkey", "l_returnflag", 5, 42, 5)
    writers.write_folds(splits.fold_splits(lines, folds, "l_orderkey", 5), path := scratch(spark, "folds"))
    return spark.read.parquet(path).groupBy(F.col("fold").cast("long").alias("fold"), "split").agg(F.count(F.lit(1)).alias("rows"))


@query
def span_corpus_on_disk(spark, sf_dir):
    got = spans.spans_by_document(mentions(spark, sf_dir), ["doc_id"], ["start"], ["start", "end", "type"])
    writers.write_span_corpus(got, path := scratch(spark, "corpus"))
    return spark.read.parquet(path).select("doc_id", F.explode("entities").alias("e")).groupBy("e.type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_docs"))


@query
def html_report(spark, sf_dir):
    regions = table(spark, sf_dir, "region").select("r_regionkey", "r_name").orderBy("r_regionkey")
    return spark.createDataFrame([(writers.html_table(regions),)], "html string")


# --- columns and orders


@query
def named_columns(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.lit(1).alias("Unnamed: 0"), F.lit(2).alias("Unnamed: 1"))
    return stats.renamed_rows(stats.drop_matching(nations, "^Unnamed"), "n_name", {"FRANCE": "France", "NATION_1": "first"})


@query
def contains_after_cast(spark, sf_dir):
    hit = F.contains(F.col("o_orderkey").cast("string"), F.lit("77"))
    return table(spark, sf_dir, "orders").where(hit).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query
def frequency_order(spark, sf_dir):
    counts = stats.value_counts(table(spark, sf_dir, "part"), "p_type")
    return ranking.number_rows(counts, [-F.col("count"), F.col("p_type")], "place")


@query
def first_of_ties(spark, sf_dir):
    """First rows where positions repeat, within combinations and across them."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_linenumber")
    return stats.keep_first(lines, ["l_partkey"], "l_linenumber")


@query
def trimmed_ties(spark, sf_dir):
    """Head and tail of an order that many rows share."""
    sizes = table(spark, sf_dir, "part").select("p_size")
    left = ranking.trim_sorted(sizes, [F.col("p_size")], [F.col("p_size").desc()], 25, 11)
    return left.groupBy("p_size").agg(F.count(F.lit(1)).alias("n"))


@query
def numbered_by_text_and_decimal(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_retailprice").cast("decimal(12,2)").alias("price"))
    return ranking.number_rows(parts, [F.col("p_brand"), F.col("price"), F.col("p_partkey")], "n").select("p_partkey", "n")


@query
def constant_lookup(spark, sf_dir):
    return table(spark, sf_dir, "region").select("r_regionkey", X.lookup({0: "zero", 3: "three"}, F.col("r_regionkey").cast("int"), "other").alias("said"))


# --- spans, literals, graphs


@query
def highlighted_runs(spark, sf_dir):
    """Tokens of each turn with an entity over its second and third, as stretches."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", X.tokenize(F.coalesce("text", F.lit(""))).alias("tokens"))
    one = F.when(F.size("tokens") >= 3, F.array(F.struct(F.lit(1).alias("start_tok"), F.lit(2).alias("end_tok"), F.lit("X").alias("label")))).otherwise(F.array().cast("array<struct<start_tok:int,end_tok:int,label:string>>"))
    runs = turns.select("conv_id", "turn", F.posexplode(spans.highlight("tokens", one)).alias("pos", "h"))
    return runs.select("conv_id", "turn", F.col("pos").cast("long").alias("pos"), F.col("h.label").alias("label"))


@query
def labelled_pieces(spark, sf_dir):
    """Each conversation's turns as pieces, those of the assistant labelled, to tokens and spans."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.struct("turn", F.coalesce("text", F.lit("")).alias("token"), F.when(F.col("role") == "assistant", "A").otherwise("").alias("label")).alias("e"))
    got = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("e")).alias("a"))
    made = got.select("conv_id", spans.tokens_and_labels(F.transform("a", lambda x: F.struct(x["token"].alias("token"), x["label"].alias("label")))).alias("m"))
    covered = F.aggregate("m.ner", F.lit(0), lambda a, x: a + x["end_tok"] - x["start_tok"] + 1)
    return made.select("conv_id", F.size("m.tokens").cast("long").alias("n_tokens"), F.size("m.ner").cast("long").alias("n_spans"), covered.cast("long").alias("n_covered"))


@query
def python_literals(spark, sf_dir):
    parsed = printed_documents(spark, sf_dir).select("conv_id", X.python_documents("documents").alias("d"))
    return parsed.select("conv_id", F.size("d").cast("long").alias("n"), F.md5(F.array_join(F.transform("d", lambda x: x["page_content"]), "|")).alias("contents_md5"))


@query
def recursive_chunks(spark, sf_dir):
    """Chunks that give the text again, none over its size."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    cut = docs.select("doc_id", X.split_recursively("text", F.lit(512)).alias("c"))
    return cut.select("doc_id", F.md5(F.array_join("c", "")).alias("text_md5"), F.coalesce(F.array_max(F.transform("c", F.length)) <= 512, F.lit(True)).alias("fits"))


@query
def graph_from_arrays(spark, sf_dir):
    """Each order's supplier lists, parts as targets and flags as labels."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("p"), F.col("l_partkey") % 7).alias("d"), F.col("l_returnflag").alias("f"))
    got = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "f", "d"))).alias("a"))
    arrays = got.select("l_orderkey", F.concat(F.lit("o"), F.col("l_orderkey")).alias("s"), F.transform("a", lambda x: x["d"]).alias("d"), F.transform("a", lambda x: x["f"]).alias("f"))
    return graphs.edges_from_arrays(arrays, "l_orderkey", "s", "d", "f").select("graph_id", "src", "dst", "label")


# --- models and chains


@query
def failing_rows_alone(spark, sf_dir):
    """A model that fails on some prompts fails those rows only."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    out = backends.generate(turns, "text", Picky)
    return out.select("conv_id", "turn", F.col("reply").isNull().alias("failed"), F.col("error").isNotNull().alias("said_why"))


class Picky:
    """Refuses prompts of an odd length."""

    name = "picky"

    def generate(self, prompts):
        if any(len(p) % 2 for p in prompts):
            raise ValueError("odd")
        return [p.upper() for p in prompts]


@query
def retrieval_chain(spark, sf_dir):
    """First turns as questions against benchmark passages: embed, retrieve over
    a threshold, rerank, stuff, answer."""
    texts = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long").alias("vec_id"), "text")
    questions = table(spark, sf_dir, "conversations").where("turn = 0").select(F.col("conv_id").cast("long").alias("query_id"), F.col("text").alias("question"))
    vectors = backends.embed(texts, "vec_id", "text", backends.OfflineEmbedder)
    asked = backends.embed(questions, "query_id", "question", backends.OfflineEmbedder)
    out = pipelines.answer_questions(asked, vectors, texts, X.template("Content: {t}", t="text"), "{context}\n{question}", backends.OfflineModel, rerank=lambda d: -F.length("text").cast("double"), least=0.2)
    return out.select("query_id", F.md5(F.coalesce("context", F.lit(""))).alias("context_md5"), F.md5("reply").alias("reply_md5"))


@query
def indexed_neighbours(spark, sf_dir):
    """Nearest vectors through the inverted index, all lists probed: as exact
    as the search without it."""
    v = table(spark, sf_dir, "embeddings")
    index = retrieval.build_index(v, scratch(spark, "index"), lists=32)
    out = retrieval.probe(index, v.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), 10, n_lists=32)
    return out.select("query_id", "vec_id", F.bround("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))
