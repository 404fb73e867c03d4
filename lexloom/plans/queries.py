"""The catalogue: a query for each operator, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..operators import backends, graphs, joins, lexicon, metrics, ranking, retrieval, spans, splits, stats
from ..sources import readers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A small lexicon as it comes: several terms in a cell, stray characters.
LEXICON = [("trash + clown(s)",), ("moron + scum=",), ("idiot",), ("stupid + (trash",)]
TERMS = ("trash", "clowns", "moron", "scum", "idiot", "stupid", "src11", "es")


# --- lexicons and filters


@query
def lexicon_terms(spark, sf_dir):
    rows = spark.createDataFrame(LEXICON, "Virus string")
    return lexicon.clean_terms(rows, "Virus", " + ", "+=()")


@query
def kw_filter_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return lexicon.match_any(docs, ["text", "source", "lang"], lexicon.alternation(TERMS)).select("doc_id", "source", "lang")


@query
def kw_filter_multiset(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return lexicon.match_any(docs, ["text", "source", "lang"], lexicon.alternation(TERMS), dedupe=False).select("doc_id", "source")


@query
def kw_filter_array(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    contexts = whole.select("conv_id", F.transform("t", lambda x: x["text"]).alias("contexts"))
    hit = contexts.where(lexicon.any_item_matches("contexts", lexicon.alternation(("and the", "because"))))
    return hit.select("conv_id", F.size("contexts").cast("long").alias("n_contexts"))


@query
def kw_hits_by_term(spark, sf_dir):
    terms = spark.createDataFrame([(t,) for t in ("trash", "moron", "scum", "idiot", "the", "der")], "term string")
    return lexicon.hits_by_term(table(spark, sf_dir, "documents"), "text", terms, "doc_id")


@query
def kw_filter_large_lexicon(spark, sf_dir):
    terms = [f"nohit{i}" for i in range(300)] + ["moron", "idiot"]
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lexicon.filter_by_terms(docs, ["text"], terms).select("doc_id")


@query
def filter_choice_and_null(spark, sf_dir):
    """Substring filter, null-safe negation, rows without nulls."""
    parts = table(spark, sf_dir, "part").withColumn("note", F.when(F.col("p_size") % 7 == 0, None).otherwise(F.col("p_type")))
    hit = F.coalesce(F.contains("note", F.lit("BRASS")), F.lit(False))
    return parts.where(~hit).na.drop("any", subset=["note"]).groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))


@query
def semi_join_keys(spark, sf_dir):
    """Membership in a key list."""
    big = table(spark, sf_dir, "lineitem").where("l_quantity >= 50").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(big, "o_orderkey", "left_semi").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


# --- joins


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions derived from words by shape: a digit makes GENE-N or GENE-Y, an
    inner capital CHEMICAL."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    wanted = lambda t: t.rlike("[0-9]|^[A-Z][a-z]{7,}$")
    tokens = spans.exploded_tokens(docs, "doc_id", "text", wanted)
    return tokens.withColumn("type", F.when(F.col("token").rlike("[0-9].*[0-9]"), "GENE-N").when(F.col("token").rlike("[0-9]"), "GENE-Y").otherwise("CHEMICAL"))


@query
def entity_join_clean(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("PMID"), F.when(F.col("doc_id") % 10 != 0, F.col("source")).alias("Title"), F.col("lang").alias("Abstract"))
    m = mentions(spark, sf_dir).select(F.col("doc_id").alias("PMID"), F.col("type").alias("Type"), F.col("token").alias("String"))
    rows = joins.mention_rows(docs, m, merge_types={"GENE-N": "GENE", "GENE-Y": "GENE"})
    return rows.groupBy("Text", "Type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("PMID").alias("n_docs"))


@query
def spans_per_doc(spark, sf_dir):
    m = mentions(spark, sf_dir)
    got = spans.spans_by_document(m, ["doc_id"], ["start"], ["start", "end", "type"])
    text = F.array_join(F.transform("entities", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"), x["type"])), ",")
    return got.select("doc_id", F.size("entities").cast("long").alias("n_spans"), F.md5(text).alias("spans_md5"))


@query
def relation_rows(spark, sf_dir):
    """Orders as documents, their lines as relations between a part and a
    supplier, named by prefixed arguments."""
    lines = table(spark, sf_dir, "lineitem")
    rel = lines.select(F.col("l_orderkey").alias("PMID"), F.concat(F.lit("Arg1:P"), F.col("l_partkey")).alias("Subject"), F.concat(F.lit("Arg2:S"), F.col("l_suppkey")).alias("Object"), F.col("l_returnflag").alias("Predicate"))
    texts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("PMID"), F.col("o_orderpriority").alias("Text"))
    named = lambda c, p, kind: lines.select(F.col("l_orderkey").alias("PMID"), F.concat(F.lit(p), F.col(c)).alias("Arg"), F.lit(kind).alias("Type"), F.col("l_linenumber").alias("Start_offset"), (F.col("l_linenumber") + 1).alias("End_offset"), F.concat(F.lit(kind), F.lit(" "), F.col(c)).alias("String"))
    m = named("l_partkey", "P", "part").unionByName(named("l_suppkey", "S", "supplier"))
    return joins.relation_rows(rel, texts, m)


@query
def split_overlap(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return joins.shared_keys(lines.where("l_returnflag = 'R'"), lines.where("l_returnflag = 'A'"), "l_orderkey")


@query
def lookup_with_default(spark, sf_dir):
    wide = table(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    # Names as a dict that was written twice: the later value counts.
    twice = wide.withColumn("pos", F.lit(2)).unionByName(wide.select("c_nationkey", F.lit("first").alias("n_name"), F.lit(1).alias("pos")))
    return joins.with_default(table(spark, sf_dir, "customer"), twice, "c_nationkey", "n_name", "none", "pos").groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))


# --- aggregates and summaries


@query
def type_value_counts(spark, sf_dir):
    return stats.value_counts(table(spark, sf_dir, "events"), "event_type")


@query
def text_length_describe(spark, sf_dir):
    summary = stats.describe(table(spark, sf_dir, "documents"), "n_chars", ["lang"])
    return stats.unpivoted(summary, ["lang"], drop=["count"], digits=4)


@query
def length_trim_dedup(spark, sf_dir):
    """Shortest 36 and longest 2 cut off, then the first of equal texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("length", F.length("text").cast("long"))
    order = [F.col("length").asc_nulls_last(), F.col("doc_id")]
    trimmed = ranking.trim_sorted(docs, order, [F.col("length").desc_nulls_first(), F.col("doc_id").desc()], 36, 2)
    return stats.keep_first(trimmed, ["text"], "doc_id").select("doc_id", "length")


@query
def length_histogram(spark, sf_dir):
    return stats.histogram(table(spark, sf_dir, "documents"), "n_chars", 250, by=["lang"])


@query
def length_kde(spark, sf_dir):
    out = stats.density(table(spark, sf_dir, "documents"), "n_chars", 0.0, 20000.0, 101)
    return out.select(F.col("i").cast("long").alias("i"), F.bround(F.col("density") * 1e6, 4).alias("density"))


@query
def mean_row_scores(spark, sf_dir):
    present = F.transform("embedding", lambda x: F.when(x > 0, x.cast("double")))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.bround(X.mean_present(present), 6).alias("mean_score"))


@query
def wide_columns(spark, sf_dir):
    head = F.slice("embedding", 1, F.pmod(F.col("vec_id"), F.lit(4)).cast("int") + 1)
    return table(spark, sf_dir, "embeddings").select("vec_id", *[F.bround(c.cast("double"), 6).alias(f"score_{i + 1}") for i, c in enumerate(X.wide(head, "s", 4))])


@query
def flag_highest(spark, sf_dir):
    return stats.flag_maximum(table(spark, sf_dir, "part"), "p_retailprice", ["p_brand"]).where("is_max").select("p_partkey", "p_brand")


@query
def longest_text(spark, sf_dir):
    return stats.longest(table(spark, sf_dir, "documents"), "text", "doc_id").select("key", F.col("length").cast("long").alias("length"))


@query
def ordered_distinct_labels(spark, sf_dir):
    return stats.first_seen(table(spark, sf_dir, "events"), "event_type", "event_id").select("event_type", "first_pos")


@query
def dedup_keep_first(spark, sf_dir):
    return stats.keep_first(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), ["text"], "doc_id").select("doc_id", "source")


@query
def union_all_and_distinct(spark, sf_dir):
    a, b = (table(spark, sf_dir, "documents").where(c).select("lang", "source") for c in ("doc_id % 2 = 0", "doc_id % 3 = 0"))
    every, once = a.unionByName(b), a.unionByName(b).dropDuplicates()
    return every.groupBy("lang").agg(F.count(F.lit(1)).alias("n_all")).join(once.groupBy("lang").agg(F.count(F.lit(1)).alias("n_distinct")), "lang")


@query
def last_write_wins(spark, sf_dir):
    return stats.last_write(table(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id")


# --- text


@query
def tokenize_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(X.tokenize("text")).cast("long").alias("n_tokens"))


@query
def detokenize_md5(spark, sf_dir):
    tokens = X.tokenize(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(X.detokenize(tokens)).alias("text_md5"))


@query
def tidy_punctuation(spark, sf_dir):
    spaced = F.regexp_replace("text", r"([,.!?])", " $1")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(X.tidy_punctuation(spaced)).alias("text_md5"))


@query
def prompt_format(spark, sf_dir):
    options = X.numbered_options("p_brand", "p_type", F.when(F.col("p_size") > 25, F.col("p_size")), "p_name")
    parts = table(spark, sf_dir, "part")
    return parts.select("p_partkey", X.template("Question: {q}\nOptions: {o}", q="p_name", o=options).alias("prompt"))


@query
def python_dict_text(spark, sf_dir):
    m = F.create_map(F.lit("A"), F.col("p_brand"), F.lit("B"), F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", X.join_columns(": ", "p_name", X.as_python_dict(m)).alias("question"))


def printed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a printed list of its turns with scores."""
    turns = table(spark, sf_dir, "conversations")
    plain = F.translate(F.coalesce("text", F.lit("")), "'\"\\\n", "")
    item = F.concat(F.lit("Document(page_content='PubMedID: "), F.col("turn"), F.lit("\\nText: . "), plain, F.lit("', metadata={'relevance_score': 0."), F.col("turn") + 1, F.lit("})"))
    got = turns.withColumn("item", item).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "item"))).alias("a"))
    return got.select("conv_id", F.concat(F.lit("["), F.array_join(F.transform("a", lambda x: x["item"]), ", "), F.lit("]")).alias("documents"))


@query
def context_parse(spark, sf_dir):
    parsed = printed_documents(spark, sf_dir).select("conv_id", F.transform(X.page_contents("documents"), X.clean_content).alias("c"), X.relevance_scores("documents").alias("s"))
    return parsed.select("conv_id", *[F.md5(c).alias(f"content_{i + 1}") for i, c in enumerate(X.wide("c", "c", 4))], F.bround(X.mean_present(F.slice("s", 1, 4)), 6).alias("mean_relevance_score"))


@query
def context_parse_literal(spark, sf_dir):
    parsed = printed_documents(spark, sf_dir).select("conv_id", X.page_contents("documents", literal=True).alias("c"))
    return parsed.select("conv_id", F.size("c").cast("long").alias("n"), F.md5(F.array_join("c", "|")).alias("contents_md5"))


@query
def decode_escapes(spark, sf_dir):
    raw = F.replace(F.replace(F.col("text"), F.lit("\n"), F.lit("\\n")), F.lit(","), F.lit("\\\\n"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(X.decode_escapes(raw)).alias("text_md5"))


@query
def chunk_text(spark, sf_dir):
    chunks = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.chunks("text", 1024)).alias("pos", "chunk"))
    return chunks.select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5("chunk").alias("chunk_md5"))


@query
def json_extract_validate(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("reply", F.concat(F.lit("Here it is:\n"), F.col("props"), F.lit(" done")))
    parsed = events.withColumn("p", X.lenient_json("reply", "k long"))
    ok = X.has_fields(F.col("p"), ["k"])
    return parsed.groupBy(ok.alias("valid")).agg(F.count(F.lit(1)).alias("n"), F.sum("p.k").alias("sum_k"))


@query
def option_extraction(spark, sf_dir):
    replies = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("The answer is ("), F.col("p_size") % 4 + 1, F.lit(")."))).when(F.col("p_size") % 3 == 1, F.concat(F.col("p_size") % 4 + 1, F.lit(") because"))).otherwise("unclear").alias("reply"))
    return replies.select("p_partkey", X.option_letter("reply").alias("option"))


@query
def answer_accuracy(spark, sf_dir):
    replies = table(spark, sf_dir, "part").select("p_size", (F.col("p_size") % 4 + 1).alias("cop"), X.option_letter(F.concat(F.lit("Answer: "), F.col("p_size") % 5 + 1)).alias("option"))
    return stats.mean_of_correct(replies, "cop", "option").select(F.bround("accuracy", 6).alias("accuracy"))


# --- spans


@query
def char_to_token(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    points = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(31))).alias("point")).withColumn("_id", F.col("point").cast("long"))
    found = spans.char_to_token(docs, points, "doc_id")
    return found.groupBy("doc_id").agg(F.count("idx").alias("n_on_token"), F.sum("idx").cast("long").alias("sum_idx"), F.count(F.lit(1)).alias("n_points"))


@query
def span_contract(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(31))).alias("start")).withColumn("end", F.col("start") + 23).withColumn("_id", F.col("start").cast("long"))
    return spans.contract_to_tokens(docs, cut, "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("start_tok").cast("long").alias("sum_start"), F.sum("end_tok").cast("long").alias("sum_end"))


@query
def subsequence_match(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", X.tokenize("text").alias("tokens"))
    items = table(spark, sf_dir, "benchmark").select("item_id", X.tokenize("text").alias("tokens"))
    return spans.subsequence_matches(docs, items, "doc_id", "item_id").withColumn("first_tok", F.col("first_tok").cast("long"))


@query
def merge_adjacent(spark, sf_dir):
    """Runs of one event type of a user, by the declarative form of merging."""
    ev = spans.runs(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], [F.col("event_id")], "event_type")
    return ev.groupBy("user_id", "run", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id")).drop("run")


@query
def merge_spans_array(spark, sf_dir):
    """Touching spans of one label merged by a fold over each document's array."""
    m = mentions(spark, sf_dir).where("type = 'CHEMICAL'").select("doc_id", "idx", F.col("type").alias("label"), F.col("token").alias("text"))
    got = m.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("idx").alias("start"), (F.col("idx") + 1).alias("end"), "label", "text"))).alias("a"))
    ents = F.transform("a", lambda x: F.struct(x["label"].alias("label"), x["text"].alias("text"), x["start"].alias("start"), x["end"].alias("end")))
    return got.select("doc_id", F.explode(spans.merge_adjacent(ents)).alias("e")).select("doc_id", F.col("e.start").cast("long").alias("start"), F.col("e.end").cast("long").alias("end"), F.col("e.text").alias("text"))


@query
def resolve_overlaps(spark, sf_dir):
    """Three overlapping families of spans over each whole document, resolved."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n"))
    family = lambda step, width, label: F.transform(F.sequence(F.lit(0), F.col("n"), F.lit(step)), lambda s: F.struct(s.alias("start"), (s + width).alias("end"), F.lit(label).alias("label")))
    made = docs.select("doc_id", F.concat(family(700, 60, "A"), family(410, 45, "B"), family(530, 75, "C")).alias("s"))
    return made.select("doc_id", F.explode(spans.resolve_overlaps("s")).alias("e")).select("doc_id", "e.start", "e.end", "e.label")


@query
def running_offset(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    out = spans.running_offset(turns, ["conv_id"], [F.col("turn")], F.length(F.coalesce("text", F.lit(""))))
    return out.select("conv_id", "turn", F.col("offset").cast("long").alias("offset"))


@query
def relation_records(spark, sf_dir):
    """Nested records from neighbouring mentions, flattened for comparison."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    m = mentions(spark, sf_dir)
    nxt = Window.partitionBy("doc_id").orderBy("start")
    pairs = m.select("doc_id", "token", "type", "start", "end", F.lead(F.struct("token", "type", "start", "end")).over(nxt).alias("o")).where("o IS NOT NULL")
    rel = pairs.select("doc_id", F.col("token").alias("Subject"), F.col("type").alias("Subject_Type"), F.col("start").alias("Subject_Start"), F.col("end").alias("Subject_End"), F.col("o.token").alias("Object"), F.col("o.type").alias("Object_Type"), F.col("o.start").alias("Object_Start"), F.col("o.end").alias("Object_End"), F.lit("NEXT").alias("Relation"))
    rec = spans.relation_records(rel, docs, "doc_id")
    place = lambda p: F.concat_ws("-", F.get(p, F.lit(0)).cast("string"), F.get(p, F.lit(1)).cast("string"))
    ner = F.array_join(F.transform("ner", lambda m: F.concat_ws(":", m["start_tok"].cast("string"), m["end_tok"].cast("string"), m["type"], m["text"])), ",")
    related = F.array_join(F.sort_array(F.transform("relations", lambda r: F.concat_ws(":", r["head"]["mention"], place(r["head"]["position"]), r["head"]["type"], r["tail"]["mention"], place(r["tail"]["position"]), r["tail"]["type"], r["relation_text"]))), ",")
    sizes = (F.size(c).cast("long").alias(n) for c, n in (("ner", "n_ner"), ("relations", "n_relations"), ("tokenized_text", "n_tokens")))
    return rec.select("doc_id", *sizes, F.md5(ner).alias("ner_md5"), F.md5(related).alias("relations_md5"), F.md5(F.array_join("tokenized_text", " ")).alias("tokens_md5"))


# --- folds, samples, batches


@query
def stratified_folds(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag")
    out = splits.stratified_folds(lines, "l_orderkey", "l_returnflag", 5, 42, 5)
    return out.select("l_orderkey", F.col("class").cast("long").alias("class"), F.col("fold").cast("long").alias("fold"))


@query
def fold_report(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag")
    folds = splits.stratified_folds(lines, "l_orderkey", "l_returnflag", 5, 42, 5)
    return splits.fold_report(splits.fold_splits(lines, folds, "l_orderkey", 5), "l_orderkey", "l_returnflag").withColumn("fold", F.col("fold").cast("long"))


@query
def shuffle_split(spark, sf_dir):
    return splits.ratio_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.8, 42)


@query
def seeded_sample(spark, sf_dir):
    return splits.seeded_sample(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", 750, 42)


@query
def batching(spark, sf_dir):
    rows = splits.batches(table(spark, sf_dir, "documents").select("doc_id"), [F.col("doc_id")], 32)
    return rows.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


@query
def cursor_neighbours(spark, sf_dir):
    return splits.neighbours(table(spark, sf_dir, "conversations").select("conv_id", "turn"), ["conv_id"], [F.col("turn")], "turn")


@query
def rows_by_position(spark, sf_dir):
    return readers.rows_by_position(table(spark, sf_dir, "documents"), ["doc_id"], 1, 2).select("doc_id", "source")


# --- retrieval


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 50, as a query."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")


@query
def knn_topk(spark, sf_dir):
    out = retrieval.nearest(asked(spark, sf_dir), table(spark, sf_dir, "embeddings"), 20)
    return out.select("query_id", "vec_id", F.bround("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query
def knn_threshold_rerank(spark, sf_dir):
    """Neighbours over a threshold, reranked by nearness of ids, four kept."""
    out = retrieval.nearest(asked(spark, sf_dir), table(spark, sf_dir, "embeddings"), 20, least=0.2, skip_self=True)
    best = retrieval.rerank(out, -F.abs(F.col("vec_id") - F.col("query_id")).cast("double"), 4)
    return best.select("query_id", "vec_id", F.col("rerank").cast("long").alias("rerank"))


@query
def contexts_by_seed(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    out = retrieval.contexts_by_seed(v, v.where("vec_id % 50 = 0"), 3, 0.3)
    return out.select("seed_id", "vec_id", F.bround("score", 6).alias("score"))


@query
def normalised_norms(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").withColumn("u", V.normalise(F.transform("embedding", lambda x: x.cast("double") * 3)))
    return v.select("vec_id", F.bround(V.norm("u"), 6).alias("norm"), F.bround(V.cosine("u", "embedding"), 6).alias("cosine"))


def keyword_queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, ["idiot", "moron"]), (2, ["license", "public"]), (3, ["der", "die", "und"])], "query_id long, terms array<string>")


@query
def bm25_topk(spark, sf_dir):
    out = retrieval.bm25(table(spark, sf_dir, "documents"), keyword_queries(spark), 10)
    return out.select("query_id", "doc_id", F.bround("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query
def rrf_fusion(spark, sf_dir):
    q = asked(spark, sf_dir)
    v = table(spark, sf_dir, "embeddings")
    a = retrieval.nearest(q, v, 10)
    b = retrieval.nearest(q.withColumn("embedding", F.slice("embedding", 1, 32)), v.withColumn("embedding", F.slice("embedding", 1, 32)), 10)
    out = retrieval.fuse([(a, 0.4), (b, 0.6)], "query_id", "vec_id")
    return out.select("query_id", "vec_id", F.bround("score", 8).alias("score"))


@query
def stuffed_prompt(spark, sf_dir):
    found = retrieval.nearest(asked(spark, sf_dir), table(spark, sf_dir, "embeddings"), 4)
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "source", "n_chars")
    t = X.template("Content: {n}\nSource: {s}", n="n_chars", s="source")
    return retrieval.stuff_prompt(found, texts, t, "query_id", "vec_id", F.col("rank"))


# --- metrics


@query
def label_prf(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", lexicon.contains_term("text", lexicon.alternation(("idiot", "moron", "trash", "scum"))).cast("int").alias("predicted"))
    out = metrics.binary_scores(docs.join(table(spark, sf_dir, "labels"), "doc_id"), "toxic", "predicted", ["lang"])
    return out.select("lang", "tp", "fp", "fn", "tn", *(F.bround(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy")))


@query
def entity_prf(spark, sf_dir):
    """Gold lines against those that a rule predicts."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity")
    gold = lines.where("l_quantity > 10").select("l_orderkey", "l_linenumber", "l_returnflag")
    predicted = lines.where("l_quantity < 40").select("l_orderkey", "l_linenumber", F.when(F.col("l_linestatus") == "O", "N").otherwise(F.col("l_returnflag")).alias("l_returnflag"))
    out = metrics.entity_scores(predicted, gold, ["l_orderkey", "l_linenumber"], "l_returnflag")
    return out.select("l_returnflag", "tp", "fp", "fn", *(F.bround(c, 6).alias(c) for c in ("precision", "recall", "f1")))


def neighbouring_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn with the one after it: key, a, b."""
    turns = table(spark, sf_dir, "conversations")
    nxt = Window.partitionBy("conv_id").orderBy("turn")
    pairs = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("key"), F.col("text").alias("a"), F.lead("text").over(nxt).alias("b"), F.lead("turn").over(nxt).alias("_n"))
    return pairs.where("_n IS NOT NULL").drop("_n")


@query
def ngram_overlap(spark, sf_dir):
    turns = neighbouring_turns(spark, sf_dir)
    one, two = (metrics.rouge_n(turns, "key", "a", "b", n).select("key", F.col("shared").alias(f"shared_{n}"), F.bround("f1", 6).alias(f"f1_{n}")) for n in (1, 2))
    return one.join(two, "key")


@query
def context_precision(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    found = retrieval.nearest(asked(spark, sf_dir), v, 10, skip_self=True)
    label = v.select("vec_id", "label")
    judged = found.join(label, "vec_id").join(label.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql")), "query_id").withColumn("v", F.col("label") == F.col("ql"))
    return metrics.context_precision(judged, "query_id", "rank", "v").withColumn("context_precision", F.bround("context_precision", 6))


@query
def faithfulness(spark, sf_dir):
    verdicts = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_returnflag") == "N").alias("v"))
    return metrics.share_supported(verdicts, "l_orderkey", "v", "faithfulness").withColumn("faithfulness", F.bround("faithfulness", 6))


@query
def answer_relevancy(spark, sf_dir):
    found = retrieval.nearest(asked(spark, sf_dir), table(spark, sf_dir, "embeddings"), 3, skip_self=True)
    return metrics.answer_relevancy(found, "query_id", "score").withColumn("answer_relevancy", F.bround("answer_relevancy", 6))


# --- graphs


def order_graph(spark: SparkSession, sf_dir: str, shift: int) -> DataFrame:
    """Orders as graphs: suppliers to parts, the flag as label."""
    lines = table(spark, sf_dir, "lineitem").where(f"(l_linenumber + {shift}) % 3 <> 0")
    rec = lines.select(F.col("l_orderkey").alias("g"), F.concat(F.lit("s"), F.col("l_suppkey") % 5).alias("s"), F.concat(F.lit("p"), F.col("l_partkey") % 7).alias("p"), F.col("l_returnflag").alias("f"), (F.col("l_linenumber") * 1000 + F.ascii("l_returnflag")).alias("pos"))
    return graphs.edges_from_records(rec, "g", "s", "p", "f", "pos")


@query
def graph_edges_lastwins(spark, sf_dir):
    return order_graph(spark, sf_dir, 0).select("graph_id", "src", "dst", "label")


@query
def graph_diff(spark, sf_dir):
    out = graphs.difference(order_graph(spark, sf_dir, 0), order_graph(spark, sf_dir, 1))
    return out.select("graph_id", "node_changes", "edge_changes", "label_changes", "distance")


@query
def graph_edit_distance(spark, sf_dir):
    return graphs.exact_distances(order_graph(spark, sf_dir, 0), order_graph(spark, sf_dir, 1))


# --- model-backed steps, with deterministic offline backends


@query
def ner_offline(spark, sf_dir):
    found = backends.tag(table(spark, sf_dir, "documents"), "doc_id", "text", backends.OfflineTagger, threshold=0.6)
    return found.groupBy("doc_id", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("start").alias("starts"), F.sum(F.col("end") - F.col("start")).alias("chars"))


@query
def relations_offline(spark, sf_dir):
    found = backends.tag(table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "key"), "key", "text", backends.OfflineTagger)
    named = found.groupBy("key").agg(F.array_join(F.array_sort(F.collect_list(F.concat("surface", F.lit(" ("), "label", F.lit(")")))), "; ").alias("prompt"))
    out = backends.extract(named, "prompt", OfflineRelations, "relations array<struct<head:string,tail:string,predicate:string>>")
    return out.select("key", F.array_join(F.transform("parsed.relations", lambda r: F.concat_ws(">", r["head"], r["predicate"], r["tail"])), ";").alias("relations"))


def OfflineRelations() -> backends.OfflineModel:  # noqa: N802
    return backends.OfflineModel("relations")


@query
def embed_offline(spark, sf_dir):
    return backends.embed(table(spark, sf_dir, "conversations").withColumn("key", F.col("conv_id") * 1000 + F.col("turn")), "key", "text", backends.OfflineEmbedder).select("key", F.posexplode("embedding").alias("dim", "x")).where("x <> 0").select("key", "dim", F.bround(F.col("x").cast("double"), 4).alias("value"))


@query
def rouge_longest(spark, sf_dir):
    turns = neighbouring_turns(spark, sf_dir)
    return turns.select("key", F.round(metrics.rouge_l(X.tokenize(F.coalesce("a", F.lit(""))), X.tokenize(F.coalesce("b", F.lit("")))), 6).alias("rouge_l"))


@query
def flagship(spark, sf_dir):
    """Documents that a lexicon finds, with their derived mentions, by source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    hit = lexicon.match_any(docs, ["text", "source", "lang"], lexicon.alternation(TERMS))
    m = mentions(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_mentions"))
    return hit.join(m, "doc_id", "left").groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("n_mentions"), F.lit(0)).alias("n_mentions"))


from . import round_trips  # noqa: E402,F401  its queries join the catalogue
