"""The operators composed: corpora, extraction, exam sets, retrieval."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as X
from ..operators import backends, graphs, joins, lexicon, retrieval, spans, splits

#: How a typed extraction is asked for: its schema.
RELATION_SCHEMA = "relations array<struct<head:string,tail:string,predicate:string>>"


def span_corpus(abstracts: DataFrame, mentions: DataFrame, k: int = 5, seed: int = 42, min_class_size: int = 5) -> DataFrame:
    """Abstracts and mentions to a foldwise corpus of token spans: (fold, split,
    PMID, Text, entities), overlaps resolved, every fold from one plan."""
    rows = joins.mention_rows(abstracts, mentions, merge_types={"GENE-N": "GENE", "GENE-Y": "GENE"})
    folds = splits.stratified_folds(rows, "PMID", "Type", k, seed, min_class_size)
    texts = rows.select("PMID", "Text").distinct()
    raw = rows.select("PMID", F.col("Start_offset").alias("start"), F.col("End_offset").alias("end"), F.col("Type").alias("label")).distinct()
    raw = raw.withColumn("_id", F.xxhash64("start", "end", "label"))
    held = spans.contract_to_tokens(texts, raw, "PMID", "Text").select("PMID", F.col("start_tok").alias("start"), (F.col("end_tok") + 1).cast("int").alias("end"), "label").distinct()
    gathered = held.groupBy("PMID").agg(F.collect_list(F.struct("start", "end", "label")).alias("a"))
    return splits.fold_splits(texts.join(gathered, "PMID").withColumn("entities", spans.resolve_overlaps("a")).drop("a"), folds, "PMID", k)


def extract_relations(texts: DataFrame, key: str, text: str, tagger: Callable[[], backends.Tagger], model: Callable[[], backends.TextModel], template: str, predicates: Sequence[str] = schemas.PREDICATES) -> DataFrame:
    """Texts to typed edges (graph_id, src, dst, label, pos): entities are tagged
    and put into a prompt, the reply is parsed, relations of unknown type or
    without an end are dropped, the last of several for one pair stays."""
    found = backends.tag(texts, key, text, tagger)
    named = found.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "surface", "label"))), lambda x: F.concat(x["surface"], F.lit(" ("), x["label"], F.lit(")"))), "; ").alias("entities"))
    asked = texts.select(key, text).join(named, key).withColumn("prompt", X.template(template, text=text, entities="entities"))
    parsed = backends.extract(asked.select(key, "prompt"), "prompt", model, RELATION_SCHEMA)
    each = parsed.select(key, F.posexplode("parsed.relations").alias("pos", "r")).select(key, "pos", "r.*")
    typed = each.where(F.col("predicate").isin(*predicates) & F.col("head").isNotNull() & F.col("tail").isNotNull())
    return graphs.edges_from_records(typed, key, "head", "tail", "predicate", "pos")


def exam_subset(questions: DataFrame, terms: Sequence[str], columns: Sequence[str], kind: tuple[str, str] | None = ("choice_type", "single"), dedupe: bool = True) -> DataFrame:
    """Questions that name a term in any column, of one kind only."""
    chosen = questions.where(F.coalesce(F.contains(kind[0], F.lit(kind[1])), F.lit(False))) if kind else questions
    return lexicon.match_any(chosen, columns, lexicon.alternation(terms), dedupe)


def exam_prompts(questions: DataFrame, options: Sequence[str] = ("opa", "opb", "opc", "opd"), null_literal: str | None = "nan") -> DataFrame:
    """Questions with an explanation, their options numbered and joined on."""
    asked = questions.na.drop(subset=["exp"]).withColumn("question", F.concat(F.col("question"), F.lit(" "), X.numbered_options(*options, null_literal=null_literal)))
    return asked.select("question", "exp", "cop")


def parsed_answers(answers: DataFrame, documents: str = "RETRIEVED_DOCUMENTS", k: int = 4, literal: bool = False) -> DataFrame:
    """Printed retrieved documents to page_content_1..k, cleaned, and their mean
    relevance."""
    parsed = answers.withColumns({"_c": F.transform(X.page_contents(documents, literal), X.clean_content), "_s": F.slice(X.relevance_scores(documents), 1, k)})
    kept = [c for c in answers.columns if c != documents]
    return parsed.select(*kept, *X.wide("_c", "page_content", k), X.mean_present("_s").alias("mean_relevance_score"))


def chosen_options(answers: DataFrame, key: str, reply: str) -> DataFrame:
    """The option that a reply names, by rules; null where it names none."""
    return answers.select(key, X.option_letter(reply).alias("Extracted_Answer"))


def answer_questions(questions: DataFrame, vectors: DataFrame, contents: DataFrame, template: Column, prompt: str, model: Callable[[], backends.TextModel], rerank: Callable[[DataFrame], Column] | None = None, k: int = 20, least: float = 0.7, n: int = 4) -> DataFrame:
    """Questions (query_id, question, embedding) to replies: nearest k over a
    threshold, the n best after reranking, their texts stuffed into a prompt."""
    found = retrieval.nearest(questions, vectors, k, least=least)
    joined = found.join(contents, "vec_id") if rerank else found
    best = retrieval.rerank(joined, rerank(joined) if rerank else F.col("score"), n).select("query_id", "vec_id", "score", "rerank")
    context = retrieval.stuff_prompt(best, contents, template, "query_id", "vec_id", F.col("rerank"))
    asked = questions.select("query_id", "question").join(context, "query_id", "left").withColumn("prompt", X.template(prompt, context=F.coalesce("context", F.lit("")), question="question"))
    return backends.generate(asked, "prompt", model)


def synthesise_questions(documents: DataFrame, key: str, text: str, model: Callable[[], backends.TextModel], template: str, size: int = 1024, per_document: int = 3, quality: Callable[[DataFrame], Column] | None = None, least: float = 0.5) -> DataFrame:
    """Documents to (key, pos, context, reply): the first chunks of each through
    a prompt, kept where their quality reaches ``least``; failed rows go."""
    parts = documents.select(key, F.posexplode(F.slice(X.chunks(text, size), 1, per_document)).alias("pos", "context"))
    fine = parts.where(quality(parts) >= least) if quality else parts
    asked = fine.withColumn("prompt", X.template(template, context="context"))
    return backends.generate(asked, "prompt", model).where("error IS NULL").drop("error", "prompt")


def term_list(lexicons: Mapping[str, tuple[DataFrame, str, str]]) -> list[str]:
    """Terms of several lexicons, each (frame, separator, characters to strip)
    under its column's name.  Lexicons are small by nature; their size is
    checked before they reach the driver."""
    out: list[str] = []
    for column, (frame, sep, strip) in lexicons.items():
        rows = lexicon.clean_terms(frame, column, sep, strip).orderBy("term").limit(100_001).collect()
        if len(rows) > 100_000:
            raise ValueError(f"{column} has over 100,000 terms; join on tokens instead")
        out += [r.term for r in rows]
    return out
