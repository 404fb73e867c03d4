"""Schemas of the annotated-corpus and question-answering tables."""

from __future__ import annotations

from pyspark.sql import types as T

_s, _i, _l, _d, _b = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


SPAN = _table(start=_i, end=_i, label=_s)
TOKEN_SPAN = _table(start_tok=_i, end_tok=_i, label=_s, text=_s)
ABSTRACTS = _table(PMID=_l, Title=_s, Abstract=_s)
ENTITIES = _table(PMID=_l, Arg=_s, Type=_s, Start_offset=_i, End_offset=_i, String=_s)
RELATIONS = _table(PMID=_l, Predicate=_s, Object=_s, Subject=_s)
VIRUS_LEXICON = _table(Virus=_s, Genus_Family=_s)
DRUG_LEXICON = _table(Drugs=_s)
FOUR_OPTIONS = _table(question=_s, exp=_s, cop=_i, opa=_s, opb=_s, opc=_s, opd=_s, choice_type=_s)
MAP_OPTIONS = _table(question=_s, answer=_s, answer_idx=_s, options=T.MapType(_s, _s), meta_info=_s)
KEYED_QUESTION = _table(QUESTION=_s, CONTEXTS=T.ArrayType(_s), LABELS=T.ArrayType(_s), LONG_ANSWER=_s, MESHES=T.ArrayType(_s), final_decision=_s)
ANSWERED = _table(question=_s, exp=_s, cop=_i, GENERATED_ANSWER=_s, RETRIEVED_DOCUMENTS=_s)
RAG_SAMPLES = _table(question=_s, answer=_s, contexts=T.ArrayType(_s), ground_truth=_s)
ANNOTATED = _table(tokenized_text=T.ArrayType(_s), ner=T.ArrayType(_table(start_tok=_i, end_tok=_i, label=_s)), validated=_b)
EDGES = _table(graph_id=_s, src=_s, dst=_s, label=_s, pos=_i)
VECTORS = _table(vec_id=_l, embedding=T.ArrayType(T.FloatType()), text=_s, metadata=T.MapType(_s, _s))
DOCUMENT = _table(page_content=_s, metadata=T.MapType(_s, _s))
_END = _table(mention=_s, position=T.ArrayType(_i), type=_s)
RELATION_RECORD = _table(
    ner=T.ArrayType(_table(start_tok=_i, end_tok=_i, type=_s, text=_s)),
    relations=T.ArrayType(_table(head=_END, tail=_END, relation_text=_s)),
    tokenized_text=T.ArrayType(_s),
)

#: Strings that count as missing in delimited text.
NA_STRINGS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

#: Entity classes and relation types of the typed extractions.
ENTITY_TYPES = ("CHEMICAL", "GENE")
PREDICATES = (
    "INDIRECT-DOWNREGULATOR",
    "INDIRECT-UPREGULATOR",
    "DIRECT-REGULATOR",
    "ACTIVATOR",
    "INHIBITOR",
    "AGONIST",
    "AGONIST-ACTIVATOR",
    "AGONIST-INHIBITOR",
    "ANTAGONIST",
    "PRODUCT-OF",
    "SUBSTRATE",
    "SUBSTRATE_PRODUCT-OF",
    "PART-OF",
)
