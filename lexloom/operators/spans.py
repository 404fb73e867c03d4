"""Spans of characters and of tokens: alignment, overlaps, merging, runs.

Character spans exclude their end, token spans include it.  Work on the spans
of one document is done in its row, or in windows over its id."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import below, let, tidy_punctuation, token_places, tokenize
from .ranking import spread

#: Bits of the map of item heads, one constant of 8 kB in a plan.
_HEAD_BITS = 1 << 16


def exploded_tokens(docs: DataFrame, key: str, text: str, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """(key, idx, start, end, token), a row for each token, or for each that
    ``keep`` wants.  Null texts give no rows.  Places are found in the document's
    row, so nothing is shuffled."""
    rows = spread(docs.select(key, text)).select(key, F.explode(token_places(text, keep)).alias("p"))
    return rows.select(key, "p.idx", "p.start", "p.end", "p.token")


def token_at(places: Column, point: Column) -> Column:
    """The idx of the token that covers a character; null on a gap.  ``places``
    are those of all tokens."""
    found = lambda n: F.when(F.get(places, n - 1)["end"] > point, F.get(places, n - 1)["idx"])
    return let(below(places, "start", point + 1), lambda n: F.when(n > 0, found(n)))


def _others(rows: DataFrame, key: str) -> list[str]:
    return [c for c in rows.columns if c != key]


def _in_documents(docs: DataFrame, rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, _t, _rows): each document that rows name, its tokens placed once the
    text has met its rows, so that texts are shuffled and tokens never."""
    asked = rows.groupBy(key).agg(F.collect_list(F.struct(*_others(rows, key))).alias("_rows"))
    met = spread(docs.where(F.col(text).isNotNull()).select(key, text)).join(asked, key)
    return met.select(key, token_places(text).alias("_t"), "_rows")


def char_to_token(docs: DataFrame, points: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The token that covers each point (key, point, ...): its idx, or null on a
    gap or past the text.  Equals a lookup in a map of every character of every
    token.  Points of documents that are absent or null are dropped; a document
    is worked on in one row, its points with it."""
    met = _in_documents(docs, points, key, text)
    found = F.transform("_rows", lambda p: F.struct(*(p[c].alias(c) for c in _others(points, key)), token_at(F.col("_t"), p["point"]).alias("idx")))
    return met.select(key, F.explode(found).alias("_f")).select(key, "_f.*")


def contract_to_tokens(docs: DataFrame, spans: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The widest run of whole tokens inside each span (key, start, end, ...), as
    start_tok and end_tok, included; spans that hold none are dropped."""
    met = _in_documents(docs, spans, key, text)
    lo, hi = lambda s: below(F.col("_t"), "start", s["start"]), lambda s: below(F.col("_t"), "end", s["end"] + 1) - 1
    found = F.transform("_rows", lambda s: F.struct(*(s[c].alias(c) for c in _others(spans, key)), lo(s).alias("start_tok"), hi(s).alias("end_tok")))
    return met.select(key, F.explode(found).alias("_f")).select(key, "_f.*").where("start_tok <= end_tok")


_SPAN = "array<struct<start:int,end:int,label:string>>"


def overlap_clusters(spans: Column | str) -> Column:
    """Spans dealt into runs that meet one another, directly or through others;
    spans of different runs never overlap."""

    def add(acc: Column, x: Column) -> Column:
        meets = x["start"] < acc["end"]
        closed = F.when(meets | (F.size(acc["own"]) == 0), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["own"])))
        own = F.when(meets, F.concat(acc["own"], F.array(x))).otherwise(F.array(x))
        return F.struct(closed.alias("done"), own.alias("own"), F.greatest(F.when(meets, acc["end"]), x["end"]).alias("end"))

    zero = F.struct(F.array().cast(f"array<{_SPAN}>").alias("done"), F.array().cast(_SPAN).alias("own"), F.lit(-(2**31)).alias("end"))
    whole = lambda acc: F.when(F.size(acc["own"]) > 0, F.concat(acc["done"], F.array(acc["own"]))).otherwise(acc["done"])
    plain = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["label"].alias("label")))
    return F.aggregate(F.sort_array(plain), zero, add, whole)


def resolve_overlaps(spans: Column | str) -> Column:
    """Longest first, then earliest, then least label; a span that meets a kept
    one goes.  The result is in order of start.  Null gives null.

    Only spans of one cluster are held against each other, so a long document
    costs what its clusters cost."""

    def greedy(cluster: Column) -> Column:
        keyed = F.transform(cluster, lambda x: F.struct((x["start"] - x["end"]).alias("k"), x["start"].alias("start"), x["end"].alias("end"), x["label"].alias("label")))
        ordered = F.transform(F.sort_array(keyed), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["label"].alias("label")))
        clash = lambda acc, x: F.exists(acc, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))
        keep = lambda acc, x: F.when(clash(acc, x), acc).otherwise(F.concat(acc, F.array(x)))
        return F.sort_array(F.aggregate(ordered, F.array().cast(_SPAN), keep))

    return F.flatten(F.transform(overlap_clusters(spans), greedy))


_ENTITY = "array<struct<label:string,text:string,start:int,end:int>>"


def merge_adjacent(entities: Column | str) -> Column:
    """Neighbours of one label that touch, or lie one apart, become one; their
    texts are joined by a blank."""

    def add(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.struct(last["label"].alias("label"), F.concat(last["text"], F.lit(" "), x["text"]).alias("text"), last["start"].alias("start"), x["end"].alias("end"))
        touches = (last["label"] == x["label"]) & ((x["start"] == last["end"]) | (x["start"] == last["end"] + 1))
        merged = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined))
        return F.when(F.size(acc) == 0, F.array(x)).when(touches, merged).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(entities, F.array().cast(_ENTITY), add)


def highlight(tokens: Column | str, ner: Column | str) -> Column:
    """Stretches of text with their label (null outside entities), in order:
    each entity, and each run of tokens between entities, joined by blanks with
    none before punctuation.  ``ner`` holds (start_tok, end_tok, label), ends
    included; of entities over one token the first in the list counts."""
    of = lambda i: F.get(F.filter(F.transform(ner, lambda e, k: F.struct(k.alias("k"), e["start_tok"].alias("s"), e["end_tok"].alias("e"), e["label"].alias("label"))), lambda e: (e["s"] <= i) & (i <= e["e"])), F.lit(0))
    named = F.transform(tokens, lambda t, i: F.struct(F.coalesce(of(i)["k"], F.lit(-1)).alias("k"), of(i)["label"].alias("label"), t.alias("text")))

    def add(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        longer = F.struct(last["k"].alias("k"), last["label"].alias("label"), F.concat(last["text"], F.lit(" "), x["text"]).alias("text"))
        return F.when(F.size(acc) == 0, F.array(x)).when(last["k"] == x["k"], F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(longer))).otherwise(F.concat(acc, F.array(x)))

    runs = F.aggregate(named, F.array().cast("array<struct<k:int,label:string,text:string>>"), add)
    return F.transform(runs, lambda x: F.struct(tidy_punctuation(x["text"]).alias("text"), x["label"].alias("label")))


def tokens_and_labels(entries: Column | str) -> Column:
    """Labelled pieces of text (token, label) to all their tokens and the token
    spans of the labelled ones, ends included."""
    zero = F.struct(F.array().cast("array<string>").alias("tokens"), F.array().cast("array<struct<start_tok:int,end_tok:int,label:string>>").alias("ner"))

    def add(acc: Column, x: Column) -> Column:
        own, at = tokenize(x["token"]), F.size(acc["tokens"])
        span = F.array(F.struct(at.alias("start_tok"), (at + F.size(own) - 1).alias("end_tok"), x["label"].alias("label")))
        labelled = F.coalesce(x["label"] != "", F.lit(False))
        return F.struct(F.concat(acc["tokens"], own).alias("tokens"), F.when(labelled, F.concat(acc["ner"], span)).otherwise(acc["ner"]).alias("ner"))

    return F.aggregate(entries, zero, add)


def first_subsequence(tokens: Column, wanted: Column) -> Column:
    """The first place where one token list stands in another; null if nowhere
    or if the wanted list is empty or longer."""
    starts = F.sequence(F.lit(0), F.size(tokens) - F.size(wanted))
    at = F.filter(starts, lambda i: F.slice(tokens, i + 1, F.size(wanted)) == wanted)
    return F.when((F.size(wanted) > 0) & (F.size(wanted) <= F.size(tokens)), F.get(at, F.lit(0)))


def subsequence_matches(docs: DataFrame, items: DataFrame, doc_key: str, item_key: str, tokens: str = "tokens", n: int = 4) -> DataFrame:
    """(doc, item, first_tok) for every item whose whole token list stands in a
    document; empty and null lists stand nowhere, and of a repeated document or
    item the first place counts.

    Items are met by the hash of their first ``n`` tokens (fewer if they have
    fewer).  A document's windows are hashed in its row, and only windows whose
    hash may be an item's, by a bitmap of fixed size, become rows; the document
    comes to the comparison once for each item it may hold."""
    i = items.where(F.size(tokens) > 0).select(item_key, F.col(tokens).alias("_want"), F.least(F.size(tokens), F.lit(n)).alias("_n"))
    lengths = sorted(r[0] for r in i.select("_n").distinct().collect())  # at most n numbers
    head = lambda k: F.xxhash64(*(F.get("_want", F.lit(m)) for m in range(k)), F.lit(k))
    i = i.withColumn("_head", F.coalesce(*(F.when(F.col("_n") == F.lit(k), head(k)) for k in lengths)))
    if not lengths:
        return docs.select(doc_key).limit(0).withColumns({item_key: F.lit(None).cast(dict(items.dtypes)[item_key]), "first_tok": F.lit(None).cast("int")})
    # One row of 2^16 bits: where the low bits of a head are set.
    place = lambda h: F.pmod(h, F.lit(_HEAD_BITS))
    words = i.select((place(F.col("_head")) / 64).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (place(F.col("_head")) % 64).cast("int")).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).collect()
    bits = [0] * (_HEAD_BITS // 64)
    for r in words:
        bits[r.w] = r.b
    table = F.array(*(F.lit(b).cast("long") for b in bits))
    may = lambda h: F.getbit(F.get(table, (place(h) / 64).cast("int")), (place(h) % 64).cast("int")) == 1
    starts = lambda k: F.when(F.size(tokens) >= k, F.sequence(F.lit(1), F.size(tokens) - (k - 1))).otherwise(F.array().cast("array<int>"))
    # Item by item, as a slice copies the whole list each time.
    hashed = lambda k: F.transform(starts(k), lambda j: F.struct((j - 1).alias("at"), F.xxhash64(*(F.get(tokens, j + (m - 1)) for m in range(k)), F.lit(k)).alias("h")))
    windows = F.concat(*map(hashed, lengths))
    met = F.filter(windows, lambda x: may(x["h"]))
    heads = spread(docs.select(doc_key, tokens)).select(doc_key, F.col(tokens).alias("_tokens"), met.alias("_met"))
    places = heads.select(doc_key, "_tokens", "_met", F.explode(F.array_distinct(F.transform("_met", lambda x: x["h"]))).alias("_h"))
    held = places.join(i, F.col("_h") == F.col("_head"))
    fits = F.filter("_met", lambda x: (x["h"] == F.col("_h")) & (F.slice("_tokens", x["at"] + 1, F.size("_want")) == F.col("_want")))
    first = F.array_min(F.transform(fits, lambda x: x["at"]))
    found = held.select(doc_key, item_key, F.explode(F.filter(F.array(first), lambda x: x.isNotNull())).alias("first_tok"))
    return found.groupBy(doc_key, item_key).agg(F.min("first_tok").alias("first_tok"))


def first_in_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key; repeated mentions of one place become one."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def runs(df: DataFrame, by: Sequence[str], order: Sequence[Column], label: str) -> DataFrame:
    """Adds ``run``, numbering stretches of equal labels in order."""
    w = Window.partitionBy(*by).orderBy(*order)
    change = F.coalesce((~F.col(label).eqNullSafe(F.lag(label).over(w))).cast("int"), F.lit(1))
    change = F.when(F.row_number().over(w) == 1, 1).otherwise(change)
    return df.withColumn("_new", change).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_new")


def running_offset(df: DataFrame, by: Sequence[str], order: Sequence[Column], size: Column, out: str = "offset") -> DataFrame:
    """The sum of sizes before each row."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(size).over(w), F.lit(0)))


def spans_by_document(df: DataFrame, by: Sequence[str], order: Sequence[str], fields: Sequence[str], out: str = "entities") -> DataFrame:
    """Mention rows gathered into one array for each document, in order."""
    item = F.struct(*order, *(f for f in fields if f not in order))
    got = df.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("_a"))
    return got.withColumn(out, F.transform("_a", lambda x: F.struct(*(x[f].alias(f) for f in fields)))).drop("_a")


def relation_records(relations: DataFrame, docs: DataFrame, key: str = "PMID", text: str = "text") -> DataFrame:
    """Nested records: each document's tokens, its mentions as token spans (each
    place once, by the least type and text) and its relations between them, each
    sorted.

    A mention whose first or last character lies on no token is dropped, and so
    is a relation that needs it; documents left without a relation give no
    record.  A document's relations meet its text once, and all else is done in
    its row."""
    ends = ("Subject", "Object")
    met = _in_documents(docs, relations.select(key, *(f"{e}{x}" for e in ends for x in ("", "_Type", "_Start", "_End")), "Relation"), key, text)
    span = lambda r, e: F.struct(token_at(F.col("_t"), r[f"{e}_Start"]).alias("start_tok"), token_at(F.col("_t"), r[f"{e}_End"] - 1).alias("end_tok"), r[f"{e}_Type"].alias("type"), r[e].alias("text"))
    placed = met.select(key, "_t", F.transform("_rows", lambda r: F.struct(*(span(r, e).alias(e) for e in ends), r["Relation"].alias("relation_text"))).alias("_r"))
    on_tokens = lambda m: m["start_tok"].isNotNull() & m["end_tok"].isNotNull()
    every = F.filter(F.concat(F.transform("_r", lambda r: r["Subject"]), F.transform("_r", lambda r: r["Object"])), on_tokens)
    same = lambda a, b: (a["start_tok"] == b["start_tok"]) & (a["end_tok"] == b["end_tok"])
    # Sorted, so the first of each place is the least.
    ner = let(F.sort_array(F.array_distinct(every)), lambda s: F.filter(s, lambda m, i: (i == 0) | ~F.coalesce(same(m, F.get(s, i - 1)), F.lit(False))))
    side = lambda m: F.struct(m["text"].alias("mention"), F.array(m["start_tok"], m["end_tok"]).alias("position"), m["type"].alias("type"))
    whole = F.filter("_r", lambda r: on_tokens(r["Subject"]) & on_tokens(r["Object"]))
    related = F.sort_array(F.transform(whole, lambda r: F.struct(side(r["Subject"]).alias("head"), side(r["Object"]).alias("tail"), r["relation_text"].alias("relation_text"))))
    record = F.struct(ner.alias("ner"), related.alias("relations"), F.transform("_t", lambda t: t["token"]).alias("tokenized_text"))
    # Not by where(), which would be pushed down and place all tokens again.
    kept = F.filter(F.array(record), lambda r: F.size(r["relations"]) > 0)
    return placed.select(key, F.explode(kept).alias("_k")).select(key, "_k.*")
