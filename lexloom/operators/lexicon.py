"""Lexicons: cleaning, patterns, and matching texts against them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import digest, pieces, strip_characters, tokenize
from .ranking import spread

#: Up to so many terms one pattern is tried; an automaton gives the same beyond.
PATTERN_TERMS = 200
#: Up to so many terms are written into a plan.
LITERAL_TERMS = 1_000


def clean_terms(lexicon: DataFrame, column: str, sep: str, strip: str = "") -> DataFrame:
    """One term a row: cells split at a literal separator, given characters
    removed, blanks trimmed, empty ones dropped, each term once."""
    terms = lexicon.select(F.explode(pieces(column, sep)).alias("term"))
    terms = terms.select(F.trim(strip_characters("term", strip) if strip else F.col("term")).alias("term"))
    return terms.where("term <> ''").distinct()


def alternation(terms: Sequence[str]) -> str:
    """One pattern for quoted terms, longest first, in any letter case."""
    ordered = sorted(set(terms), key=lambda t: (-len(t), t))
    return "(?iu)(?:" + "|".join(re.escape(t) for t in ordered) + ")"


def contains_term(col: Column | str, pattern: str) -> Column:
    """Whether a text matches; null counts as no match."""
    return F.coalesce(F.rlike(col, F.lit(pattern)), F.lit(False))


def any_item_matches(array: Column | str, pattern: str) -> Column:
    return F.coalesce(F.exists(array, lambda x: x.rlike(pattern)), F.lit(False))


def distinct_rows(df: DataFrame) -> DataFrame:
    """Each distinct row once, told apart by a digest of all its columns: those
    that a later step doesn't use aren't shuffled."""
    return df.withColumn("_digest", digest(*df.columns)).dropDuplicates(["_digest"]).drop("_digest")


def match_any(df: DataFrame, columns: Sequence[str], pattern: str, dedupe: bool = True) -> DataFrame:
    """Rows that match in any of several columns, in one scan; nulls don't match.

    With ``dedupe`` each distinct row once; without, a row as many times as
    columns of it match, as a union of one arm for each column gives."""
    return _matched(df, columns, [contains_term(c, pattern) for c in columns], dedupe)


def _matched(df: DataFrame, columns: Sequence[str], arms: Sequence[Column], dedupe: bool) -> DataFrame:
    if dedupe:
        return distinct_rows(df.where(reduce(lambda a, b: a | b, arms)))
    hits = F.array_compact(F.array(*(F.when(a, F.lit(c)) for a, c in zip(arms, columns))))
    return df.withColumn("_arm", F.explode(hits)).drop("_arm")


def hits_by_term(df: DataFrame, text: str, terms: DataFrame, key: str) -> DataFrame:
    """Per single-word term: rows and places where it stands as a token, in any
    letter case; rows that share a key count once.  Terms that stand nowhere
    give no row, null texts and terms count for nothing.

    Up to LITERAL_TERMS terms pick their tokens inside the row; more are met by
    a join, after each row's tokens are counted."""
    wanted = terms.where("term IS NOT NULL").select(F.lower("term").alias("token"), "term").distinct()
    few = [r[0] for r in wanted.select("token").distinct().limit(LITERAL_TERMS + 1).collect()]
    tokens = F.transform(tokenize(text), F.lower)
    if len(few) <= LITERAL_TERMS:
        tokens = F.filter(tokens, lambda t: t.isin(few)) if few else F.array().cast("array<string>")
    counts = spread(df.select(key, text)).select(F.col(key).alias("_key"), F.explode(tokens).alias("token")).groupBy("_key", "token").agg(F.count(F.lit(1)).alias("n"))
    found = counts.join(wanted, "token")
    return found.groupBy("term").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n").alias("n_hits"))


class _Folded(dict):
    """Letters folded one by one, as a pattern with flags ``iu`` compares them."""

    def __missing__(self, at: int) -> str:
        c = chr(at)
        up = c.upper() if len(c.upper()) == 1 else c
        self[at] = up.lower() if len(up.lower()) == 1 else up
        return self[at]


_FOLDED = _Folded()


def folded(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_FOLDED)


def contains_any(terms: Sequence[str]) -> Callable[[Column], Column]:
    """A condition that a text holds any of many terms, as ``contains_term``
    means it: an automaton over all terms, made once in a worker, reads each
    text once whatever their number."""
    wanted = sorted({folded(t) for t in terms})

    @F.pandas_udf("boolean")
    def holds(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        found = ahocorasick.Automaton()
        for t in wanted:
            found.add_word(t, True)
        found.make_automaton()
        for texts in batches:
            yield pd.Series([t is not None and next(found.iter(folded(t)), None) is not None for t in texts], dtype="bool")

    return holds


def filter_by_terms(df: DataFrame, columns: Sequence[str], terms: Sequence[str], dedupe: bool = True) -> DataFrame:
    """``match_any`` for any number of terms: one pattern for up to PATTERN_TERMS,
    an automaton beyond, with the same results.  A term is found inside longer
    words too; empty terms are left out, and no terms match nothing."""
    terms = [t for t in terms if t]
    if not terms:
        return df.limit(0)
    if len(terms) <= PATTERN_TERMS:
        return match_any(df, columns, alternation(terms), dedupe)
    holds = contains_any(terms)
    return _matched(df, columns, [holds(F.col(c).cast("string")) for c in columns], dedupe)
