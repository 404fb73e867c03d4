"""Quality rules as a short-circuit cascade (operator 6).

Each rule rejects a text by a few measures of it.  A sample tells what share of
texts each rule rejects, and each measure is timed on it; rules then stand in
order of rejection per cost, and a rule is evaluated only for texts that all
before it have passed: its measures stand inside its branch.  Measures that a
caller is owed for every row are computed beside the cascade and cost a rule
nothing.  The order changes the work, never the verdict.

Everything is built of SQL functions.  ``cascade`` names the rule that rejects;
``measures`` gives every measure of every text.

Defined results: null text counts as empty; a text without words has only zeros
and fails the base rules; very long texts are measured whole; rows with a null
id and repeated rows are judged as any other; rules that tie in rejection per
cost go by cost, then name; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, stage

#: About so many rows are sampled, twice as many at most.
SAMPLE_ROWS = 2_000
BASE_WORDS = 50
BASE_REPEAT_PERCENT = 50

SPACE_CLASS = r"[\x20\x09-\x0D]"


def let(value: Column, body) -> Column:
    """``body(value)`` with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    bare = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_CLASS + "+"))


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that the text has twice or more.

    Windows are compared by 64-bit hashes; only a text that repeats one sorts
    them, to find which words they cover."""
    n = F.size(words)
    windows = F.expr("transform(sequence(0, size(_words) - 3), i -> xxhash64(_words[i], _words[i + 1], _words[i + 2]))")

    def covered(hashes: Column) -> Column:
        # Hashes in order, each with its place; equal neighbours are repeats.
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda i, j: F.coalesce(F.get(s, j)["h"] == F.get(s, i)["h"], F.lit(False))
            marked = F.transform(s, lambda x, i: F.when(same(i, i - 1) | same(i, i + 1), x["i"]))
            return F.sort_array(F.array_compact(marked))

        # Each repeated window covers three words, less the overlap with the one before.
        step = lambda p: F.transform(p, lambda x, k: F.when(k == 0, F.lit(3)).otherwise(F.least(F.lit(3), x - F.get(p, k - 1))))
        total = lambda v: F.aggregate(v, F.lit(0), lambda a, x: a + x)
        return let(ordered, lambda s: let(places(s), lambda p: total(step(p))))

    found = let(windows, lambda hashes: F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(covered(hashes)))
    return F.when(n < 4, F.lit(0)).otherwise(found).cast("long")


@dataclass(frozen=True)
class Measure:
    """A value of ``_text`` and ``_words``."""

    name: str
    value: Column


def base_measures() -> list[Measure]:
    count = lambda kept: F.length(F.regexp_replace("_text", f"[^{kept}]+", "")).cast("long")
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return [
        Measure("n_words", F.size("_words").cast("long")),
        Measure("word_chars", F.length(F.array_join("_words", "")).cast("long")),
        Measure("n_symbols", count("#*$%&|<>")),
        Measure("n_dup_lines", let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")),
        Measure("n_repeat_words", repeated_words(F.col("_words"))),
        Measure("n_marks", count("!?")),
        Measure("n_capitals", count(r"\p{Lu}")),
    ]


@dataclass(frozen=True)
class Rule:
    """``rejects`` gets the needed measures by name and gives a condition."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[[Mapping[str, Column]], Column]


#: The base rules come first; the cascade sets the order.
RULES = (
    Rule("few_words", ("n_words",), lambda m: m["n_words"] < BASE_WORDS),
    Rule("repeated_words", ("n_words", "n_repeat_words"), lambda m: 100 * m["n_repeat_words"] > BASE_REPEAT_PERCENT * m["n_words"]),
    Rule("symbols", ("n_words", "n_symbols"), lambda m: 10 * m["n_symbols"] > m["n_words"]),
    Rule("word_length", ("n_words", "word_chars"), lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 15 * m["n_words"])),
    Rule("repeated_lines", ("n_words", "n_dup_lines"), lambda m: (m["n_dup_lines"] >= 10) & (10 * m["n_dup_lines"] > m["n_words"])),
    Rule("shouting", ("word_chars", "n_capitals"), lambda m: 10 * m["n_capitals"] > 4 * m["word_chars"]),
    Rule("marks", ("n_words", "n_marks"), lambda m: 2 * m["n_marks"] > m["n_words"]),
)
BASE_RULES = ("few_words", "repeated_words")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = pick(docs, id=id_col, text=text_col).select("id", F.coalesce("text", F.lit("")).alias("_text"))
    return rows.withColumn("_words", words_of(F.col("_text")))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and every measure."""
    return _texts(docs, id_col, text_col).select("id", *(m.value.alias(m.name) for m in base_measures()))


def _sample(texts: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` texts by a hash of id and text, 2 ``rows`` at most; written,
    so that timing reads nothing else."""
    step = max(1, texts.count() // max(rows, 1))
    drawn = texts.where(F.pmod(F.xxhash64("id", "_text"), F.lit(step)) == 0).limit(2 * rows)
    return stage(drawn.select("id", "_text"), "rules-sample").withColumn("_words", words_of(F.col("_text")))


def _seconds(sample: DataFrame, value: Column, times: int = 2) -> float:
    def once() -> float:
        began = time.perf_counter()
        sample.select(value).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    return min(once() for _ in range(times))


def costs(sample: DataFrame, measures: Sequence[Measure]) -> dict[str, float]:
    """Seconds that each measure takes on a sample, beyond those for its words."""
    spare = _seconds(sample, F.size("_words"), 3)
    return {m.name: max(_seconds(sample, m.value) - spare, 1e-4) for m in measures}


def order_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, owed: Sequence[str] = (), measures: Sequence[Measure] | None = None) -> list[Rule]:
    """Rules by rejection per cost on a sample, drawn by hash.

    Greedy: each place goes to the rule with the most rejections, of sampled
    texts that all rules before it pass, for the cost of its measures; owed ones
    cost nothing."""
    known = base_measures() if measures is None else list(measures)
    used = {m for r in rules for m in r.needs}
    sample = _sample(_texts(docs, id_col, text_col), sample_rows)
    flags = sample.select(*(m.value.alias(m.name) for m in known if m.name in used))
    # Numbers of at most 2 sample_rows rows.
    seen = flags.select(*(F.coalesce(r.rejects({m: F.col(m) for m in r.needs}), F.lit(False)).cast("int").alias(r.name) for r in rules)).collect()
    priced = costs(sample, [m for m in known if m.name in used and m.name not in owed]) if seen else {}
    left, out = list(rules), []
    while left:
        passed = [r for r in seen if not any(r[x.name] for x in out)]

        def gain(rule: Rule) -> tuple[float, float, str]:
            cost = 1e-6 + sum(priced.get(m, 0.0) for m in rule.needs)
            return -sum(r[rule.name] for r in passed) / cost, cost, rule.name

        best = min(left, key=gain)
        out.append(best)
        left.remove(best)
    return out


def cascade(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text", owed: Sequence[str] = (), sample_rows: int = SAMPLE_ROWS, ordered: Sequence[Rule] | None = None, measures: Sequence[Measure] | None = None) -> DataFrame:
    """Per row: id, the ``owed`` measures, rejected_by (the first rule in order
    that rejects, null if none does) and kept.

    Any other measure is a part of its rule's branch and only computed where the
    branch is reached.  ``ordered`` gives rules in an order found before."""
    known = {m.name: m.value for m in (base_measures() if measures is None else measures)}
    ordered = order_rules(docs, rules, id_col, text_col, sample_rows, owed, measures) if ordered is None else ordered
    rows = _texts(docs, id_col, text_col)
    rows = rows.select("id", "_text", "_words", *(known[m].alias(f"_m_{m}") for m in owed))

    def rejects(rule: Rule) -> Column:
        given = {m: F.col(f"_m_{m}") for m in rule.needs if m in owed}
        own = [m for m in rule.needs if m not in owed]
        if not own:
            return rule.rejects(given)
        return let(F.struct(*(known[m].alias(m) for m in own)), lambda x: rule.rejects(given | {m: x[m] for m in own}))

    first = None
    for rule in ordered:
        first = F.when(rejects(rule), rule.name) if first is None else first.when(rejects(rule), rule.name)
    out = rows.withColumn("rejected_by", F.lit(None).cast("string") if first is None else first)
    return out.select(F.col("id").alias(id_col), *(F.col(f"_m_{m}").alias(m) for m in owed), "rejected_by", F.col("rejected_by").isNull().alias("kept"))
