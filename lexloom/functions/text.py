"""Column functions over text: cleaning, tokens, prompts, lenient parsing."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Token and prefix patterns.
TOKEN = r"[\p{L}\p{N}_]+(?:[-_][\p{L}\p{N}_]+)*|[^\s\p{Z}]"
CONTEXT_PREFIX = r"(?i).*?Text:"
PAGE_SINGLE = r"page_content='([^']*)'"
PAGE_EITHER = r"""page_content=(?:'((?:[^'\\]|\\.)*)'|"((?:[^"\\]|\\.)*)")"""
SCORE = r"relevance_score': ([0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)"
#: Tokens that take no blank before them.
PUNCTUATION = (",", ".", "!", "?", ":", ";", "...")

#: Escapes and what they decode to, in the order applied; the
#: first makes a double escape decode twice.
ESCAPES = (
    ("\\\\", "\\"),
    ('\\"', '"'),
    ("\\b", "\b"),
    ("\\f", "\f"),
    ("\\n", "\n"),
    ("\\r", "\r"),
    ("\\t", "\t"),
)


def part(col: Column | str, sep: str, i: int) -> Column:
    """The ``i``-th piece (from 0) between literal separators; null if absent."""
    return F.get(F.split(col, re.escape(sep)), F.lit(i))


def pieces(col: Column | str, sep: str) -> Column:
    return F.split(col, re.escape(sep))


def strip_characters(col: Column | str, characters: str) -> Column:
    """Every one of ``characters`` removed, anywhere in the text."""
    return F.translate(col, characters, "")


def join_columns(sep: str, *cols: Column | str) -> Column:
    """Columns joined by a separator; null if any is null."""
    out: list[Column] = []
    for c in cols:
        out += [F.lit(sep)] if out else []
        out.append(F.col(c) if isinstance(c, str) else c)
    return F.concat(*out)


def text_or(col: Column | str, null_literal: str | None = None) -> Column:
    """As a string; null stays null or becomes a literal such as ``nan``."""
    text = (F.col(col) if isinstance(col, str) else col).cast("string")
    return text if null_literal is None else F.coalesce(text, F.lit(null_literal))


def numbered_options(*cols: Column | str, sep: str = " ", null_literal: str | None = "nan") -> Column:
    """``1) a 2) b ...``"""
    return join_columns(sep, *(F.concat(F.lit(f"{i}) "), text_or(c, null_literal)) for i, c in enumerate(cols, 1)))


def as_python_dict(m: Column | str) -> Column:
    """A map as the text of a dict of strings; quotes inside are not escaped."""
    pair = lambda e: F.concat(F.lit("'"), e["key"], F.lit("': '"), F.coalesce(e["value"], F.lit("None")), F.lit("'"))
    return F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(m), pair), ", "), F.lit("}"))


def tokenize(col: Column | str) -> Column:
    """Words with inner hyphens or underscores, and single other characters."""
    return F.regexp_extract_all(col, F.lit(TOKEN), F.lit(0))


def running_sums(values: Column, block: int = 2_048) -> Column:
    """For each item of an array of whole numbers the sum of those before it.

    Summed in blocks, then over blocks.  Inside a block the sums grow as text,
    which the engine appends to far faster than to an array."""

    def body(v: Column) -> Column:
        n_blocks = F.ceil(F.size(v) / block).cast("int")
        cut = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda b: F.slice(v, b * block + 1, F.lit(block)))
        grown = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["sums"], acc["at"].cast("string"), F.lit(",")).alias("sums"))
        inside = F.transform(cut, lambda x: F.aggregate(x, F.struct(F.lit(0).alias("at"), F.lit("").alias("sums")), grown))
        over = lambda i: F.aggregate(i, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x["at"])))
        numbers = lambda x: F.split(F.substring(x["sums"], F.lit(1), F.length(x["sums"]) - 1), ",")
        placed = let(inside, lambda i: let(over(i), lambda o: F.transform(i, lambda x, b: F.transform(numbers(x), lambda y: y.cast("int") + F.get(o, b)))))
        return F.when(F.size(v) > 0, F.flatten(placed)).otherwise(F.array().cast("array<int>"))

    return let(values, body)


def let(value: Column, body) -> Column:
    """``body(value)`` with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def token_places(col: Column | str, keep: Callable[[Column], Column] | None = None) -> Column:
    """Tokens with their places, ``array<struct<idx,start,end,token>>``: ends are
    exclusive, in characters.  ``keep`` takes a token's text and says whether it
    is wanted; the others still count for ``idx``.  Null text gives null.

    Gaps and tokens alternate in a text, so a token starts at the sum of the
    lengths before it; nothing leaves the row."""
    text = F.col(col) if isinstance(col, str) else col

    def every(x: Column) -> Column:
        lengths = F.zip_with(x["gaps"], x["tokens"], lambda g, t: F.length(g) + F.coalesce(F.length(t), F.lit(0)))
        at = F.zip_with(x["tokens"], running_sums(lengths), lambda t, before: F.struct(before.alias("before"), t.alias("token")))
        start = lambda y, i: y["before"] + F.length(F.get(x["gaps"], i))
        return F.filter(F.transform(at, lambda y, i: F.struct(i.alias("idx"), start(y, i).alias("start"), (start(y, i) + F.length(y["token"])).alias("end"), y["token"].alias("token"))), lambda y: y["token"].isNotNull())

    def some(x: Column) -> Column:
        def add(acc: Column, y: Column) -> Column:
            start = acc["at"] + F.length(y["g"])
            end = start + F.length(y["t"])
            own = F.array(F.struct(acc["idx"].alias("idx"), start.alias("start"), end.alias("end"), y["t"].alias("token")))
            return F.struct((acc["idx"] + 1).alias("idx"), end.alias("at"), F.when(keep(y["t"]), F.concat(acc["found"], own)).otherwise(acc["found"]).alias("found"))

        # The last gap has no token.
        pairs = F.zip_with(F.slice(x["gaps"], F.lit(1), F.size(x["tokens"])), x["tokens"], lambda g, t: F.struct(g.alias("g"), t.alias("t")))
        zero = F.struct(F.lit(0).alias("idx"), F.lit(0).alias("at"), F.array().cast("array<struct<idx:int,start:int,end:int,token:string>>").alias("found"))
        return F.aggregate(pairs, zero, add, lambda acc: acc["found"])

    return F.when(text.isNotNull(), let(F.struct(F.split(text, TOKEN, -1).alias("gaps"), tokenize(text).alias("tokens")), some if keep else every))


def below(items: Column, field: str, value: Column) -> Column:
    """How many items of an array of structs, sorted by ``field``, are below a
    value there: binary search."""
    half = lambda at: F.floor((at["lo"] + at["hi"]) / 2).cast("int")
    step = lambda at, _: F.when(at["lo"] >= at["hi"], at).when(F.get(items, half(at))[field] < value, F.struct((half(at) + 1).alias("lo"), at["hi"].alias("hi"))).otherwise(F.struct(at["lo"].alias("lo"), half(at).alias("hi")))
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(items) + F.lit(1))).cast("int"))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(items).alias("hi")), step, lambda at: at["lo"])


def strip_context_prefix(col: Column | str) -> Column:
    """Each run up to ``Text:`` removed; a dot doesn't match a line break, so
    with real line breaks only text on the same line goes."""
    return F.regexp_replace(col, CONTEXT_PREFIX, "")


def lstrip(col: Column | str, characters: str) -> Column:
    return F.ltrim(F.col(col) if isinstance(col, str) else col, F.lit(characters))


def page_contents(col: Column | str, literal: bool = False) -> Column:
    """Texts of a printed document list; ``literal`` knows single quotes only
    and so passes over any text with an apostrophe."""
    if literal:
        return F.regexp_extract_all(col, F.lit(PAGE_SINGLE), F.lit(1))
    whole = F.regexp_extract_all(col, F.lit(PAGE_EITHER), F.lit(0))
    return F.transform(whole, lambda x: F.substring(x, 15, F.length(x) - 15))


def relevance_scores(col: Column | str) -> Column:
    return F.transform(F.regexp_extract_all(col, F.lit(SCORE), F.lit(1)), lambda x: x.cast("double"))


def clean_content(col: Column | str) -> Column:
    return lstrip(strip_context_prefix(col), ". ")


def wide(array: Column | str, name: str, k: int) -> list[Column]:
    """An array's first ``k`` items as numbered columns, null where it is short."""
    return [F.get(array, F.lit(i)).alias(f"{name}_{i + 1}") for i in range(k)]


def mean_present(array: Column | str) -> Column:
    """The mean of an array's non-null items; null if there are none."""
    kept = F.filter(array, lambda x: x.isNotNull())
    total = F.aggregate(kept, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return F.when(F.size(kept) > 0, total / F.size(kept))


def decode_escapes(col: Column | str) -> Column:
    """Escapes decoded one after another in a fixed order; null stays null."""
    out = F.col(col) if isinstance(col, str) else col
    for old, new in ESCAPES:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def detokenize(tokens: Column | str) -> Column:
    """Tokens joined by blanks, none before punctuation."""
    add = lambda acc, t: F.when(t.isin(*PUNCTUATION) | (acc == ""), F.concat(acc, t)).otherwise(F.concat(acc, F.lit(" "), t))
    return F.aggregate(tokens, F.lit(""), add)


def tidy_punctuation(col: Column | str) -> Column:
    """A blank before a punctuation mark removed."""
    return F.regexp_replace(col, r"\s(?=[,.!?…:;])", "")


def template(pattern: str, **values: Column | str) -> Column:
    """``{name}`` places filled from columns; null makes the whole null."""
    out: list[Column] = []
    for i, piece in enumerate(re.split(r"\{(\w+)\}", pattern)):
        if i % 2:
            v = values[piece]
            out.append((F.col(v) if isinstance(v, str) else v).cast("string"))
        elif piece:
            out.append(F.lit(piece))
    return F.concat(*out)


def lenient_json(col: Column | str, schema: T.DataType | str) -> Column:
    """The first to the last brace of a reply, parsed; control characters in
    strings are let pass; null if nothing parses."""
    body = F.regexp_extract(F.trim(col), r"(?s)\{.*\}", 0)
    return F.from_json(body, schema, {"mode": "PERMISSIVE", "allowUnquotedControlChars": "true"})


def has_fields(struct: Column, fields: Sequence[str]) -> Column:
    """Whether every required field of a parsed object is there."""
    out = struct.isNotNull()
    for f in fields:
        out = out & struct[f].isNotNull()
    return F.coalesce(out, F.lit(False))


def lookup(table: Mapping[str, object], key: Column, default: object) -> Column:
    """A small constant mapping with a default for absent keys."""
    m = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.coalesce(F.try_element_at(m, key), F.lit(default))


def pick_by_hash(options: Sequence[str], key: Column | str) -> Column:
    """One of several texts, chosen by a hash of the row's key."""
    return F.element_at(F.array(*map(F.lit, options)), F.pmod(F.xxhash64(key), F.lit(len(options))).cast("int") + 1)


def option_letter(reply: Column | str) -> Column:
    """The option number (1 to 4) that a reply names: a lone digit or letter
    after words such as "answer" or "option", else one that stands first."""
    text = F.col(reply) if isinstance(reply, str) else reply
    named = F.regexp_extract(text, r"(?i)(?:answer|option|choice)\W{0,3}(?:is\W{0,3})?([1-4a-d])\b", 1)
    first = F.regexp_extract(text, r"(?i)^\W*([1-4a-d])(?:\W|$)", 1)
    found = F.lower(F.when(named != "", named).otherwise(first))
    return F.when(found == "", None).otherwise(F.try_to_number(F.translate(found, "abcd", "1234"), F.lit("9")).cast("int"))


_DOCUMENTS = T.ArrayType(T.StructType([T.StructField("page_content", T.StringType()), T.StructField("metadata", T.StringType())]))


@F.pandas_udf(_DOCUMENTS)
def python_documents(texts: pd.Series) -> pd.Series:
    """A printed list of documents by Python's own literal rules, for texts that
    patterns can't take apart; null where it is no such list."""

    def one(text: str | None):
        try:
            tree = ast.parse(text or "", mode="eval").body
            out = []
            for call in tree.elts:
                named = {k.arg: ast.literal_eval(k.value) for k in call.keywords}
                out.append({"page_content": named.get("page_content"), "metadata": str(named.get("metadata", {}))})
            return out
        except (SyntaxError, ValueError, AttributeError, TypeError):
            return None

    return texts.map(one)


@F.pandas_udf(T.ArrayType(T.StringType()))
def split_recursively(texts: pd.Series, size: pd.Series) -> pd.Series:
    """Chunks of at most ``size`` characters, cut at the coarsest separator that
    fits: paragraph, line, sentence, blank, anywhere."""

    def cut(text: str, n: int, seps: tuple[str, ...]) -> list[str]:
        if len(text) <= n:
            return [text] if text else []
        if not seps:
            return [text[i : i + n] for i in range(0, len(text), n)]
        out, held = [], ""
        for piece in re.split(f"(?<={re.escape(seps[0])})", text):
            if len(held) + len(piece) <= n:
                held += piece
                continue
            out += [held] if held else []
            held = ""
            if len(piece) <= n:
                held = piece
            else:
                *more, held = cut(piece, n, seps[1:])
                out += more
        return out + ([held] if held else [])

    return pd.Series([None if t is None else cut(t, int(n), ("\n\n", "\n", ". ", " ")) for t, n in zip(texts, size)])


def array_batches(array: Column | str, size: int) -> Column:
    """An array cut into arrays of ``size`` items, the last one shorter."""
    items = F.col(array) if isinstance(array, str) else array
    starts = F.when(F.size(items) > 0, F.sequence(F.lit(1), F.size(items), F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.when(items.isNotNull(), F.transform(starts, lambda i: F.slice(items, i, F.lit(size))))


def chunks(col: Column | str, size: int, overlap: int = 0) -> Column:
    """Pieces of ``size`` characters, each ``overlap`` into the one before."""
    text = F.col(col) if isinstance(col, str) else col
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(size - overlap))
    cut = F.filter(F.transform(starts, lambda i: F.substring(text, i, F.lit(size))), lambda x: x != "")
    return F.when(text.isNotNull(), cut)


def digest(*columns: str) -> Column:
    """SHA-256 over the columns' values; null differs from every value."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
