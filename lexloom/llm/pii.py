"""Personal data by candidate boosting (operator 10).

Base spans come from four fixed patterns with a check each.  Beyond them,
high-recall generators propose overlapping spans of the same kinds and of
secrets (keys, tokens, passwords); gradient-boosted trees score each by its
format and context; thresholds calibrated for each kind decide, and of
overlapping accepted spans the best scored stays.  Base spans always stay.

The trees are trained on the driver, on TRAIN_TEXTS invented texts with a fixed
seed, half of whose items only look like personal data; their features go
through the same SQL as those of documents, and the trained trees become SQL
conditions.  Nothing but SQL functions touches a document.  ``report`` measures
precision and recall of each kind on texts that neither trees nor thresholds
have seen.

Offsets are code points, ends exclusive.  Defined results: null text counts as
empty and has no span; very long texts are searched whole; spans that tie in
score fall by start, kind and end; rows with a null id and repeated rows are
searched as any other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import random
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")

# The base patterns.  Repetitions that nothing follows are written
# possessively, and a run is tried from its start only, which finds the same
# matches without recursion or quadratic search.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried at all.
GUARD = {"email": "@", "ip": ".", "card": "", "phone": "+"}

#: Candidate generators: kind, pattern.
GENERATORS = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]{2,24}){1,4}"),
    ("ip", r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}"),
    ("ip", r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"),
    ("card", r"(?<![0-9])[0-9]{16}(?![0-9])"),
    ("card", r"(?<![0-9])[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])"),
    ("card", r"(?<![0-9])3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![0-9])"),
    ("phone", r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,3}"),
    ("phone", r"\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}"),
    ("phone", r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}"),
    ("phone", r"(?<![0-9.+-])00[1-9][0-9]{1,2}[ .-]?[0-9]{2,4}(?:[ .-][0-9]{2,4}){2,3}"),
    ("ip", r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){1,7}:(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?(?![0-9A-Za-z:])"),
    ("secret", r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,128}(?![0-9A-Za-z])"),
    ("secret", r"(?<![0-9A-Za-z_-])(?:AKIA|ASIA|AIza|ghp_|gho_|xox[bp]-|[sp]k[_-](?:live_|test_)?)[0-9A-Za-z_-]{12,128}"),
    ("secret", r"(?<![0-9A-Za-z_-])eyJ[0-9A-Za-z_-]{8,512}\.[0-9A-Za-z_-]{8,1024}\.[0-9A-Za-z_-]{8,512}"),
    ("secret", r"(?<=[=:] ?[\"'])[!-&(-~]{8,128}(?=[\"'])"),
)
CONTEXT = 24
TRAIN_TEXTS = 4_000
#: Cuts of a feature that a split tries.
CUTS = 64
SPAN = "array<struct<start:int,end:int,value:string>>"


def let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def find(text: Column, pattern: str) -> Column:
    """All matches with their places.  A text is the pieces between matches and
    the matches in turn, so places are sums of their lengths."""
    pieces, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def place(m: Column) -> Column:
        def add(acc: Column, x: Column) -> Column:
            start = acc["at"] + F.length(x["p"])
            end = start + F.length(x["m"])
            return F.struct(end.alias("at"), F.concat(acc["found"], F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("value")))).alias("found"))

        pairs = F.filter(F.arrays_zip(pieces.alias("p"), m.alias("m")), lambda x: x["m"].isNotNull())
        named = F.transform(pairs, lambda x: F.struct(x["p"].alias("p"), x["m"].alias("m")))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("found"))
        return F.aggregate(named, zero, add, lambda acc: acc["found"])

    return let(matches, lambda m: F.when(F.size(m) == 0, F.array().cast(SPAN)).otherwise(place(m)))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether up to 30 digits pass the Luhn check."""

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(number, F.length(number) - i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.when(F.length(number).between(1, 30), F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), add) % 10 == 0).otherwise(False)


def octets(value: Column) -> Column:
    """Whether every part between stops is a number of at most 255."""

    def small(part: Column) -> Column:
        bare = F.ltrim(part, F.lit("0"))
        return F.when(F.length(bare) > 3, False).when(bare == "", True).otherwise(F.try_to_number(bare, F.lit("999")) <= 255)

    return F.forall(F.split(value, r"\."), small)


def base_spans(text: Column) -> dict[str, Column]:
    """Checked matches of each kind."""
    checks = {
        "email": lambda v: F.lit(True),
        "ip": octets,
        "card": lambda v: let(digits(v), lambda n: F.when(F.length(n).between(14, 19), luhn(n)).otherwise(False)),
        "phone": lambda v: F.length(digits(v)).between(10, 15),
    }
    passes = lambda check: lambda x: check(x["value"])
    return {k: F.filter(F.when(F.contains(text, F.lit(GUARD[k])), find(text, BASE[k])).otherwise(F.array().cast(SPAN)), passes(checks[k])) for k in BASE_KINDS}


_WORDS = {
    "about_phone": "phone|tel|call|mobile|fax|whatsapp",
    "about_card": "card|visa|credit|payment|mastercard|amex",
    "about_mail": "mail|contact|write|reach",
    "about_secret": "token|secret|key|passw|pwd|auth|bearer|credential",
    "about_hash": "commit|sha|md5|sum|hash|digest|revision|etag|uuid|blob",
    "about_other": r"version|release|section|figure|order|invoice|serial|isbn|build|item|ref|no\.|id",
}


def features(text: Column, kind: int, span: Column) -> Column:
    """A candidate: its kind, place and features of its format and context."""
    v = span["value"]
    number = digits(v)
    before = F.lower(F.substring(text, F.greatest(span["start"] - CONTEXT + 1, F.lit(1)), F.least(span["start"], F.lit(CONTEXT))))
    after = F.substring(text, span["end"] + 1, F.lit(3))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return F.struct(
        F.lit(kind).alias("kind"),
        span["start"].alias("start"),
        span["end"].alias("end"),
        F.length(number).alias("n_digits"),
        F.length(v).alias("n_chars"),
        F.length(F.regexp_replace(v, "[^ ().:-]", "")).alias("n_marks"),
        flag(v.startswith("+")).alias("plus"),
        flag(F.contains(v, F.lit("("))).alias("bracket"),
        flag(luhn(number)).alias("luhn"),
        F.size(F.array_distinct(F.split(number, ""))).alias("n_distinct"),
        flag(F.when(F.lit(kind == 1) & F.contains(v, F.lit(".")), octets(v))).alias("octets"),
        F.coalesce(F.try_to_number(F.substring(number, 1, 1), F.lit("9")).cast("int"), F.lit(-1)).alias("first_digit"),
        flag(before.rlike("[0-9a-z]$")).alias("glued_before"),
        flag(before.rlike("[0-9][.:/-]$")).alias("chained_before"),
        flag(after.rlike("^[0-9A-Za-z]")).alias("glued_after"),
        flag(after.rlike("^[.:/-][0-9]")).alias("chained_after"),
        flag(before.rlike("[0-9] $")).alias("number_before"),
        flag(after.rlike("^ [0-9]")).alias("number_after"),
        flag(v.rlike("[A-Za-z]{2,}$")).alias("letters_last"),
        F.length(F.regexp_replace(v, "[^A-Z]", "")).alias("n_upper"),
        F.length(F.regexp_replace(v, "[^a-z]", "")).alias("n_lower"),
        F.size(F.array_distinct(F.split(v, ""))).alias("n_different"),
        flag(before.rlike("[=:] ?[\"']?$")).alias("assigned"),
        flag(before.rlike("[\"']$") & after.rlike("^[\"']")).alias("quoted"),
        *(flag(before.rlike(w)).alias(n) for n, w in _WORDS.items()),
    )


FEATURES = ("kind", "n_digits", "n_chars", "n_marks", "plus", "bracket", "luhn", "n_distinct", "octets", "first_digit", "glued_before", "chained_before", "glued_after", "chained_after", "number_before", "number_after", "letters_last", "n_upper", "n_lower", "n_different", "assigned", "quoted", *_WORDS)


def candidates(text: Column) -> Column:
    """Every generator's proposals, overlapping ones too, with features."""
    described = lambda kind: lambda span: features(text, kind, span)
    found = [F.transform(find(text, p), described(KINDS.index(k))) for k, p in GENERATORS]
    return F.array_distinct(F.concat(*found))


@dataclass(frozen=True)
class Tree:
    """A split on feature <= at, or a leaf with a value."""

    value: float = 0.0
    feature: str = ""
    at: float = 0.0
    low: Tree | None = None
    high: Tree | None = None

    def sql(self, x: Column) -> Column:
        if self.low is None:
            return F.lit(self.value)
        return F.when(x[self.feature] <= F.lit(self.at), self.low.sql(x)).otherwise(self.high.sql(x))


@dataclass(frozen=True)
class Model:
    bias: float
    trees: tuple[Tree, ...]
    thresholds: tuple[float, ...]  # of the log-odds, by kind

    def score(self, x: Column) -> Column:
        return reduce(lambda a, t: a + t.sql(x), self.trees, F.lit(self.bias))

    def accepts(self, kind: Column, score: Column) -> Column:
        return score >= F.element_at(F.array(*map(F.lit, self.thresholds)), kind + 1)


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rate: float, out: np.ndarray, at: np.ndarray) -> Tree:
    """One regression tree on gradients g and curvatures h; adds its values to
    ``out``.  Splits maximise the usual second-order gain."""
    value = -rate * g.sum() / (h.sum() + 1.0)
    best = (1e-6, -1, 0.0)
    if depth:
        parent = g.sum() ** 2 / (h.sum() + 1.0)
        for j in range(x.shape[1]):
            values = np.unique(x[:, j])
            cuts = (values[:-1] + values[1:]) / 2
            # Evenly over the whole range where there are many.
            for cut in cuts[np.linspace(0, len(cuts) - 1, min(len(cuts), CUTS)).astype(int)] if len(cuts) else cuts:
                low = x[:, j] <= cut
                gl, hl = g[low].sum(), h[low].sum()
                gain = gl**2 / (hl + 1.0) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1.0) - parent
                if gain > best[0]:
                    best = (gain, j, float(cut))
    _, j, cut = best
    if j < 0:
        out[at] += value
        return Tree(float(value))
    low = x[:, j] <= cut
    return Tree(0.0, FEATURES[j], cut, _grow(x[low], g[low], h[low], depth - 1, rate, out, at[low]), _grow(x[~low], g[~low], h[~low], depth - 1, rate, out, at[~low]))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 24, depth: int = 3, rate: float = 0.4) -> tuple[float, list[Tree], np.ndarray]:
    p = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    bias = float(np.log(p / (1 - p)))
    s, trees = np.full(len(y), bias), []
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-s))
        trees.append(_grow(x, q - y, q * (1 - q), depth, rate, s, np.arange(len(y))))
    return bias, trees, s


def _luhn_number(rng: random.Random, first: str, n: int) -> str:
    body = first + "".join(rng.choice("0123456789") for _ in range(n - 1 - len(first)))
    total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(body))))
    return body + str(-total % 10)


def invented(seed: int = 5, n: int = TRAIN_TEXTS) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Texts, each with the (kind, start, end) of all its personal data: one or
    two items of it, a look-alike, or both, between words and the phrases that
    go with either."""
    rng = random.Random(seed)
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    h = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    alnum = lambda k: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghilmnorstuv") for _ in range(rng.randint(2, 9)))
    octet = lambda: str(rng.randint(0, 255))
    grouped = lambda s, sep: sep.join(s[i : i + 4] for i in range(0, len(s), 4))
    group = lambda: "%x" % rng.randint(1, 65535)
    card = lambda: grouped(_luhn_number(rng, rng.choice(["4", "4", "51", "52", "55", "6011"]), 16), rng.choice(["", "", " ", "-"]))
    phone = lambda: rng.choice([f"+1 ({d(3)}) {d(3)}-{d(4)}", f"+{rng.randint(1, 99)} {d(2)} {d(4)} {d(4)}", f"({rng.randint(201, 989)}) {d(3)}-{d(4)}", f"{rng.randint(201, 989)}-{d(3)}-{d(4)}", f"{rng.randint(201, 989)}.{d(3)}.{d(4)}", f"+1-{d(3)}-{d(3)}-{d(4)}", f"00{rng.randint(30, 99)} {d(3)} {d(3)} {d(4)}"])
    dot = lambda: rng.choice([".", " (dot) ", "(dot)", " [dot] "])
    email = lambda: f"{word()}{rng.choice([' (at) ', '(at)', ' [at] ', '[at]', '@'])}{word()}{dot()}{rng.choice(['com', 'org', 'net', 'de'])}"
    ip = lambda: rng.choice([".".join(octet() for _ in range(4)), ":".join(group() for _ in range(8)), ":".join(group() for _ in range(rng.randint(1, 4))) + "::" + group()])
    secret = lambda: rng.choice([h(32), h(40), h(64), alnum(24), alnum(40), "AKIA" + alnum(16).upper(), "ghp_" + alnum(36), "sk_live_" + alnum(24), f"eyJ{alnum(20)}.{alnum(40)}.{alnum(30)}"])
    names = ["token", "api_key", "secret", "password", "auth", "access_key", "key"]
    hashes = ["commit", "sha1", "md5", "checksum", "hash", "digest", "revision", "etag"]
    # Makers, what may stand before the value, and how both are put together.
    plain = ["{0} {1}", "{0} {1}", "{0}: {1}"]
    given = ['{0} = "{1}"', "{0}: '{1}'", '{0}="{1}"', "{0}={1}", "{0}: {1}"]
    good = {
        "phone": (phone, ["call", "phone", "tel.", "my mobile", "fax", "", "", ""], plain),
        "card": (card, ["card", "visa", "credit card number", "payment", "", "", ""], plain),
        "ip": (ip, ["from host", "ip", "address", "", ""], plain),
        "email": (email, ["mail", "contact", "write to", "", ""], plain),
        "secret": (secret, names, given),
    }
    bad = [
        (lambda: d(16), ["id", "serial", "order", "ref", "", "", ""], plain),
        (lambda: _luhn_number(rng, rng.choice("012789"), 16), ["id", "serial", "ref", "", ""], plain),
        (lambda: f"{d(rng.choice([15, 16]))} {d(rng.randint(5, 12))}", ["id", "", ""], plain),
        (lambda: grouped(d(16), rng.choice([" ", "-"])), ["serial", "item", "order", ""], plain),
        (lambda: ".".join(str(rng.randint(0, 40)) for _ in range(rng.randint(5, 7))), ["version", "section", "release", ""], plain),
        (lambda: ".".join(str(rng.randint(200, 999)) for _ in range(4)), ["build", "", "figure"], plain),
        (lambda: f"{rng.randint(1900, 2030)}-{d(2)}-{d(2)} {d(2)}:{d(2)}:{d(2)}", ["on", ""], plain),
        (lambda: f"{d(3)}-{d(3)}-{d(4)}-{d(rng.randint(2, 4))}", ["isbn", "item", "serial", ""], plain),
        (lambda: f"{d(rng.randint(2, 4))}{d(3)} {d(3)} {d(4)}{d(rng.randint(2, 5))}", ["figures", "build", ""], plain),
        (lambda: f"{d(20)}", ["invoice", "", "ref"], plain),
        (lambda: f"{word()} @ {word()}. {word()}", ["", "meet"], plain),
        (lambda: f"{word()} @{word()}", ["", "see"], plain),
        (lambda: f"+{d(1)} {d(2)} {d(2)} {d(3)}", ["rose by", "score", ""], plain),
        (lambda: ":".join(d(2) for _ in range(8)), ["serial", "mac", ""], plain),
        (lambda: f"{word()}::{word()}", ["", "call"], plain),
        (lambda: f"{d(2)}::{d(2)}", ["ratio", "slice", ""], plain),
        (lambda: f"00{d(3)} {d(3)} {d(2)} {d(2)}", ["item", "lot", ""], plain),
        (lambda: h(rng.choice([32, 40, 64])), hashes, [*plain, *given]),
        (lambda: "-".join(h(k) for k in (8, 4, 4, 4, 12)), ["uuid", "id", *names], given),
        (lambda: word() + word() + word(), [*names, "title", "name", "class"], given),
        (lambda: f"/{word()}/{word()}/{word()}.{word()}", ["path", "href", "key", "file"], given),
        (lambda: f"{word()}_{word()}_{word()}", ["sk", "pk", "name", "field", "key"], [*given, "{0}_{1}"]),
        (lambda: word() * 4, ["", "aaaa"], plain),
    ]
    out = []
    for _ in range(n):
        kinds = [rng.choice([*KINDS, "card", "phone", "secret"]) if rng.random() < 0.5 else "" for _ in range(rng.choice([1, 1, 2]))]
        text, spans = rng.choice([word(), word() + " " + word(), ""]), []
        for kind in kinds:
            make, leads, forms = good[kind] if kind else rng.choice(bad)
            lead, form, value = rng.choice(leads), rng.choice(forms), make()
            piece = form.format(lead, "\0").strip() if lead else "\0"
            text += " " if text else ""
            start = len(text) + piece.index("\0")
            text += piece.replace("\0", value)
            if kind:
                spans.append((KINDS.index(kind), start, start + len(value)))
        right = rng.choice([word() + ".", ", " + word(), "", word(), "."])
        out.append((text + (right if right[:1] in ("", ".", ",") else " " + right), spans))
    return out


def _proposed(seed: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """Candidates of invented texts: features, whether they are right, and the
    number of their text; and the texts."""
    spark = SparkSession.active()
    texts = invented(seed, n)
    made = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "n int, text string")
    # Bounded by n; sorted, so that a fit repeats exactly.
    rows = made.select("n", F.explode(candidates(F.col("text"))).alias("c")).select("n", "c.*").collect()
    rows = sorted(rows, key=lambda r: tuple(r))
    x = np.array([[float(r[f]) for f in FEATURES] for r in rows])
    y = np.array([(r.kind, r.start, r.end) in texts[r.n][1] for r in rows], dtype=float)
    return x, y, np.array([r.n for r in rows]), texts


def _scores(bias: float, trees: Sequence[Tree], x: np.ndarray) -> np.ndarray:
    return np.array([bias + sum(_value(t, dict(zip(FEATURES, v))) for t in trees) for v in x])


@lru_cache(maxsize=4)
def trained(seed: int = 5, precision: float = 0.97) -> Model:
    """Trees on half of the invented texts, thresholds on the other half: for
    each kind the lowest score at which, and at all higher ones, the share of
    right candidates is at least ``precision``; a kind that never reaches it is
    left to its base pattern."""
    x, y, n, _ = _proposed(seed, TRAIN_TEXTS)
    first = n % 2 == 0
    bias, trees, _ = boost(x[first], y[first])
    score, kind, right = _scores(bias, trees, x[~first]), x[~first, 0], y[~first]
    thresholds = []
    for k in range(len(KINDS)):
        own = kind == k
        order = np.argsort(-score[own], kind="stable")
        s, hits = score[own][order], np.cumsum(right[own][order])
        ends = np.append(s[1:] != s[:-1], True)  # equal scores stand or fall together
        short = np.flatnonzero(ends & (hits < precision * np.arange(1, len(s) + 1)))
        fine = np.flatnonzero(ends[: short[0]]) if len(short) else np.flatnonzero(ends)
        thresholds.append(float(s[fine[-1]]) if len(fine) else 1e9)
    return Model(bias, tuple(trees), tuple(thresholds))


def report(model: Model | None = None, seed: int = 99, n: int = 2_000) -> dict[str, tuple[float, float, int]]:
    """Precision, recall and number of items of each kind, on texts that the
    model has not seen: its decisions on candidates, against all items there."""
    model = model or trained()
    x, y, _, texts = _proposed(seed, n)
    taken = _scores(model.bias, model.trees, x) >= np.array(model.thresholds)[x[:, 0].astype(int)]
    items = np.bincount([k for _, spans in texts for k, _, _ in spans], minlength=len(KINDS))
    out = {}
    for i, k in enumerate(KINDS):
        own = (x[:, 0] == i) & taken
        out[k] = (float(y[own].mean()) if own.any() else 1.0, float(y[own].sum()) / max(int(items[i]), 1), int(items[i]))
    return out


def _value(tree: Tree, row: dict[str, float]) -> float:
    while tree.low is not None:
        tree = tree.low if row[tree.feature] <= tree.at else tree.high
    return tree.value


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """Per row: id, base and spans, both arrays of (start, kind, end), kind
    being a place in KINDS, ordered by start, then kind."""
    model = model or trained()
    text = F.col("text")
    rows = pick(docs, id=id_col, text=text_col).select("id", F.coalesce("text", F.lit("")).alias("text"))
    kind = "array<struct<start:int,kind:int,end:int>>"
    rows = rows.withColumn("may", text.rlike(r"[0-9@]|[(\[]at[)\]]|[=:] ?[\"']"))
    by_kind = base_spans(text)
    placed = lambda i: lambda x: F.struct(x["start"].alias("start"), F.lit(i).alias("kind"), x["end"].alias("end"))
    base = F.sort_array(F.concat(*(F.transform(by_kind[k], placed(i)) for i, k in enumerate(BASE_KINDS))))
    rows = rows.withColumn("base", F.when(F.col("may"), base).otherwise(F.array().cast(kind)))
    scored = F.transform(candidates(text), lambda c: F.struct((-model.score(c)).alias("minus"), c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))
    rows = rows.withColumn("scored", F.when(F.col("may"), scored).otherwise(F.array().cast("array<struct<minus:double,start:int,kind:int,end:int>>")))
    good = F.sort_array(F.filter("scored", lambda c: model.accepts(c["kind"], -c["minus"])))

    def take(kept: Column, c: Column) -> Column:
        clash = F.exists(kept, lambda k: (k["start"] < c["end"]) & (c["start"] < k["end"]))
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))))

    spans = F.sort_array(F.aggregate(good, F.col("base"), take))
    return rows.select(F.col("id").alias(id_col), "text", "base", spans.alias("spans"))


def counted(spans: Column, kind: str) -> Column:
    at = KINDS.index(kind)
    return F.size(F.filter(spans, lambda x: x["kind"] == at)).cast("long")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """Per row: id and the text with every span replaced by its kind in square
    brackets.  Spans that overlap (base ones may) are replaced as one; null text
    becomes empty, all other rows as ``find_personal_data`` has them."""
    found = find_personal_data(docs, id_col, text_col, model)
    names = F.array(*map(F.lit, KINDS))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(F.col("text"), acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0)))
        mark = F.when(x["start"] >= acc["at"], F.concat(gap, F.lit("["), F.element_at(names, x["kind"] + 1), F.lit("]"))).otherwise("")
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.concat(acc["out"], mark).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate("spans", zero, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    return found.select(id_col, done.alias(text_col))
