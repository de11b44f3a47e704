"""Personal data: base patterns, high-recall candidates, and boosted trees that choose among them; built-in functions only.

Every text is searched in its own row, so nothing is shuffled.  Base spans (e-mail, IP address, card, phone) always stand.
Generators propose further, overlapping spans: secrets, long numbers, account numbers.  Small regression trees, boosted
on format and context features, score them; a threshold per kind, set for a wanted precision, chooses.  The trees are fitted on all
candidates of the corpus, counted by feature pattern (the features are small integers, so the number of patterns is
bounded whatever the corpus), with labels from strong evidence: an overlap with a base span, or a fitting key word before
an assignment, against candidates with neither.

Positions are code points from 0, ends exclusive.  Loops over groups are possessive where that changes no match, since the
regular-expression engine would otherwise recurse once per repetition on very long runs.

Defined cases: a null or empty text has no spans; repeated rows and ties get the same spans each; without candidates, or
without labels of both kinds, only base spans are found; an empty table gives no rows; columns with clashing names are
kept apart, as only doc_id and text are read, and ``redact`` returns the columns it was given.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

KINDS = ("email", "ip", "card", "phone", "secret", "number", "account")
BASE_KINDS = 4
LOCAL = "[A-Za-z0-9._%+-]"
# A match begins at the start of a run, or where the last match ended (\G).
PATTERNS = (
    rf"(?:\G|(?<!{LOCAL})){LOCAL}+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
    r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]{0,60}[0-9])[A-Za-z0-9_+/=-]{16,}+",
    r"(?<![A-Za-z0-9])[0-9](?:[\x20./-]?[0-9]){6,}+(?![A-Za-z0-9])",
    r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
)
# Cheap necessary conditions, tried first.
GATES = (
    lambda t: t.contains("@"),
    lambda t: t.rlike(r"[0-9]\.[0-9]"),
    lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"),
    lambda t: t.contains("+"),
    lambda t: t.rlike(r"[A-Za-z0-9_+/=-]{16}"),
    lambda t: t.rlike(r"[0-9](?:[\x20./-]?[0-9]){6}"),
    lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"),
)
# Key words by what they announce.
KEY_WORDS = (
    r"(?i)token|secret|passw|pwd|api.?key|access.?key|credential|bearer|auth",
    r"(?i)phone|tel\b|mobile|call|fax|whatsapp",
    r"(?i)card|account|iban|ssn|social|passport|licen[cs]e no|tax id|konto|cuenta|compte",
)
CONTEXT = 32
FEATURES = ("kind", "digits", "letters", "variety", "separated", "word", "assigned", "quoted", "embedded", "luhn", "hex")
BLOCK = 64


def _row(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns behind a generator, so that the optimizer doesn't copy their expressions into every use."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in cols.items())))))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _valid(kind: Column, m: Column) -> Column:
    """The base kinds' checks on a match; a candidate needs none."""
    n = F.length(_digits(m))
    significant = lambda p: F.regexp_replace(p, "^0+", "")
    octet = lambda p: (F.length(significant(p)) <= 3) & (F.concat(F.lit("0"), F.substring(significant(p), 1, 3)).cast("int") <= 255)
    return (
        F.when(kind == 1, F.forall(F.split(m, r"\."), octet))
        .when(kind == 2, n.between(12, 19) & F.call_function("luhn_check", _digits(m)))
        .when(kind == 3, n.between(9, 15))
        .otherwise(F.lit(True))
    )


def _features(kind: Column, m: Column, left: Column, right: Column) -> dict[str, Column]:
    """Small integers only."""
    digits, letters = F.length(_digits(m)), F.length(F.regexp_replace(m, "[^A-Za-z]", ""))
    edge, flag = F.trim(left), lambda c: c.cast("int")
    word = F.lit(0)
    for i, pattern in enumerate(KEY_WORDS):
        word = F.when(left.rlike(pattern), i + 1).otherwise(word)
    return {
        "kind": kind,
        "digits": F.least(digits, F.lit(21)),
        "letters": F.least(letters, F.lit(12)),
        "variety": F.least(F.size(F.array_distinct(F.split(m, ""))), F.lit(16)),
        "separated": flag(m.rlike(r"[\x20./-]")),
        "word": word,
        "assigned": flag(edge.rlike("[=:#\"'(]$")),
        "quoted": flag(right.rlike("^[\"')]")),
        "embedded": flag(left.rlike(r"[\p{L}\p{N}]$") | right.rlike(r"^[\p{L}\p{N}]")),
        "luhn": flag(digits.between(12, 19) & F.call_function("luhn_check", _digits(m))),
        "hex": flag(m.rlike("^[0-9a-fA-F]+$")),
    }


def with_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with base: array<struct<start, kind, stop>> and extra: the same with the features, both by start, kind."""
    t = F.coalesce(F.col(text), F.lit(""))
    runs = []
    for k, (pattern, gate) in enumerate(zip(PATTERNS, GATES, strict=True)):
        some = F.struct(F.split(t, pattern, -1).alias("parts"), F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("found"))
        runs.append(F.struct(F.lit(k).alias("kind"), F.when(gate(t), some).alias("some")))
    df = _row(docs, __runs=F.filter(F.array(*runs), lambda r: r.some.isNotNull()))

    def located(r: Column) -> Column:
        zipped = F.arrays_zip(r.some.parts.alias("gap"), F.slice(r.some.parts, 2, F.size(r.some.parts)).alias("after"), r.some.found.alias("m"))
        rows = F.transform(
            F.filter(zipped, lambda z: z.m.isNotNull()),
            lambda z: F.struct(
                F.length(z.gap).alias("gap"), F.length(z.m).alias("len"), z.m.alias("m"),
                F.right(z.gap, F.lit(CONTEXT)).alias("left"), F.left(z.after, F.lit(1)).alias("right"),
            ),
        )
        return F.struct(r.kind.alias("kind"), rows.alias("rows"))

    df = _row(df, __rows=F.filter(F.transform("__runs", located), lambda r: F.size(r.rows) > 0))
    # Prefix sums in blocks: what lies before a match is the sum over earlier blocks and over its own block.
    add = lambda a, x: a + x.gap + x.len
    sums = lambda r: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(r.rows) - 1) / BLOCK).cast("int")),
        lambda b: F.aggregate(F.slice(r.rows, b * BLOCK + 1, F.lit(BLOCK)), F.lit(0), add),
    )
    df = _row(df, __sums=F.transform("__rows", lambda r: F.struct(r.kind.alias("kind"), r.rows.alias("rows"), sums(r).alias("sums"))))

    def placed(r: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            block = F.floor(i / BLOCK).cast("int")
            before = F.aggregate(F.slice(r.sums, F.lit(1), block), F.lit(0), lambda a, v: a + v)
            own = F.aggregate(F.slice(r.rows, block * BLOCK + 1, i - block * BLOCK), F.lit(0), add)
            start = before + own + x.gap
            return F.struct(start.alias("start"), r.kind.alias("kind"), (start + x.len).alias("stop"), x.m.alias("m"), x.left.alias("left"), x.right.alias("right"))

        return F.transform(r.rows, one)

    df = _row(df, __all=F.filter(F.flatten(F.transform("__sums", placed)), lambda s: _valid(s.kind, s.m)))
    bare = lambda s: F.struct(s.start.alias("start"), s.kind.alias("kind"), s.stop.alias("stop"))
    df = _row(df, __base=F.array_sort(F.transform(F.filter("__all", lambda s: s.kind < BASE_KINDS), bare)))

    def described(s: Column) -> Column:
        meets = F.exists("__base", lambda b: (b.start < s.stop) & (s.start < b.stop))
        return F.struct(
            s.start.alias("start"), s.kind.alias("at"), s.stop.alias("stop"), meets.alias("meets"),
            *(c.alias(n) for n, c in _features(s.kind, s.m, s.left, s.right).items()),
        )

    df = _row(df, __extra=F.array_sort(F.transform(F.filter("__all", lambda s: s.kind >= BASE_KINDS), described)))
    return df.drop("__runs", "__rows", "__sums", "__all")


# ---- boosted trees -----------------------------------------------------------------------------------------------


@dataclass
class Leaf:
    value: float


@dataclass
class Split:
    feature: str
    at: int
    low: Leaf | Split
    high: Leaf | Split


@dataclass
class Selector:
    """Trees whose sum is a log-odds, and the least log-odds that each kind needs."""

    trees: list[Leaf | Split]
    least: dict[int, float]

    def score(self, s: Column) -> Column:
        def value(t: Leaf | Split) -> Column:
            if isinstance(t, Leaf):
                return F.lit(t.value)
            return F.when(s[t.feature] <= t.at, value(t.low)).otherwise(value(t.high))

        total = F.lit(0.0)
        for t in self.trees:
            total = total + value(t)
        return total

    def chooses(self, s: Column) -> Column:
        """A candidate beyond the base spans that is to be redacted."""
        need = F.lit(math.inf)
        for kind, least in self.least.items():
            need = F.when(s["at"] == kind, F.lit(least)).otherwise(need)
        return ~s["meets"] & (self.score(s) >= need)


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rows: np.ndarray) -> Leaf | Split:
    """One regression tree by second-order gain with a unit ridge; g and h are summed per pattern."""
    gain_of = lambda a, b: a * a / (b + 1.0)
    whole, best = gain_of(g[rows].sum(), h[rows].sum()), (1e-6, 0, 0)
    if depth:
        for j in range(x.shape[1]):
            for at in np.unique(x[rows, j])[:-1]:
                low = rows & (x[:, j] <= at)
                high = rows & ~low
                gain = gain_of(g[low].sum(), h[low].sum()) + gain_of(g[high].sum(), h[high].sum()) - whole
                if gain > best[0]:
                    best = (gain, j, int(at))
    if best[0] <= 1e-6 or not depth:
        return Leaf(float(0.3 * g[rows].sum() / (h[rows].sum() + 1.0)))
    low = rows & (x[:, best[1]] <= best[2])
    return Split(FEATURES[best[1]], best[2], _grow(x, g, h, depth - 1, low), _grow(x, g, h, depth - 1, rows & ~low))


def _apply(t: Leaf | Split, x: np.ndarray) -> np.ndarray:
    if isinstance(t, Leaf):
        return np.full(len(x), t.value)
    return np.where(x[:, FEATURES.index(t.feature)] <= t.at, _apply(t.low, x), _apply(t.high, x))


def boost(x: np.ndarray, positive: np.ndarray, negative: np.ndarray, rounds: int = 40, depth: int = 3, precision: float = 0.95) -> Selector:
    """Fit on patterns ``x`` with counts of both labels; per kind, the lowest threshold that keeps ``precision``."""
    if not positive.sum() or not negative.sum():
        return Selector([], {})
    # Frequent patterns count by the root of their number: one boilerplate line must not outvote all others.
    p, n = np.sqrt(positive), np.sqrt(negative)
    z, trees, every = np.zeros(len(x)), [], np.ones(len(x), bool)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-z))
        tree = _grow(x, p * (1 - q) - n * q, (p + n) * q * (1 - q), depth, every)
        trees.append(tree)
        z = z + _apply(tree, x)
    least = {}
    for kind in np.unique(x[:, 0]):
        own = np.flatnonzero(x[:, 0] == kind)
        own = own[np.argsort(-z[own], kind="stable")]
        hits, all_ = np.cumsum(positive[own]), np.cumsum(positive[own] + negative[own])
        last = np.append(z[own][1:] < z[own][:-1], True)  # equal scores stand or fall together
        good = last & (all_ > 0) & (hits >= precision * all_) & (z[own] > 0)
        if good.any():
            least[int(kind)] = float(z[own][np.flatnonzero(good)[-1]]) - 1e-9
    return Selector(trees, least)


def train(docs: DataFrame, **how) -> Selector:
    """Fit on the candidates of all documents, counted by pattern."""
    s = F.col("s")
    fits = ((s["at"] == 4) & (s["word"] == 1)) | ((s["at"] == 5) & (s["word"] > 1)) | ((s["at"] == 6) & (s["word"] == 3))
    strong = s["meets"] | (fits & (s["assigned"] == 1))
    weak = ~s["meets"] & (s["word"] == 0)
    rows = (
        with_spans(docs.select("text"))
        .select(F.explode("__extra").alias("s"))
        .groupBy(*(s[f].alias(f) for f in FEATURES))
        .agg(F.count_if(strong).alias("positive"), F.count_if(weak & ~strong).alias("negative"))
        .filter("positive + negative > 0")
        .orderBy(*FEATURES)
        .collect()
    )
    x = np.array([[r[f] for f in FEATURES] for r in rows], np.int64).reshape(-1, len(FEATURES))
    return boost(x, *(np.array([r[c] for r in rows], float) for c in ("positive", "negative")), **how)


# ---- results -----------------------------------------------------------------------------------------------------


def detect(docs: DataFrame, selector: Selector) -> DataFrame:
    """``docs`` with base and spans: array<struct<start, kind, stop>>; spans hold the base ones and the chosen ones."""
    df = with_spans(docs)
    bare = lambda s: F.struct(s["start"].alias("start"), s["at"].alias("kind"), s["stop"].alias("stop"))
    chosen = F.transform(F.filter("__extra", selector.chooses), bare)
    return _row(df, __spans=F.array_sort(F.concat("__base", chosen))).drop("__extra")


def count_of(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def listed(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")


def redact(docs: DataFrame, selector: Selector) -> DataFrame:
    """``docs`` with every span of text replaced by its kind in brackets; overlapping spans become one mark."""
    found = detect(docs, selector)
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def take(a: Column, s: Column) -> Column:
        more = F.concat(a["out"], F.substring(F.col("text"), a["pos"] + 1, s["start"] - a["pos"]), F.get(names, s["kind"]))
        return F.struct(
            F.greatest(a["pos"], s["stop"]).alias("pos"),
            F.when(s["start"] >= a["pos"], more).otherwise(a["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    whole = F.aggregate("__spans", start, take, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["pos"] + 1, F.length("text"))))
    return found.select(*(F.when(F.size("__spans") > 0, whole).otherwise(F.col("text")).alias("text") if c == "text" else F.col(c) for c in docs.columns))
