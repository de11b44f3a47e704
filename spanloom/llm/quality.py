"""Quality classifier by positive-unlabelled learning.

Trusted positives are the documents labelled 1 in the training folds; unlabelled text is a sample of the whole table.
An additive model over binned text statistics minimises the non-negative unbiased risk

    prior * mean(loss(+, positives)) + max(0, mean(loss(-, unlabelled)) - prior * mean(loss(-, positives)))

with the logistic loss.  The class prior is the share of label 1 among the labelled training rows if these hold both
labels.  Else it is estimated from positives and unlabelled text alone: a plain positive-against-unlabelled fit ranks the
texts, and the smallest ratio of the two groups' upper tails bounds the share of positives among the unlabelled.  Scores
are calibrated by the prior: 0.7 lies where the unlabelled texts divide in its proportion, but below 199 of 200 trusted
positives.

Defined cases: a null or empty text is scored by the same model, as a text without words; a document whose labels
disagree is no trusted positive; labels for missing documents are ignored; without any positives every score is the
prior, 0.5; null doc_id is never labelled nor held out; repeated rows are scored each, but drawn for the fit once; an empty table gives no rows;
columns other than doc_id and text are not read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from .tokens import slices
from .wordhash import hash_words, text_bytes, word_bounds

# Where the statistics are cut: evenly in the middle, finely in both tails, where rare kinds of text lie.
QUANTILES = (0.01, 0.03, 0.06, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.94, 0.97, 0.99)
BINS = len(QUANTILES)
CUT = 0.7
MAX_POSITIVES = 20_000
MAX_UNLABELLED = 20_000
_CLASSES = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "stop": b".,;:?'\"-()",
    "symbol": b"!#$%&*+/<=>@[\\]^_`{|}~",
    "line": b"\n\r",
}


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def features(texts: pa.Array) -> np.ndarray:
    """One row of statistics per text; shares are of its bytes or words."""
    data, ends = text_bytes(texts)
    n, size = len(ends) - 1, np.diff(ends).astype(float)
    cols = []
    for members in _CLASSES.values():
        table = np.zeros(256, np.int64)
        table[list(members)] = 1
        run = np.concatenate([[0], np.cumsum(table[data])])
        cols.append((run[ends[1:]] - run[ends[:-1]]) / np.maximum(size, 1))
    first, stops, at = word_bounds(data, ends)
    words, length = hash_words(data, first, stops), (stops - first).astype(float)
    count = np.diff(at).astype(float)

    def share(values: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0.0], np.cumsum(values)])
        return (run[at[1:]] - run[at[:-1]]) / np.maximum(count, 1)

    same = np.zeros(len(words))
    same[1:] = words[1:] == words[:-1]
    same[at[:-1][at[:-1] < len(words)]] = 0  # a text's first word follows nothing
    distinct = np.array([len(np.unique(words[a:b])) for a, b in zip(at[:-1], at[1:], strict=True)], float)
    cols += [
        share(length), share(length**2), share((length <= 3).astype(float)), share(same),
        distinct / np.maximum(count, 1), distinct / np.sqrt(np.maximum(count, 1)), np.log1p(count), np.log1p(size),
    ]
    return np.stack(cols, axis=1) if n else np.empty((0, len(cols)))


@dataclass
class Model:
    """Cut points per statistic, one weight per bin, and the estimated class prior."""

    edges: list[np.ndarray]
    weights: np.ndarray
    prior: float

    def design(self, x: np.ndarray) -> np.ndarray:
        """Bin numbers, one column per statistic, offset so that they index ``weights``."""
        return np.stack([np.searchsorted(e, x[:, j], side="right") + j * (BINS + 1) for j, e in enumerate(self.edges)], axis=1)

    def logit(self, x: np.ndarray) -> np.ndarray:
        if not self.edges:
            return np.full(len(x), np.log(self.prior / (1 - self.prior)))
        return self.weights[self.design(x)].sum(axis=1) + self.weights[-1]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def _descend(model: Model, gradient_of, steps: int, ridge: float) -> None:
    """Adam on the bin weights; ``gradient_of(weights)`` returns the gradient."""
    w = model.weights
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = gradient_of(w) + ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)


def _push(model: Model, rows: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Gradient of the weights from the gradients of the rows' logits."""
    g = np.bincount(rows.ravel(), np.repeat(values, rows.shape[1]), len(model.weights))
    g[-1] = values.sum()
    return g


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Smallest ratio of upper tails, among cuts that keep at least four fifths of the positives."""
    cuts = np.quantile(positive, np.linspace(0.0, 0.2, 41))
    p = (np.sort(positive), len(positive))
    u = (np.sort(unlabelled), len(unlabelled))
    tail = lambda g: 1 - np.searchsorted(g[0], cuts, side="left") / g[1]
    return float(np.clip((tail(u) / tail(p)).min(), 0.02, 0.98))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, steps: int = 400, ridge: float = 1e-3) -> Model:
    if not len(positive) or not len(unlabelled):
        return Model([], np.zeros(1), 0.5)
    both = np.concatenate([positive, unlabelled])
    edges = [np.unique(np.quantile(both[:, j], QUANTILES)) for j in range(both.shape[1])]
    size = len(edges) * (BINS + 1) + 1
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    logits = lambda w, rows: w[rows].sum(axis=1) + w[-1]
    if prior is None:  # fitted on one half, estimated on the other
        first = Model(edges, np.zeros(size), 0.5)
        p, u = first.design(positive[::2]), first.design(unlabelled[::2])

        def plain(w):
            return _push(first, p, (sigmoid(logits(w, p)) - 1) / len(p)) + _push(first, u, sigmoid(logits(w, u)) / len(u))

        _descend(first, plain, steps, ridge)
        prior = estimate_prior(first.logit(positive[-1::-2]), first.logit(unlabelled[-1::-2]))

    model = Model(edges, np.zeros(size), prior)
    p, u = model.design(positive), model.design(unlabelled)

    def risk(w):
        zp, zu = logits(w, p), logits(w, u)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        up = _push(model, u, sigmoid(zu) / len(u)) - prior * _push(model, p, sigmoid(zp) / len(p))
        if negative < 0:  # the estimate went below zero: step back from it
            return -up
        return prior * _push(model, p, (sigmoid(zp) - 1) / len(p)) + up

    _descend(model, risk, steps, ridge)
    w = model.weights
    cut = min(np.quantile(logits(w, u), 1 - prior), np.quantile(logits(w, p), 0.005))
    w[-1] += np.log(CUT / (1 - CUT)) - cut
    return model


# ---- Spark -------------------------------------------------------------------------------------------------------


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        x = features(b.column("text"))
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([b.column("positive"), b.column("sampled"), flat], names=["positive", "sampled", "x"])


def sample(docs: DataFrame, labels: DataFrame, max_positives: int = MAX_POSITIVES, max_unlabelled: int = MAX_UNLABELLED) -> tuple[DataFrame, float | None]:
    """(text, positive, sampled of the rows to fit on; the share of label 1, if the training folds hold both labels).

    Rows are drawn by hash of doc_id and text together, and of rows equal in both one is drawn, so an id or a row that
    many rows share takes no more of the sample than its due.
    """
    agreed = (
        labels.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("hi"))
        .filter("quality = hi")
    )
    trusted = agreed.filter("quality = 1").select("doc_id")
    n, n_trusted = agreed.agg(F.count(F.lit(1)), F.count_if(F.col("quality") == 1)).first()
    prior = n_trusted / n if 0 < n_trusted < n else None
    portion = lambda most, of: int(min(1.0, most / max(of, 1)) * (1 << 30))
    drawn = lambda label, most, of, *by: F.pmod(F.xxhash64(F.lit(label), *by), F.lit(1 << 30)) < portion(most, of)
    chosen = trusted.filter(drawn("sample", max_positives, n_trusted, "doc_id")).withColumn("positive", F.lit(True))
    # ``chosen`` is bounded by max_positives (the sample's size varies by a few per cent), so it may be broadcast.
    marked = lambda *columns: docs.select(*columns).join(F.broadcast(chosen), "doc_id", "left")
    # An id may stand on many rows: rows are counted, too.
    rows, on_chosen = marked("doc_id").agg(F.count(F.lit(1)), F.count("positive")).first()
    texts = marked("doc_id", "text").select(
        "doc_id",
        "text",
        (F.coalesce("positive", F.lit(False)) & drawn("rows", max_positives, on_chosen, "doc_id", "text")).alias("positive"),
        drawn("texts", max_unlabelled, rows, "doc_id", "text").alias("sampled"),
    )
    kept = texts.filter("positive or sampled").withColumn("print", F.xxhash64("text")).dropDuplicates(["doc_id", "print"])
    return kept.select("text", "positive", "sampled"), prior


def train(docs: DataFrame, labels: DataFrame, max_positives: int = MAX_POSITIVES, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    """Fit on at most about ``max_positives`` rows of trusted positives and ``max_unlabelled`` other texts."""
    texts, prior = sample(docs, labels, max_positives, max_unlabelled)
    rows = texts.mapInArrow(_describe, "positive boolean, sampled boolean, x array<double>").toArrow()
    if not rows.num_rows:
        return fit(np.empty((0, 1)), np.empty((0, 1)))
    x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
    return fit(x[rows.column("positive").to_numpy()], x[rows.column("sampled").to_numpy()], prior)


def _scores(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            kept = [c for c in b.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(model.score(features(b.column("text"))))], names=[*kept, "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score of every row."""
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(_scores(model), "doc_id long, held_out boolean, score double")


def _keep(model: Model, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield b.filter(pc.greater_equal(pa.array(model.score(features(b.column("text")))), least))

    return run


def keep_good(docs: DataFrame, model: Model, least: float = CUT) -> DataFrame:
    """The rows that score at least ``least``, all columns kept."""
    return docs.mapInArrow(_keep(model, least), docs.schema)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
