"""Quality scores by regularised quadratic discriminant analysis over statistics of whole texts.

Each text becomes ``len(FEATURES)`` numbers: counts of bytes by class, words, repeats and lines, transformed to be
closer to normal (logarithms of sizes, square roots of shares) and standardised. A class's covariance is shrunk towards
the pooled one (``POOL``) and that towards its diagonal (``RIDGE``); both Cholesky factors are kept, so a score needs
two triangular solves. The log-density difference becomes a probability by a logistic curve that is fitted on the
sample, its offset then moved from the sample's class odds to those of all labels.

Learning reads at most ``SAMPLE`` labelled rows a class, those of the smallest hashes.

Defined results: null texts count as empty, and empty texts get a score as any other; without two learned classes the
score is the share of label 1 (0.5 if there is no label); very long texts are counted whole; repeated rows give repeated rows; empty tables give empty
results; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import batched, bounded_sample, slices, text_bytes

SAMPLE = 4000
POOL, RIDGE = 0.2, 0.05

FEATURES = (
    "log_bytes", "log_words", "mean_word", "upper", "digit", "punctuation", "symbol", "blank", "line_end", "exclamation",
    "bar", "high_byte", "distinct_words", "distinct_lines", "log_mean_line", "capital_words", "long_run", "vowel_like",
)

_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91] = 1
_CLASS[97:123] = 2
_CLASS[48:58] = 3
_CLASS[[33]] = 4
_CLASS[[124]] = 5
_CLASS[list(b".,;:?'\"()-")] = 6
_CLASS[list(b"#$%&*+/<=>@[\\]^_`{}~")] = 7
_CLASS[[9, 11, 12, 13, 32]] = 8
_CLASS[10] = 9
_CLASS[128:] = 10
_VOWEL = np.isin(np.arange(256), list(b"aeiouAEIOU"))


def statistics(texts: pa.Array) -> np.ndarray:
    """Transformed statistics, a row for each text."""
    data, offsets = text_bytes(texts)
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(offsets))
    kinds = np.bincount(row * 11 + _CLASS[data], minlength=n * 11).reshape(n, 11).astype(float)
    vowels = np.bincount(row[_VOWEL[data]], minlength=n)
    size = np.diff(offsets).astype(float)
    words, distinct, lines, distinct_lines, capitals, longest = (np.zeros(n) for _ in range(6))
    for i, text in enumerate(texts.to_pylist()):
        if not text:
            continue
        own = text.split()
        words[i], distinct[i] = len(own), len(set(own))
        rows = text.split("\n")
        lines[i], distinct_lines[i] = len(rows), len(set(rows))
        capitals[i] = sum(map(str.isupper, own))
        longest[i] = max(map(len, own), default=0)
    some = np.maximum(size, 1)
    letters = np.maximum(kinds[:, 1] + kinds[:, 2], 1)
    share = lambda x, of=some: np.sqrt(x / of)
    return np.column_stack([
        np.log1p(size), np.log1p(words), np.log1p(size / np.maximum(words, 1)), share(kinds[:, 1]), share(kinds[:, 3]),
        share(kinds[:, 6]), share(kinds[:, 7]), share(kinds[:, 8]), share(kinds[:, 9]), share(kinds[:, 4]), share(kinds[:, 5]),
        share(kinds[:, 10]), share(distinct, np.maximum(words, 1)), share(distinct_lines, np.maximum(lines, 1)),
        np.log1p(size / np.maximum(lines, 1)), share(capitals, np.maximum(words, 1)), np.log1p(longest), share(vowels, letters),
    ])


class Discriminant:
    """Two shrunk normal densities with cached Cholesky factors, and the logistic curve over their difference."""

    def __init__(self, x: np.ndarray, y: np.ndarray, odds: float | None = None):
        self.prior = float(y.mean()) if len(y) else 0.5
        self.ready = len(np.unique(y)) == 2 and min(np.bincount(y)) >= 2
        if not self.ready:
            return
        self.centre, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
        z = (x - self.centre) / self.scale
        parts = [z[y == k] for k in (0, 1)]
        self.means = [p.mean(axis=0) for p in parts]
        spreads = [np.cov(p, rowvar=False, bias=True) for p in parts]
        pooled = sum(len(p) * s for p, s in zip(parts, spreads, strict=True)) / len(z)
        self.factors = []
        for spread in spreads:
            shrunk = (1 - POOL) * spread + POOL * pooled
            shrunk = (1 - RIDGE) * shrunk + RIDGE * np.diag(np.diag(shrunk) + 0.05)
            self.factors.append(np.linalg.cholesky(shrunk))
        self.half_logs = [np.log(np.diag(f)).sum() for f in self.factors]
        # Of a few columns, so the triangular factors' inverses are cached too, and scoring is a product.
        self.inverses = [np.linalg.inv(f) for f in self.factors]
        slope, offset = _logistic(_squash(self._difference(x)), y)
        own = math.log(y.mean() / (1 - y.mean()))
        self.curve = slope, offset + ((own if odds is None else odds) - own)

    def _difference(self, x: np.ndarray) -> np.ndarray:
        """Log-density of class 1 minus that of class 0."""
        z = (x - self.centre) / self.scale
        log = []
        for mean, inverse, half in zip(self.means, self.inverses, self.half_logs, strict=True):
            log.append(-0.5 * (((z - mean) @ inverse.T) ** 2).sum(axis=1) - half)
        return log[1] - log[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.ready:
            return np.full(len(x), self.prior)
        slope, offset = self.curve
        return 1 / (1 + np.exp(-(slope * _squash(self._difference(x)) + offset)))


def _squash(x: np.ndarray) -> np.ndarray:
    """Keeps order, tames far tails."""
    return np.sign(x) * np.log1p(np.abs(x))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by damped Newton steps with a small ridge."""
    design, beta = np.column_stack([x, np.ones(len(x))]), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (y - p) - 1e-2 * beta
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta = beta + step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return max(float(beta[0]), 1e-3), float(beta[1])


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, most: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, float]:
    """(text, _label, _place) of at most ``most`` labelled documents a class, with their places in it, and the log-odds of label 1
    among all labels (0 unless both occur); labels other than 0 and 1 are left out.

    The labels are cut to the bound before they meet the texts, so the side that is broadcast never grows.
    """
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(id_col, F.col(label_col).cast("int").alias("_label"))
    counts = {r["_label"]: r["count"] for r in usable.groupBy("_label").count().collect()}
    odds = math.log(counts[1] / counts[0]) if len(counts) == 2 else 0.0
    chosen = bounded_sample(usable, "_label", most, id_col, rank="_place")
    return docs.select(id_col, text_col).join(F.broadcast(chosen), id_col).select(text_col, "_label", "_place"), odds


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Discriminant:
    """Learn from the rows of ``labels``; the statistics are taken on the executors."""
    sample, odds = labelled_sample(docs, labels, label_col, SAMPLE, id_col, text_col)

    def run(batches):
        for part in slices(batches, text_col):
            x = statistics(part.column(text_col))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([flat, part.column("_label")], ["x", "_label"])

    rows = batched(sample).mapInArrow(run, "x array<double>, _label int").toArrow()
    x = np.array(rows.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    y = np.array(rows.column("_label").to_pylist(), int)
    order = np.lexsort([*x.T, y])  # sums don't depend on the order in which rows came
    return Discriminant(x[order], y[order], odds)


def score(docs: DataFrame, model: Discriminant, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for each row: the higher, the likelier label 1."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = sent.value
        for part in slices(batches, text_col):
            yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(own.score(statistics(part.column(text_col))))], [id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return batched(docs.select(id_col, text_col)).mapInArrow(run, f"`{id_col}` {kind}, score double")
