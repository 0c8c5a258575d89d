"""Toxicity by a linear-chain conditional random field over words, with two states: clean and toxic.

Labels are of documents, so token labels are made first: a word of a toxic document is labelled toxic if one of
its features (the word, its prefixes of ``PREFIXES`` letters) stands in so many more toxic than clean documents that the
smoothed log-odds reach ``LOG_ODDS``. The field (weights of features, state bias, four transitions) is then fitted to the
labelled chains by gradient steps on the penalised conditional likelihood, with forward-backward sums. A logistic curve
turns a document's aggregated marginals (their sum, largest and share) into its score; it is fitted on marginals that each half
of the sample gets from a field of the other half, while the final field learns from all of it.

Forward and backward messages are scans of 2x2 matrices over all words of a slice at once: chunks of ``CHUNK`` words are
multiplied side by side, the chunk ends follow one by one, and a document's first word resets the message. Cost is linear
in the words, whatever a document's length.

Learning reads at most ``SAMPLE`` labelled documents a class, those of the smallest hashes, whole. Their chains stay on the executors, as
blocks of numbers: each gradient step sends the weights out, sums feature counts a partition, and adds up one vector a partition on the
driver, which never sees a text. The three fields (two halves and all) take their steps together.

Defined results: null and texts without words get the score of a document without toxic words; without labels of both classes
every score is the share of label 1 (0 if there is no label); very long texts are whole chains; repeated rows give repeated rows;
empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import batched, distinct_words, slices, stored
from corvane.llm.quality import labelled_sample

SAMPLE = 1500
PREFIXES = (4, 5, 6)
LOG_ODDS = 1.5
#: Toxic documents in which a feature must stand to get a weight.
LEAST = 4
CHUNK = 128
#: Text bytes of a block of chains.
BLOCK_BYTES = 1 << 18
SPAN_LEVEL = 0.5
_STEPS, _PENALTY = 40, 1e-3


def features(word: str) -> list[str]:
    """The word as a whole, and its prefixes that are shorter."""
    return ["=" + word, *(word[:k] for k in PREFIXES if len(word) > k)] if word else []


def _scan(m: np.ndarray) -> np.ndarray:
    """Normalised row vectors v[t] = v[t-1] m[t] for matrices m (n, 4) as a b c d; v before the first is (1/2, 1/2)."""
    n = len(m)
    rows = -(-n // CHUNK)
    padded = np.tile(np.array([1.0, 0, 0, 1.0]), (rows * CHUNK, 1))
    padded[:n] = m
    padded = padded.reshape(rows, CHUNK, 4)
    a, b, c, d = (padded[:, 0, i].copy() for i in range(4))
    for t in range(1, CHUNK):
        e, f, g, h = (padded[:, t, i] for i in range(4))
        a, b, c, d = a * e + b * g, a * f + b * h, c * e + d * g, c * f + d * h
        scale = a + b + c + d
        a, b, c, d = a / scale, b / scale, c / scale, d / scale
    starts = np.empty((rows, 2))
    x, y = 0.5, 0.5
    for i, (p, q, r, s) in enumerate(zip(a.tolist(), b.tolist(), c.tolist(), d.tolist(), strict=True)):
        starts[i] = x, y
        x, y = x * p + y * r, x * q + y * s
        x, y = x / (x + y), y / (x + y)
    out = np.empty((rows, CHUNK, 2))
    x, y = starts[:, 0], starts[:, 1]
    for t in range(CHUNK):
        e, f, g, h = (padded[:, t, i] for i in range(4))
        x, y = x * e + y * g, x * f + y * h
        total = x + y
        x, y = x / total, y / total
        out[:, t, 0], out[:, t, 1] = x, y
    return out.reshape(-1, 2)[:n]


def forward_backward(emission: np.ndarray, first: np.ndarray, start: float, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of state 1, and of the four transitions into each word that isn't a first one.

    ``emission``: log-weight of state 1 against 0 for each word; ``first``: whether a chain begins there;
    ``start``: log-weight of beginning in state 1; ``move``: 2x2 log-weights.
    """
    n = len(emission)
    if not n:
        return np.zeros(0), np.zeros((0, 4))
    e = np.exp(np.clip(emission, -30, 30))
    t = np.exp(move)
    one, begin = np.ones(n), np.exp(start)
    m = np.column_stack([one * t[0, 0], e * t[0, 1], one * t[1, 0], e * t[1, 1]])
    m[first] = np.column_stack([one, begin * e, one, begin * e])[first]
    alpha = _scan(m)
    # beta[t] is the row vector beta[t+1] times the transposed matrix of word t+1.
    back = np.column_stack([one * t[0, 0], one * t[1, 0], e * t[0, 1], e * t[1, 1]])
    back[first] = 0.5
    shifted = np.vstack([back[1:], np.full((1, 4), 0.5)])
    beta = _scan(shifted[::-1])[::-1]
    both = alpha * beta
    marginal = both[:, 1] / both.sum(axis=1)
    left = np.vstack([[0.5, 0.5], alpha[:-1]])
    pair = np.column_stack([left[:, 0] * t[0, 0] * beta[:, 0], left[:, 0] * t[0, 1] * e * beta[:, 1], left[:, 1] * t[1, 0] * beta[:, 0], left[:, 1] * t[1, 1] * e * beta[:, 1]])
    pair /= pair.sum(axis=1, keepdims=True)
    pair[first] = 0
    return marginal, pair


class Field:
    """The fitted field and the curve over its document aggregates."""

    def __init__(self):
        self.weights: dict[str, float] = {}
        self.bias, self.start, self.move = -6.0, 0.0, np.zeros((2, 2))
        self.curve: np.ndarray | None = None
        self.share = 0.0

    def _emissions(self, words: list[str]) -> np.ndarray:
        get = self.weights.get
        return np.array([self.bias + sum(get(f, 0.0) for f in features(w)) if w else -30.0 for w in words])

    def marginals(self, texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Marginals of all words in order, the distinct words, their codes, and the rows' offsets."""
        words, codes, offsets = distinct_words(texts)
        first = np.zeros(len(codes), bool)
        first[offsets[:-1]] = True
        p, _ = forward_backward(self._emissions(words)[codes], first, self.start, self.move)
        return p, words, codes, offsets

    @staticmethod
    def aggregates(p: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A row for each document: sum, largest and share of its marginals, and its length."""
        total = np.add.reduceat(p, offsets[:-1])
        most = np.maximum.reduceat(p, offsets[:-1])
        n = np.diff(offsets)
        return np.column_stack([np.log1p(total), most, np.sqrt(total / n), np.log1p(n) / 5, np.log1p(total) ** 2, np.ones(len(n))])

    def score(self, texts: pa.Array) -> tuple[np.ndarray, tuple]:
        if not len(texts):
            return np.zeros(0), ()
        p, words, codes, offsets = self.marginals(texts)
        if self.curve is None:
            return np.full(len(texts), self.share), (p, words, codes, offsets)
        z = self.aggregates(p, offsets) @ self.curve
        return 1 / (1 + np.exp(-np.clip(z, -30, 30))), (p, words, codes, offsets)


def log_odds(toxic: dict[str, int], clean: dict[str, int], n1: int, n0: int) -> dict[str, float]:
    """The smoothed log-odds of the features that stand in ``LEAST`` toxic documents, from numbers of documents."""
    return {f: float(np.log((k + 0.5) / (n1 + 1)) - np.log((clean.get(f, 0) + 0.5) / (n0 + 1))) for f, k in toxic.items() if k >= LEAST}


def toxic_words(words: list[str], odds: dict[str, float]) -> np.ndarray:
    """Which words are labelled toxic where they stand in toxic documents."""
    return np.array([max((odds.get(f, -9.0) for f in features(w)), default=-9.0) >= LOG_ODDS for w in words], bool)


class Chains:
    """Documents as numbers: words' codes, document offsets and labels, and for a field its features of each word and its token labels."""

    def __init__(self, texts: pa.Array, y: np.ndarray, odds: list[dict[str, float]], places: list[dict[str, int]]):
        words, self.codes, self.offsets = distinct_words(texts)
        self.codes, self.y, self.n_words = self.codes.astype(np.int32), y, len(words)
        self.toxic = [toxic_words(words, o) for o in odds]
        self.pairs = []
        for place in places:
            found = np.array([(w, place[f]) for w, word in enumerate(words) for f in features(word) if f in place], np.int64).reshape(-1, 2)
            self.pairs.append((found[:, 0], found[:, 1]))

    def _first(self) -> np.ndarray:
        first = np.zeros(len(self.codes), bool)
        first[self.offsets[:-1]] = True
        return first

    def _messages(self, k: int, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows, columns = self.pairs[k]
        emission = np.bincount(rows, theta[:-6][columns], self.n_words) + theta[-6]
        first = self._first()
        return first, *forward_backward(emission[self.codes], first, theta[-5], theta[-4:].reshape(2, 2))

    def gradient(self, k: int, theta: np.ndarray) -> np.ndarray:
        """Of the log-likelihood of the token labels of field ``k`` under weights, bias, start and moves: labelled less expected counts."""
        first, p, pair = self._messages(k, theta)
        labels = self.toxic[k][self.codes] & np.repeat(self.y == 1, np.diff(self.offsets))
        off = np.bincount(self.codes, labels - p, self.n_words)
        before, later = np.concatenate([[False], labels[:-1]]), ~first
        seen = np.array([np.sum(a & b & later) for a in (~before, before) for b in (~labels, labels)], float)
        rows, columns = self.pairs[k]
        by_feature = np.bincount(columns, off[rows], len(theta) - 6)
        return np.concatenate([by_feature, [off.sum(), labels[first].sum() - p[first].sum()], seen - pair.sum(axis=0)])

    def aggregates(self, k: int, theta: np.ndarray) -> np.ndarray:
        return Field.aggregates(self._messages(k, theta)[1], self.offsets)


class _Ascent:
    """One field's weights, bias, start and moves, and the state of their steps."""

    def __init__(self, names: list[str], n_words: int):
        self.names, k = names, len(names)
        self.shrink = np.concatenate([np.full(k, _PENALTY * n_words / 100), np.zeros(6)])
        self.theta = np.concatenate([np.zeros(k), [-4.0, 0.0], np.zeros(4)])
        self.square, self.momentum = np.zeros(k + 6), np.zeros(k + 6)

    def step(self, i: int, gradient: np.ndarray) -> None:
        gradient = gradient - self.shrink * self.theta
        self.momentum = 0.9 * self.momentum + 0.1 * gradient
        self.square = 0.99 * self.square + 0.01 * gradient**2
        rate = 0.3 * min(1.0, 12 / i)
        self.theta = self.theta + rate * (self.momentum / (1 - 0.9**i)) / (np.sqrt(self.square / (1 - 0.99**i)) + 1e-8)

    def field(self) -> Field:
        out, k = Field(), len(self.names)
        out.weights = {f: float(v) for f, v in zip(self.names, self.theta[:k], strict=True) if abs(v) > 1e-3}
        out.bias, out.start, out.move = float(self.theta[k]), float(self.theta[k + 1]), self.theta[-4:].reshape(2, 2)
        return out


def _feature_counts(own: DataFrame) -> DataFrame:
    """(f, d00, d01, d10, d11): documents of each half and label that hold a feature which enough toxic ones hold."""

    def run(batches):
        for part in slices(batches, "_text"):
            words, codes, offsets = distinct_words(part.column("_text"))
            cells = part.column("_half").to_numpy() * 2 + part.column("_label").to_numpy()
            counts: Counter = Counter()
            for i, cell in enumerate(cells.tolist()):
                counts.update((f, cell) for f in {f for c in set(codes[offsets[i] : offsets[i + 1]].tolist()) for f in features(words[c])})
            rows = [(f, cell, n) for (f, cell), n in counts.items()]
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in rows], t) for j, t in enumerate((pa.string(), pa.int32(), pa.int64()))], ["f", "cell", "n"])

    found = batched(own).mapInArrow(run, "f string, cell int, n long")
    sums = found.groupBy("f").agg(*(F.sum(F.when(F.col("cell") == c, F.col("n")).otherwise(0)).alias(f"d{c >> 1}{c & 1}") for c in range(4)))
    return sums.where(f"d01 + d11 >= {LEAST}")


def _blocks(own: DataFrame, odds: list[dict[str, float]], places: list[dict[str, int]]) -> DataFrame:
    """(_half, _n, _chains): blocks of about ``BLOCK_BYTES`` of text, dealt out over the executors."""
    sent = own.sparkSession.sparkContext.broadcast((odds, places))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text", BLOCK_BYTES):
            half = part.column("_half").to_numpy()
            for h in (0, 1):
                mine = part.filter(pa.array(half == h))
                if mine.num_rows:
                    block = Chains(mine.column("_text"), mine.column("_label").to_numpy(), *sent.value)
                    yield pa.RecordBatch.from_arrays([pa.array([h], pa.int32()), pa.array([len(block.codes)], pa.int64()), pa.array([pickle.dumps(block)], pa.binary())], ["_half", "_n", "_chains"])

    return stored(batched(own).mapInArrow(run, "_half int, _n long, _chains binary"))


def _summed(blocks: DataFrame, thetas: list[np.ndarray]) -> list[np.ndarray]:
    """The gradients of the three fields: one of each half, one of all."""

    def run(batches):
        sums = [np.zeros(len(t)) for t in thetas]
        for batch in batches:
            for half, data in zip(batch.column("_half").to_pylist(), batch.column("_chains"), strict=True):
                block = pickle.loads(data.as_buffer())
                for k in (half, 2):
                    sums[k] += block.gradient(k, thetas[k])
        yield pa.RecordBatch.from_arrays([pa.array([0, 1, 2], pa.int32()), pa.array([x.tobytes() for x in sums], pa.binary())], ["k", "sum"])

    out = [np.zeros(len(t)) for t in thetas]
    for k, data in sorted(map(tuple, blocks.mapInArrow(run, "k int, sum binary").collect())):
        out[k] += np.frombuffer(data)
    return out


def _crossed(blocks: DataFrame, thetas: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Aggregates and labels of all documents, by the field of the half that they aren't in."""

    def run(batches):
        for batch in batches:
            for half, data in zip(batch.column("_half").to_pylist(), batch.column("_chains"), strict=True):
                block = pickle.loads(data.as_buffer())
                x = block.aggregates(1 - half, thetas[1 - half])
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), pa.array(block.y, pa.int32())], ["x", "y"])

    rows = blocks.mapInArrow(run, "x array<double>, y int").toArrow()
    x, y = np.array(rows.column("x").to_pylist(), float), np.array(rows.column("y").to_pylist(), int)
    order = np.lexsort([*x.T, y])  # sums don't depend on the order in which rows came
    return x[order], y[order]


def _newton(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    beta = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(beta))
        step = np.linalg.solve(hessian, x.T @ (y - p) - 0.05 * beta)
        beta += step * min(1.0, 3.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Field:
    """Learn from the rows of ``labels``, at most ``SAMPLE`` documents a class."""
    sample, odds = labelled_sample(docs, labels, label_col, SAMPLE, id_col, text_col)
    parts = max(1, min(64, docs.sparkSession.sparkContext.defaultParallelism))
    text = F.coalesce(text_col, F.lit(""))
    own = stored(sample.select(text.alias("_text"), "_label", (F.col("_place") % 2).cast("int").alias("_half")).repartition(parts, F.xxhash64("_text", "_label")))
    n = np.zeros((2, 2), int)
    for half, label, count in own.groupBy("_half", "_label").count().collect():
        n[half, label] = count
    if not n.all():
        field = Field()
        field.share = float(n[:, 1].sum() / max(n.sum(), 1))
        return field
    counts = _feature_counts(own).collect()
    all_odds = []
    for k in (0, 1, 2):
        toxic, clean = ({r["f"]: r[f"d{k}{y}"] if k < 2 else r[f"d0{y}"] + r[f"d1{y}"] for r in counts} for y in (1, 0))
        n0, n1 = n[k] if k < 2 else n.sum(axis=0)
        all_odds.append(log_odds(toxic, clean, int(n1), int(n0)))
    names = [sorted(f for f, v in o.items() if v > 0.5) for o in all_odds]
    blocks = _blocks(own, all_odds, [{f: i for i, f in enumerate(x)} for x in names])
    words = {r["_half"]: r["w"] for r in blocks.groupBy("_half").agg(F.sum("_n").alias("w")).collect()}
    fields = [_Ascent(x, w) for x, w in zip(names, (words[0], words[1], words[0] + words[1]), strict=True)]
    for i in range(1, _STEPS + 1):
        for f, gradient in zip(fields, _summed(blocks, [f.theta for f in fields]), strict=True):
            f.step(i, gradient)
    field = fields[2].field()
    x, y = _crossed(blocks, [f.theta for f in fields])
    field.curve = _newton(x, y)
    field.curve[-1] += odds - np.log(y.mean() / (1 - y.mean()))  # from the sample's class odds to those of all labels
    return field


def word_offsets(text: str) -> list[tuple[int, int]]:
    """Start and end, in code points, of the text's runs of letters and marks, which are its words."""
    import regex

    return [m.span() for m in regex.finditer(r"[\p{L}\p{M}]+", text)]


def score(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", with_spans: bool = False) -> DataFrame:
    """(id, score) for each row, and with ``with_spans`` also ``spans`` array<struct<start, end, score>>: the offsets in code points,
    the end exclusive, of the words whose marginal is at least ``SPAN_LEVEL``, with the marginal."""
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        own = sent.value
        for part in slices(batches, text_col):
            texts = part.column(text_col)
            value, (p, _, _, offsets) = own.score(texts)
            columns = {id_col: part.column(id_col), "score": pa.array(value, pa.float64())}
            if with_spans:
                hot = np.flatnonzero(p >= SPAN_LEVEL)
                row = np.searchsorted(offsets, hot, side="right") - 1
                spans: list[list[dict]] = [[] for _ in range(part.num_rows)]
                for r in np.unique(row).tolist():
                    at = word_offsets(texts[r].as_py())
                    for i in hot[row == r].tolist():
                        a, b = at[i - int(offsets[r])]
                        spans[r].append({"start": a, "end": b, "score": float(p[i])})
                columns["spans"] = pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    kind = docs.schema[id_col].dataType.simpleString()
    return batched(docs.select(id_col, text_col)).mapInArrow(run, f"`{id_col}` {kind}, score double" + ", spans array<struct<start:int,end:int,score:double>>" * with_spans)
