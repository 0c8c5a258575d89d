"""Language identification by interpolated Kneser-Ney character models.

Each language has a model of orders 1 to ``ORDER`` over the characters of lower-case words, a word standing
between two boundary marks that no context crosses. The highest order and n-grams that begin a word keep raw
counts, lower orders count distinct left neighbours, every order has the discount n1 / (n1 + 2 n2). The models are
merged to one table an order: a sorted array of 64-bit n-gram hashes with, for each language, the interpolated
log-probability and the weight of the n-gram as a context. A text's cross-entropy is the mean over its
characters and word ends; distinct words of a slice are scored once.

The language of the lowest cross-entropy wins. ``score`` is its softmax over minus the cross-entropies at a
temperature fitted on ``CALIBRATION`` of the sampled documents, which the counts leave out. A text is rejected
if it has no letter, or if its cross-entropy is above the winner's mean by more than ``SLACK`` times the excess that
a share of ``QUANTILE`` of the language's calibration documents stays below (more for texts of few characters). Only
documents that the models assign to their own label count, so that wrong labels and garbled rows don't set the limit;
without any calibration document there is no limit.

Learning reads at most ``SAMPLE`` documents a language, those of the smallest hashes, and no more of them than come to
``SAMPLE_BYTES``; all are read whole.

Defined results: texts that are null or without letters, and all texts if nothing was learned, get ``und`` and
score 0; of equal cross-entropies the language first in the alphabet wins; very long texts are scored whole, by their distinct words;
repeated rows give repeated rows; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import batched, bounded_sample, distinct_words, mix, row_sums, slices

ORDER = 5
SAMPLE, SAMPLE_BYTES = 600, 16 << 20
CALIBRATION = 0.2
SLACK = 1.5
QUANTILE = 0.95
#: Nats a symbol above the mean below which no text of 200 symbols or more is rejected: mixtures of two
#: learned languages stay, other scripts and random letters go.
LEAST_EXCESS = 1.5
#: Characters that share the uniform distribution below order 1.
ALPHABET = 4096
UNKNOWN = "und"

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BOUNDARY = 10


def _grams(words: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For a line of words between boundary marks: hashes of the k-gram that ends at each place for k from 0
    to ``ORDER``, the longest k that stays within the word, and the word's number (its closing mark included)."""
    text = np.frombuffer(("\n" + "\n".join(words) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(text)
    mark = text == _BOUNDARY
    at = np.arange(n)
    last = np.maximum.accumulate(np.where(mark, at, 0))
    before = np.concatenate([[0], last[:-1]])
    longest = np.minimum(at - before + 1, ORDER)
    longest[0] = 0
    code = mix(text.astype(np.uint64) + np.uint64(1))
    hashes, rolling, power = [np.zeros(n, np.uint64)], np.zeros(n, np.uint64), np.uint64(1)
    for k in range(1, ORDER + 1):
        moved = np.zeros(n, np.uint64)
        moved[k - 1 :] = code[: max(n - k + 1, 0)]
        with np.errstate(over="ignore"):
            rolling = rolling + moved * power
            power = power * _BASE
        hashes.append(mix(rolling + np.uint64(k)))
    return hashes, longest, np.maximum(np.cumsum(mark) - 1 - mark, 0)


def train(words: list[str], counts: np.ndarray) -> list[dict[str, np.ndarray]]:
    """One language's tables, an order each: hash, context, suffix, p, and for contexts weight."""
    hashes, longest, number = _grams(words)
    weight = np.asarray(counts, np.float64)[number]
    context_of = [np.concatenate([np.zeros(1, np.uint64), h[:-1]]) for h in hashes]
    raw: list[dict[str, np.ndarray]] = [{}]
    tables = []
    for k in range(1, ORDER + 1):
        use = longest >= k
        h, first, inverse = np.unique(hashes[k][use], return_index=True, return_inverse=True)
        raw.append({
            "hash": h,
            "context": context_of[k - 1][use][first],
            "suffix": hashes[k - 1][use][first],
            "count": np.bincount(inverse, weight[use], len(h)),
        })
    for k in range(1, ORDER):
        # Continuation counts: distinct one-longer n-grams with this suffix; none if it begins a word.
        got, n = np.unique(raw[k + 1]["suffix"], return_counts=True)
        spread = np.zeros(len(raw[k]["hash"]))
        place = np.searchsorted(got, raw[k]["hash"])
        hit = (place < len(got)) & (got[np.minimum(place, len(got) - 1)] == raw[k]["hash"])
        spread[hit] = n[place[hit]]
        raw[k]["count"] = np.where(spread > 0, spread, raw[k]["count"])
    lower = None
    for k in range(1, ORDER + 1):
        t = raw[k]
        n1, n2 = np.sum(t["count"] == 1), np.sum(t["count"] == 2)
        discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        contexts, inverse = np.unique(t["context"], return_inverse=True)
        total = np.bincount(inverse, t["count"])
        back = discount * np.bincount(inverse, np.minimum(t["count"], 1)) / total
        base = 1 / ALPHABET if k == 1 else lower["p"][np.searchsorted(lower["hash"], t["suffix"])]
        p = np.maximum(t["count"] - discount, 0) / total[inverse] + back[inverse] * base
        lower = {"hash": t["hash"], "context": t["context"], "suffix": t["suffix"], "p": p, "of": contexts, "back": back}
        tables.append(lower)
    return tables


def _find(sorted_hashes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of ``wanted`` in ``sorted_hashes``, -1 where absent."""
    if not len(sorted_hashes):
        return np.full(len(wanted), -1)
    place = np.minimum(np.searchsorted(sorted_hashes, wanted), len(sorted_hashes) - 1)
    return np.where(sorted_hashes[place] == wanted, place, -1)


class Models:
    """All languages' tables merged; ``entropies`` scores texts."""

    def __init__(self, by_language: dict[str, list[dict[str, np.ndarray]]]):
        self.languages = sorted(by_language)
        models = [by_language[x] for x in self.languages]
        n = len(models)
        self.hash, self.log_p, self.log_back = [], [], []
        self.floor = np.log(np.array([m[0]["back"][0] for m in models]) / ALPHABET)
        below = None
        for k in range(ORDER):
            h, first = np.unique(np.concatenate([m[k]["hash"] for m in models]), return_index=True)
            context = np.concatenate([m[k]["context"] for m in models])[first]
            suffix = np.concatenate([m[k]["suffix"] for m in models])[first]
            p = np.empty((len(h), n))
            for i, m in enumerate(models):
                at, within = _find(m[k]["hash"], h), _find(m[k]["of"], context)
                back = np.where(within >= 0, m[k]["back"][np.maximum(within, 0)], 1.0)
                base = 1 / ALPHABET if k == 0 else below[np.searchsorted(self.hash[-1], suffix), i]
                p[:, i] = np.where(at >= 0, m[k]["p"][np.maximum(at, 0)], back * base)
            if k:
                # Weights of the order below as contexts of this one.
                weights = np.ones((len(self.hash[-1]), n))
                for i, m in enumerate(models):
                    within = _find(m[k]["of"], self.hash[-1])
                    weights[:, i] = np.where(within >= 0, m[k]["back"][np.maximum(within, 0)], 1.0)
                self.log_back.append(np.log(weights).astype(np.float32))
            self.hash.append(h)
            self.log_p.append(np.log(p).astype(np.float32))
            below = p
        self.temperature, self.mean, self.most = 1.0, np.zeros(n), np.full(n, np.inf)

    def word_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log-probabilities (words x languages) and symbols of each word; the empty word has none."""
        hashes, longest, number = _grams(words)
        out = np.zeros((len(hashes[0]), len(self.languages)), np.float32)
        open_ = np.flatnonzero(longest >= 1)
        for k in range(ORDER, 0, -1):
            now = longest[open_] >= k
            place = np.full(len(open_), -1)
            place[now] = _find(self.hash[k - 1], hashes[k][open_[now]])
            hit = place >= 0
            out[open_[hit]] += self.log_p[k - 1][place[hit]]
            miss = open_[now & ~hit]
            if k > 1 and len(miss):
                context = _find(self.hash[k - 2], hashes[k - 1][miss - 1])
                out[miss[context >= 0]] += self.log_back[k - 2][context[context >= 0]]
            open_ = open_[~hit]
        out[open_] += self.floor
        sums = np.zeros((len(words), len(self.languages)))
        for i in range(len(self.languages)):
            sums[:, i] = np.bincount(number[1:], out[1:, i], len(words))
        symbols = np.array([len(w) + 1 if w else 0 for w in words])
        sums[symbols == 0] = 0
        return sums, symbols

    def entropies(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy in nats a symbol (texts x languages), and symbols of each text."""
        words, codes, offsets = distinct_words(texts)
        scores, symbols = self.word_scores(words)
        size = row_sums(symbols[codes], offsets)
        return -row_sums(scores[codes], offsets) / np.maximum(size, 1)[:, None], size

    def decide(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score, and whether each text is rejected."""
        import pyarrow.compute as pc

        letters = pc.fill_null(pc.match_substring_regex(texts, r"\pL"), False).to_numpy(zero_copy_only=False)
        entropy, size = self.entropies(texts)
        best = np.argmin(entropy, axis=1)
        low = entropy[np.arange(len(best)), best]
        score = np.exp(-self.log_norm(entropy, low))
        limit = self.most[best] * np.maximum(1, np.sqrt(200 / np.maximum(size, 1)))
        rejected = ~letters | (low - self.mean[best] > limit)
        names = [self.languages[i] if ok else UNKNOWN for i, ok in zip(best, letters, strict=True)]
        return names, np.where(letters, score, 0.0), rejected

    def log_norm(self, entropy: np.ndarray, low: np.ndarray) -> np.ndarray:
        return np.log(np.exp(-self.temperature * (entropy - low[:, None])).sum(axis=1))

    def calibrate(self, texts: pa.Array, languages: list[str]) -> None:
        """Fit the temperature, and each language's mean and limit of the cross-entropy's excess."""
        entropy, size = self.entropies(texts)
        truth = np.array([self.languages.index(x) for x in languages])
        if not len(truth):
            return
        own = entropy[np.arange(len(truth)), truth]

        def loss(t: float) -> float:
            low = entropy.min(axis=1)
            return float(np.mean(t * (own - low) + np.log(np.exp(-t * (entropy - low[:, None])).sum(axis=1))))

        self.temperature = min([2.0**x for x in range(-2, 9)], key=loss)
        usable = size > 0
        fitting = usable & (entropy.argmin(axis=1) == truth)
        fitting = fitting if fitting.any() else usable
        for i in range(len(self.languages)):
            mine = (truth == i) & fitting
            mine = mine if mine.sum() >= 5 else fitting  # too few texts of a language: those of all
            if mine.any():
                self.mean[i] = own[mine].mean()
                excess = (own[mine] - self.mean[i]) / np.maximum(1, np.sqrt(200 / size[mine]))
                self.most[i] = max(LEAST_EXCESS, SLACK * np.quantile(excess, QUANTILE))


def fit(training: DataFrame, lang_col: str = "lang", text_col: str = "text", key_col: str = "doc_id") -> Models | None:
    """Models from the rows of ``training`` with a language; None if there is none."""
    usable = training.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(key_col, lang_col, text_col)
    sample = bounded_sample(usable, lang_col, SAMPLE, key_col, size=F.octet_length(text_col), most_bytes=SAMPLE_BYTES).withColumn(
        "_left_out", F.pmod(F.xxhash64(F.lit("calibrate"), key_col), F.lit(1000)) < int(1000 * CALIBRATION)
    )

    def learn(table: pa.Table) -> pa.Table:
        texts = table.filter(pa.compute.invert(table.column("_left_out"))).column(text_col).combine_chunks()
        words, codes, _ = distinct_words(texts)
        counts = np.bincount(codes, minlength=len(words)) if len(codes) else np.zeros(len(words))
        used = [i for i, w in enumerate(words) if w]
        model = train([words[i] for i in used], counts[used]) if used else None
        return pa.table({lang_col: [table.column(lang_col)[0].as_py()], "_model": [pickle.dumps(model)]})

    learned = sample.groupBy(lang_col).applyInArrow(learn, f"`{lang_col}` string, _model binary").collect()
    tables = {r[0]: m for r in learned if (m := pickle.loads(r[1])) is not None}
    if not tables:
        return None
    models = Models(tables)
    kept = sample.where("_left_out").select(lang_col, text_col).toArrow()
    kept = kept.filter(pa.compute.is_in(kept.column(lang_col), pa.array(list(tables), kept.schema.field(lang_col).type)))
    if kept.num_rows:
        models.calibrate(kept.column(text_col).combine_chunks(), kept.column(lang_col).to_pylist())
    return models


def identify(docs: DataFrame, models: Models | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected) for each row."""
    sent = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        own = sent.value
        for part in slices(batches, text_col):
            names, score, rejected = _decide(own, part.column(text_col))
            yield pa.RecordBatch.from_arrays(
                [part.column(id_col), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                [id_col, "lang_pred", "score", "rejected"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return batched(docs.select(id_col, text_col)).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, models: Models | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text isn't rejected."""
    sent = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        own = sent.value
        for part in slices(batches, text_col):
            yield part.filter(pa.array(~np.asarray(_decide(own, part.column(text_col))[2], bool)))

    return batched(docs).mapInArrow(run, docs.schema)


def _decide(models: Models | None, texts: pa.Array):
    if models is None:
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
    return models.decide(texts)
