"""Alignment of two tokenizers' tokens over whole texts, and corpus-wide counts of the id pairs that they link.

1. Texts are cut into pieces where both tokenizers cut: before a space that follows no white space. In a worker every distinct piece is encoded by both, and its
   bytes get labels: 0 where no token ends, 1 where one of A ends, 2 where one of B ends, 3 where both do. A regular expression scans the label string for spans up
   to each 3, whose counts of labels give the tokens of a group. Every label but 0 closes a stretch of bytes that lies in exactly one token of A and one of
   B: the stretches are the links.
2. Documents go into blocks of about ``BLOCK_BYTES`` of text. A block is one row: its documents' counts and digests, its distinct id pairs with the
   number of its documents that hold them, and each document's pairs as places in that list with their numbers of links, packed. What a worker
   keeps of pieces is dropped with the task, and a file of blocks holds few of them, since Spark reads the rows of a file together.
3. Pair counts are summed over blocks (partial sums first), the highest of each A id is found beside them, and the blocks' pairs are joined with both. A block asks for
   each of its pairs once, so the most frequent pair is as many rows as there are blocks.
4. The answers meet their block, and every document sums them over its links.

Nothing is collected or broadcast by hand; a side that Spark finds small when it runs may be broadcast.

Defined results: null and empty texts, and texts whose joined token bytes of A or B differ from space + text, have no tokens: zeros, and '' as digest and groups; every
row is a document of its own, so repeated rows count as often as they are there; a very long text is a block of its own, worked on in parts of about ``PART``
characters; an empty table gives an empty result; columns besides id and text are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import batched, lean, slices, stored, trim
from corvane.llm.token_counts import byte_level

BLOCK_BYTES = 8 << 20
#: Characters that are aligned together, and about the bytes that a worker keeps of pieces it has aligned, each taking PIECE_BYTES besides its text and groups.
PART, KEPT_BYTES, PIECE_BYTES = 1 << 20, 64 << 20, 300
#: Blocks in a stored file.
FILE_BLOCKS = 8
#: New pieces that go to a tokenizer in one text.
TOGETHER = 200

_CUT = re.compile("(?<=[^\\s᠎​﻿])(?= )")
#: Where this stands, not every space is a cut.
_ODD = re.compile("[\\s᠎​﻿] ")
#: Beyond these code points libraries may class characters by different editions of Unicode.
_SETTLED = re.compile("[\0-ɏ]*")
#: Pieces that may be encoded in one text: the next one's space is a cut.
_JOINT = re.compile("[\0-ɏ]*(?<!\\s)")
_SPAN = re.compile(rb"[^3]*3")
_SPACE_MARK = "▁"


def _byte_of() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others, in order, as code points from 256."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(others)}


class _Vocabulary:
    """Token bytes of a vocabulary by id, one behind another."""

    def __init__(self, tokens: list[bytes]):
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(tokens) or b"\0", np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.data[np.repeat(self.starts[ids], self.sizes[ids]) + _places(self.sizes[ids])]


def _places(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... within each run of the given sizes."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def _ranks(path: str) -> dict[bytes, int] | None:
    """Token bytes and ids of a .json vocabulary whose merges are in the order of their ids, so that ids are ranks; None for others."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    of, vocab = _byte_of(), model["vocab"]
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    made = [vocab.get(x + y, -1) for x, y in merges]
    if made != sorted(set(made)) or not made or made[0] < 0:
        return None
    kept = {t: i for t, i in vocab.items() if len(t) == 1 or made[0] <= i <= made[-1]}
    ranks = {bytes(of[c] for c in t): i for t, i in kept.items() if all(c in of for c in t)}
    return ranks if len(ranks) == len(made) + 256 else None


class _Encoder:
    """Encodes pieces, each a space and what follows it up to the next cut, and knows the bytes of tokens."""

    def __init__(self, tokens: list[bytes]):
        self.vocabulary = _Vocabulary(tokens)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of whole texts that begin with a space."""
        raise NotImplementedError

    def flat(self, pieces: list[str], size: np.ndarray, joint: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one behind another, and how many each has; ``size`` holds their bytes.

        With ``joint`` they go together, ``TOGETHER`` at a time, and the ends of tokens tell them apart; where these don't meet the pieces' ends, each goes alone.
        """
        if joint:
            found = self.encode(["".join(pieces[n : n + TOGETHER]) for n in range(0, len(pieces), TOGETHER)])
            ids = np.fromiter(chain.from_iterable(found), np.int64, sum(map(len, found)))
            ends, wanted = np.cumsum(self.vocabulary.sizes[ids]), np.cumsum(size)
            at = np.searchsorted(ends, wanted)
            if len(ids) and ends[-1] == wanted[-1] and (ends[np.minimum(at, len(ids) - 1)] == wanted).all():
                return ids, np.diff(at + 1, prepend=0)
        found = self.encode(pieces)
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int64, int(counts.sum())), counts


class _ByteLevel(_Encoder):
    """A byte-level .json file. Texts of settled characters go through its ranks where ids are ranks, which gives the same ids sooner."""

    def __init__(self, path: str):
        if not byte_level(path):
            raise ValueError(f"{path}: not a byte-level vocabulary")
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model, of = Tokenizer.from_file(path), _byte_of()
        self.model.encode_special_tokens = True
        entries = (self.model.id_to_token(i) or "" for i in range(self.model.get_vocab_size(True)))
        super().__init__([bytes(of[c] for c in t) if all(c in of for c in t) else t.encode() for t in entries])
        ranks = _ranks(path)
        self.fast = None
        if ranks:
            import public_tokenizers
            import tiktoken

            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts):
        settled = [self.fast is not None and _SETTLED.fullmatch(t) is not None for t in texts]
        slow = [t for t, ok in zip(texts, settled, strict=True) if not ok]
        others = iter([x.ids for x in self.model.encode_batch_fast(slow, add_special_tokens=False)] if slow else [])
        return [self.fast.encode_ordinary(t) if ok else next(others) for t, ok in zip(texts, settled, strict=True)]


class _Pieces(_Encoder):
    """A .model file, which adds the first space by itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        super().__init__([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(_SPACE_MARK, " ").encode() for i, p in enumerate(pieces)])
        # No piece goes on from another character to a space, and nothing rewrites white space: merges never cross a cut.
        apart = not any(re.search(f"[^{_SPACE_MARK}]{_SPACE_MARK}", p) for p in pieces)
        plain = self.model.normalize("a  b \n c ") == f"{_SPACE_MARK}a{_SPACE_MARK * 2}b{_SPACE_MARK}\n{_SPACE_MARK}c{_SPACE_MARK}"
        space = self.model.piece_to_id(_SPACE_MARK)
        self.lone = [] if self.model.is_unknown(space) else [space]
        self.cuts = apart and plain and bool(self.lone)

    def encode(self, texts):
        # The model adds no space to an empty text.
        return [ids if t != " " else self.lone for t, ids in zip(texts, self.model.encode([t[1:] for t in texts], num_threads=1), strict=True)]


class _Grown:
    """Rows of numbers that are added behind others; room doubles."""

    def __init__(self, *shape: int):
        self.data, self.size = np.zeros((1024, *shape), np.int64), 0

    def add(self, rows: np.ndarray) -> None:
        while self.size + len(rows) > len(self.data):
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
        self.data[self.size : self.size + len(rows)] = rows
        self.size += len(rows)


class Aligner:
    """Aligns pieces and keeps what it found for each, by number."""

    def __init__(self, path_a: str, path_b: str):
        self.encoder_a, self.encoder_b = _ByteLevel(path_a), _Pieces(path_b)
        self.a, self.b, self.cuts = self.encoder_a.vocabulary, self.encoder_b.vocabulary, self.encoder_b.cuts
        # Every id in decimals with each sign that can follow it.
        self.shown = [f"{i}{c}".encode() for i in range(len(self.a.sizes)) for c in ",|"] + [f"{i}{c}".encode() for i in range(len(self.b.sizes)) for c in ",;"]
        self.shown_sizes = np.fromiter(map(len, self.shown), np.int64, len(self.shown))
        self.n_pairs = len(self.a.sizes) * len(self.b.sizes)
        self.clear()

    def tidy(self) -> None:
        """Forget what was aligned once it takes too much."""
        if self.held > KEPT_BYTES:
            self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.groups: list[bytes] = []
        self.held = 0
        #: For each piece: valid, tokens of A and of B, groups, links, where its pairs begin.
        self._counts, self._pairs = _Grown(6), _Grown()

    def pieces(self, text: str) -> list[str]:
        """The pieces of space + text, each without its own first space."""
        if not self.cuts:
            return [text]
        return text.split(" ") if not text[:1].isspace() and not _ODD.search(text) else [p[1:] for p in _CUT.split(" " + text)]

    def parts(self, text: str) -> Iterator[list[str]]:
        """The pieces of a text, some at a time."""
        at = 0
        while self.cuts and at + PART < len(text) and (end := _CUT.search(text, at + PART)):
            yield self.pieces(text[at : end.start()])
            at = end.start() + 1
        yield self.pieces(text[at:])

    def add(self, pieces: list[str]) -> None:
        """Encode, label and scan new pieces."""
        spaced = [" " + p for p in pieces]
        joint = [_JOINT.fullmatch(p) is not None for p in spaced]
        for together in (True, False):
            if together in joint:
                self._add(list(compress(spaced, map(together.__eq__, joint))), together and self.cuts)

    def _add(self, spaced: list[str], joint: bool) -> None:
        texts = [p.encode("utf-8", "surrogatepass") for p in spaced]
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        flat_a, n_a = self.encoder_a.flat(spaced, size, joint)
        flat_b, n_b = self.encoder_b.flat(spaced, size, joint)
        ends_a, ends_b = self.a.sizes[flat_a], self.b.sizes[flat_b]
        fits = (_sums(ends_a, n_a) == size) & (_sums(ends_b, n_b) == size) & (_sums(ends_a == 0, n_a) == 0) & (_sums(ends_b == 0, n_b) == 0)
        keep_a, keep_b = np.repeat(fits, n_a), np.repeat(fits, n_b)
        flat_a, flat_b = flat_a[keep_a], flat_b[keep_b]
        own = np.frombuffer(b"".join(texts) if fits.all() else b"".join(t for t, ok in zip(texts, fits.tolist(), strict=True) if ok), np.uint8)
        differs = (self.a.joined(flat_a) != own) | (self.b.joined(flat_b) != own)
        labels = np.full(len(own), ord("0"), np.uint8)
        labels[np.cumsum(self.a.sizes[flat_a]) - 1] += 1
        labels[np.cumsum(self.b.sizes[flat_b]) - 1] += 2
        spans = np.cumsum(np.fromiter(map(len, _SPAN.findall(labels.tobytes())), np.int64))
        upto_a, upto_b = np.cumsum(labels & 1, dtype=np.int64), np.cumsum((labels >> 1) & 1, dtype=np.int64)
        links = np.flatnonzero(labels != ord("0"))
        pairs = flat_a[upto_a[links] - (labels[links] & 1)] * len(self.b.sizes) + flat_b[upto_b[links] - ((labels[links] >> 1) & 1)]
        # Where each piece ends among spans and links.
        ends = np.cumsum(np.where(fits, size, 0))
        spans_to, links_to = np.searchsorted(spans, ends, side="right"), np.searchsorted(links, ends, side="left")
        wrong = np.concatenate([[0], np.cumsum(differs)])
        fits &= wrong[ends] == wrong[ends - np.where(fits, size, 0)]
        # A group's tokens of A come before those of B, each with the sign behind it.
        end_a, end_b = upto_a[spans - 1], upto_b[spans - 1]
        in_a, in_b = np.diff(end_a, prepend=0), np.diff(end_b, prepend=0)
        shown = np.empty(len(flat_a) + len(flat_b), np.int64)
        last = np.zeros(len(flat_a), np.int64)
        last[end_a - 1] = 1
        shown[np.arange(len(flat_a)) + np.repeat(end_b - in_b, in_a)] = 2 * flat_a + last
        last = np.zeros(len(flat_b), np.int64)
        last[end_b - 1] = 1
        shown[np.arange(len(flat_b)) + np.repeat(end_a, in_b)] = 2 * (flat_b + len(self.a.sizes)) + last
        joined = b"".join(map(self.shown.__getitem__, shown.tolist()))
        tokens_to = np.concatenate([[0], np.cumsum(self.shown_sizes[shown])])
        at = np.concatenate([[0], end_a + end_b])[spans_to]
        base, lower = len(self.groups), 0
        n_links = np.diff(links_to, prepend=0)
        self._counts.add(np.stack([fits, n_a, n_b, np.diff(spans_to, prepend=0), n_links, self._pairs.size + links_to - n_links], 1))
        self._pairs.add(pairs)
        for upper in tokens_to[at].tolist():
            self.groups.append(joined[lower : max(lower, upper - 1)])
            lower = upper
        self.index.update(zip([p[1:] for p in spaced], range(base, base + len(spaced)), strict=True))
        self.held += int(size.sum()) + sum(map(len, self.groups[base:])) + 8 * len(pairs) + PIECE_BYTES * len(spaced)

    def codes(self, lists: list[list[str]]) -> np.ndarray:
        """The numbers of all pieces, one list behind another; what is new is aligned first."""
        new = list(set().union(*lists).difference(self.index))
        if new:
            self.add(new)
        return np.fromiter(map(self.index.__getitem__, chain.from_iterable(lists)), np.int64, sum(map(len, lists)))

    def counts(self, codes: np.ndarray) -> np.ndarray:
        return self._counts.data[codes]

    def pairs(self, counts: np.ndarray) -> np.ndarray:
        """The id pairs of pieces with these counts, one behind another."""
        return self._pairs.data[np.repeat(counts[:, 5], counts[:, 4]) + _places(counts[:, 4])]


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    ends = np.cumsum(sizes)
    return upto[ends] - upto[ends - sizes]


@functools.lru_cache(1)
def _worker(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


class _Documents:
    """What adds up for the documents of a block, by their places in it."""

    def __init__(self, with_groups: bool):
        self.with_groups = with_groups
        self.rows: list[tuple[np.ndarray, str, str | None]] = []
        #: For each document in turn: distinct pairs and their links.
        self.pairs: list[np.ndarray] = []
        self.links: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []

    def add(self, own: Aligner, lists: list[list[str]]) -> None:
        """Documents whose pieces are given whole; empty ones have none."""
        codes, ends = own.codes(lists), np.cumsum([len(p) for p in lists])
        counts = own.counts(codes)
        of = np.repeat(np.arange(len(lists)), np.diff(ends, prepend=0))
        sums = np.zeros((len(lists), 4), np.int64)
        bad = np.bincount(of, counts[:, 0] == 0, len(lists)) > 0
        good = ~bad[of]
        for k in range(4):
            sums[:, k] = _sums(np.where(good, counts[:, k + 1], 0), np.diff(ends, prepend=0))
        counts, of = counts[good], of[good]
        keys = np.repeat(of, counts[:, 4]) * own.n_pairs + own.pairs(counts)
        self._add_pairs(*_counted(keys, None), own.n_pairs, len(lists))
        groups, start = own.groups, 0
        for n, (stop, wrong) in enumerate(zip(ends.tolist(), bad.tolist(), strict=True)):
            joined = b"" if wrong else b";".join([groups[c] for c in codes[start:stop].tolist()])
            self.rows.append((sums[n], hashlib.sha256(joined).hexdigest() if joined else "", joined.decode() if self.with_groups else None))
            start = stop

    def add_long(self, own: Aligner, text: str) -> None:
        """One document, some of its pieces at a time."""
        digest, shown, total = hashlib.sha256(), [], np.zeros(4, np.int64)
        pairs, links, first = np.zeros(0, np.int64), np.zeros(0, np.int64), True
        for pieces in own.parts(text):
            own.tidy()
            codes = own.codes([pieces])
            counts = own.counts(codes)
            if not counts[:, 0].all():
                self.rows.append((np.zeros(4, np.int64), "", "" if self.with_groups else None))
                self._add_pairs(pairs[:0], links[:0], own.n_pairs, 1)
                return
            total += counts[:, 1:5].sum(0)
            joined = b";".join([own.groups[c] for c in codes.tolist()])
            digest.update(joined if first else b";" + joined)
            first = False
            if self.with_groups:
                shown.append(joined)
            new, times = _counted(own.pairs(counts), None)
            pairs, links = _counted(np.concatenate([pairs, new]), np.concatenate([links, times]))
        self.rows.append((total, digest.hexdigest(), b";".join(shown).decode() if self.with_groups else None))
        self._add_pairs(pairs, links, own.n_pairs, 1)

    def _add_pairs(self, keys: np.ndarray, links: np.ndarray, n_pairs: int, documents: int) -> None:
        self.pairs.append(keys % n_pairs)
        self.links.append(links.astype(np.int32))
        self.sizes.append(np.bincount(keys // n_pairs, minlength=documents))


def _counted(keys: np.ndarray, weights: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and how often each is there, or the sums of their weights."""
    if weights is not None:
        order = np.argsort(keys, kind="stable")
        keys, weights = keys[order], weights[order]
    else:
        keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    if weights is None:
        return keys[first], np.diff(np.append(first, len(keys)))
    return keys[first], np.add.reduceat(weights, first) if len(first) else weights[:0]


def _packed(places: np.ndarray, links: np.ndarray) -> bytes:
    """Places as differences, then links, both by planes of bytes and compressed; they are as many as a block's documents have pairs."""
    if not len(places):
        return b""
    both = np.concatenate([np.diff(places, prepend=0), links]).astype("<i4")
    return pa.compress(both.view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def _unpacked(packed: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``n`` places and links."""
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    planes = np.frombuffer(pa.decompress(packed, 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, -1)
    both = np.ascontiguousarray(planes.T).view("<i4")[:, 0].astype(np.int64)
    return np.cumsum(both[:n]), both[n:]


_SUMS = ("n_a", "n_b", "n_groups", "n_links")


def _block_type(id_type: T.DataType) -> T.StructType:
    lists = {"ids": id_type, **{c: T.LongType() for c in _SUMS}, "sha": T.StringType(), "groups": T.StringType(), "sizes": T.IntegerType(), "pairs": T.LongType(), "held": T.IntegerType()}
    return T.StructType([T.StructField("block", T.StringType()), T.StructField("packed", T.BinaryType()), *(T.StructField(n, T.ArrayType(t)) for n, t in lists.items())])


def blocks(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each block: documents, distinct pairs (A id times the size of B's vocabulary, plus B id), the number of documents that hold each."""
    id_type = docs.schema[id_col].dataType
    out = _block_type(id_type)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number, size = _worker(path_a, path_b), 0, 0
        ids: list[pa.Array] = []
        found = _Documents(with_groups)

        def row() -> pa.RecordBatch:
            pairs, places = np.unique(np.concatenate(found.pairs), return_inverse=True)
            sums = np.stack([r[0] for r in found.rows])
            values = [pa.concat_arrays(ids), *(pa.array(sums[:, i]) for i in range(4)), pa.array([r[1] for r in found.rows]), pa.array([r[2] for r in found.rows], pa.string())]
            values += [pa.array(np.concatenate(found.sizes).astype(np.int32)), pa.array(pairs), pa.array(np.bincount(places, minlength=len(pairs)).astype(np.int32))]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in values]
            packed = _packed(places, np.concatenate(found.links))
            return pa.RecordBatch.from_arrays([pa.array([f"{TaskContext.get().partitionId()}-{number}"]), pa.array([packed], pa.binary()), *lists], out.names)

        for part in slices(batches, text_col, PART):
            own.tidy()
            texts = part.column(text_col).to_pylist()
            if len(texts) == 1 and len(texts[0] or "") > PART:
                found.add_long(own, texts[0])
            else:
                found.add(own, [own.pieces(t) if t else [] for t in texts])
            ids.append(part.column(id_col))
            size += sum(len(t or "") for t in texts)
            if size >= block_bytes:
                yield row()
                ids, found, size, number = [], _Documents(with_groups), 0, number + 1
        if ids:
            yield row()
        # Workers live on beside the stages that follow.
        ids, found = [], _Documents(with_groups)
        own.clear()
        trim()

    return batched(docs.select(id_col, text_col)).mapInArrow(run, out)


def pair_counts(held: DataFrame, size_b: int) -> DataFrame:
    """(pair, count, best): documents that hold each pair, and whether no pair of the same A id is in more of them."""
    each = held.select(F.explode(F.arrays_zip("pairs", "held")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.held").alias("count"))
    most = F.max("count").over(Window.partitionBy(F.floor(F.col("pair") / size_b)))
    return each.select("pair", "count", (F.col("count") == most).alias("best"))


def _size(path_b: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row; ``with_groups`` adds the groups themselves.

    ``path_a`` is a byte-level .json vocabulary and ``path_b`` a .model file, which every executor has at these paths.
    """
    id_type = docs.schema[id_col].dataType
    # Written once: names of blocks hold for everything that reads them.
    held = stored(blocks(docs, path_a, path_b, id_col, text_col, with_groups, block_bytes), FILE_BLOCKS)
    asked = held.select("block", F.posexplode("pairs").alias("place", "pair"))
    answers = asked.join(pair_counts(held, _size(path_b)), "pair").groupBy("block").agg(F.collect_list(F.struct("place", "count", "best")).alias("answers"))
    whole = held.select("block", "ids", *_SUMS, "sha", "groups", "sizes", "packed").join(answers, "block", "left")
    names = [id_col, *_SUMS, "n_best", "count_sum", "groups_sha256", *(["groups"] if with_groups else [])]

    def run(batches):
        lean()
        for batch in batches:
            for i in range(batch.num_rows):
                of = {c: batch.column(c)[i].values for c in batch.schema.names if c not in ("block", "answers", "packed")}
                count, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
                answer = batch.column("answers")[i].values
                if answer is not None and len(answer):
                    place, n, b = (answer.field(k) for k in range(3))
                    order = np.argsort(place.to_numpy())
                    count, best = n.to_numpy()[order], b.to_numpy(zero_copy_only=False)[order].astype(np.int64)
                sizes = of["sizes"].to_numpy().astype(np.int64)
                places, links = _unpacked(batch.column("packed")[i].as_py(), int(sizes.sum()))
                found = [pa.array(_sums(links * best[places], sizes)), pa.array(_sums(links * count[places], sizes)), of["sha"], *([of["groups"]] if with_groups else [])]
                yield pa.RecordBatch.from_arrays([of["ids"], *(of[c] for c in _SUMS), *found], names)
        trim()

    fields = [T.StructField(id_col, id_type), *(T.StructField(c, T.LongType()) for c in (*_SUMS, "n_best", "count_sum")), T.StructField("groups_sha256", T.StringType())]
    return whole.mapInArrow(run, T.StructType(fields + ([T.StructField("groups", T.StringType())] if with_groups else [])))
