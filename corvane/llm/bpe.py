"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

1. Documents are taken in blocks of about ``BLOCK_BYTES`` of text. Each text is cut into pre-tokens ("words") with their positions: a
   block's distinct words are numbered, and a text is the row of its words' numbers. A block is named by a digest of what it holds.
2. The distinct words are exploded into buckets by a hash of the word, so that a word crosses the network once a block at most, however
   often it stands there. One exchange deals out the words by their buckets and the numbers by their blocks.
3. The words of a bucket meet from all blocks; each distinct one is encoded once, and its ids go back to the
   blocks that hold it.
4. Numbers meet the ids of their words (both are dealt by block), ids are joined by number, and every document is put together by
   position. The ids' bytes come from the token-byte table, whose size is that of the vocabulary file.

The number of buckets follows the input's size. Nothing is collected but that size.

Defined results: null and empty texts give no ids and empty decoded bytes; very long texts are blocks of their own, worked on in pieces;
repeated rows stay repeated; an empty table gives an empty result; columns besides id and text are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import batched, lean, safe_pieces, slices, trim

BLOCK_BYTES = 4 << 20
#: Text bytes for each word bucket, and the fewest buckets.
BUCKET_BYTES, BUCKETS = 32 << 20, 16
#: Text bytes that are cut, and words that are put together, at once.
_PART_BYTES, _PART_WORDS = 2 << 20, 1 << 17


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a file of base64 and decimal pairs."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@functools.lru_cache(2)
def token_bytes(path: str) -> pa.Array:
    """The token-byte table: each rank's bytes, null for ranks that no token has."""
    table = {i: b for b, i in read_ranks(path).items()}
    return pa.array([table.get(i) for i in range(max(table, default=-1) + 1)], pa.large_binary())


def word_encoder(path: str, pattern: str):
    """The ids of one pre-token, by the library's merge loop on its bytes."""
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})._core_bpe.encode_single_piece


def decode(ids: Iterable[int], table: dict[int, bytes]) -> bytes:
    return b"".join(map(table.__getitem__, ids))


def buckets_for(size: int) -> int:
    """A bucket for each ``BUCKET_BYTES`` of text; from 4,096 on as the root of the size, for a block holds a bounded number of
    distinct words, and each bucket makes a row of it."""
    n = size / BUCKET_BYTES
    return int(max(BUCKETS, min(n, 64 * n**0.5)))


def _packed(values) -> bytes:
    """Whole numbers from 0, byte by byte: the high bytes, which are mostly 0, then take next to nothing."""
    planes = np.ascontiguousarray(np.asarray(values).astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * n, "zstd"), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _ids_packed(column: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([column], ["id"])
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


class _Numbered:
    """The words of a block: numbers in the order of their first positions, and texts as their words' numbers."""

    def __init__(self, find) -> None:
        self.find, self.number_of, self.words_of = find, {}, {}
        self.sizes: list[np.ndarray] = []
        self.codes: list[np.ndarray] = []

    def _words(self, piece: str) -> list[int]:
        known = self.words_of.get(piece)
        if known is None:
            plain = piece.isascii() and piece[1:].isalpha() and (piece[0] == " " or piece[0].isalpha())
            number = self.number_of
            known = self.words_of[piece] = [number.setdefault(w, len(number)) for w in ((piece,) if plain else self.find(piece))]
        return known

    def add(self, texts: list[str | None]) -> None:
        cut = [safe_pieces(t) if t else [] for t in texts]
        coded = pa.array([p for own in cut for p in own], pa.large_string()).dictionary_encode()
        own = [self._words(p) for p in coded.dictionary.to_pylist()]
        ends = np.cumsum([0, *map(len, own)])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array([w for x in own for w in x], pa.int32()))
        index = coded.indices
        place = index.to_numpy(zero_copy_only=False)
        before = np.concatenate([[0], np.cumsum(np.diff(ends)[place])])
        offsets = np.cumsum([0, *map(len, cut)])
        self.codes.append(lists.take(index).flatten().to_numpy(zero_copy_only=False))
        self.sizes.append(np.diff(before[offsets]))

    def finished(self) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Sizes of the texts in words, and words by number, with the most frequent ones first."""
        codes = np.concatenate([np.zeros(0, np.int32), *self.codes])
        words = list(self.number_of)
        order = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        return np.concatenate([np.zeros(0, np.int64), *self.sizes]), rank[codes], [words[i] for i in order.tolist()]


_ROW = "_key string, _block string, _bucket int, _n int, _lengths binary, _size long, _words binary, _order binary, _ids binary"
_NAMES = [x.split()[0] for x in _ROW.split(", ")]
_KINDS = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(_KINDS)], _NAMES)


def _exploded(part: pa.RecordBatch, find, n_buckets: int, id_col: str, text_col: str) -> Iterator[pa.RecordBatch]:
    """The rows of a block: one for the texts' numbers (bucket -1), and one for the words of each bucket."""
    block = _Numbered(find)
    for some in slices([part], text_col, _PART_BYTES, tidy=False):
        block.add(some.column(text_col).to_pylist())
    sizes, codes, words = block.finished()
    raw = [w.encode() for w in words]
    bucket = np.array([zlib.crc32(w) % n_buckets for w in raw], np.int64)
    order = np.argsort(bucket, kind="stable")
    ids, sizes_, codes_, order_ = _ids_packed(part.column(id_col)), _packed(sizes), _packed(codes), _packed(order)
    digest = hashlib.blake2b(digest_size=16)
    for x in (ids, sizes_, codes_, *raw):
        digest.update(x)
    name = digest.hexdigest()
    n, size = len(sizes), len(codes)
    del block, codes, sizes
    rows = [(name, name, -1, n, sizes_, size, codes_, order_, ids)]
    ends = np.flatnonzero(np.diff(bucket[order], append=-1)) + 1
    for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True) if len(order) else ():
        own = [raw[i] for i in order[a:b].tolist()]
        k = int(bucket[order[a]])
        rows.append((f"w{k}", name, k, len(own), _packed(list(map(len, own))), sum(map(len, own)), pa.compress(b"".join(own), "zstd", asbytes=True), None, None))
    yield _rows(rows)


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of each row, and with ``with_ids`` also the array
    ``ids`` and the binary ``decoded``.

    ``block_bytes`` bounds the text of a block: less takes less memory and repeats more words.
    ``ids_sha256`` is of the decimal ids joined by one blank, ``decoded_sha256`` of the decoded bytes.
    Pre-tokens are the matches of ``pattern``; ``ranks_path`` must be readable on every executor.
    """
    size = docs.select(F.sum(F.octet_length(text_col))).first()[0] or 0
    n_buckets = buckets_for(size)
    id_type = docs.schema[id_col].dataType.simpleString()

    def explode(batches):
        import regex

        find = regex.compile(pattern).findall
        for part in _blocks(batches, text_col, block_bytes):
            yield from _exploded(part, find, n_buckets, id_col, text_col)

    # One exchange for both: each of its readers drops the rows of the other. They tell them by a generated column, since a condition on a
    # column of the exchange would be moved below it, and either reader would cut all texts for itself.
    dealt = batched(docs.select(id_col, text_col)).mapInArrow(explode, _ROW).repartition("_key").select("*", F.explode(F.array("_bucket")).alias("_of"))

    def encode(batches):
        lean()
        one, known, last = word_encoder(ranks_path, pattern), {}, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["_bucket"] != last:
                    known, last = {}, row["_bucket"]
                words, ids, counts, at = pa.decompress(row["_words"], row["_size"], "zstd", asbytes=True), [], [], 0
                for n in _unpacked(row["_lengths"], row["_n"]).tolist():
                    word = words[at : at + n]
                    at += n
                    got = known.get(word)
                    if got is None:
                        got = known[word] = one(word)
                    ids += got
                    counts.append(len(got))
                yield _rows([(row["_block"], row["_block"], row["_bucket"], row["_n"], _packed(counts), len(ids), _packed(ids), None, None)])
        trim()

    # A bucket's rows follow each other, so each of its distinct words is encoded once, whatever the number of blocks that hold it.
    back = batched(dealt.where("_of >= 0").drop("_of").sortWithinPartitions("_bucket")).mapInArrow(encode, _ROW)

    def assemble(own: pa.Table, returned: pa.Table) -> pa.Table:
        lean()
        out = _assembled(own, returned, token_bytes(ranks_path), id_col, with_ids)
        del own, returned
        trim()
        return out

    schema = f"`{id_col}` {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * with_ids
    return dealt.where("_of < 0").drop("_of").groupBy("_key").cogroup(back.groupBy("_key")).applyInArrow(assemble, schema)


def _blocks(batches: Iterable[pa.RecordBatch], text_col: str, most: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about ``most`` bytes of text, over the borders of the batches."""
    held: list[pa.RecordBatch] = []
    size = 0
    for part in slices(batches, text_col, most):
        own = int(pc.sum(pc.binary_length(part.column(text_col))).as_py() or 0)
        if held and size + own > most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        held.append(part)
        size += own
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _assembled(own: pa.Table, returned: pa.Table, table: pa.Array, id_col: str, with_ids: bool) -> pa.Table:
    """The documents of a block (several times if it comes several times), from numbers and the words' ids in the order of the buckets."""
    first = own.slice(0, 1).to_pylist()[0]
    found = {row["_bucket"]: row for row in returned.to_pylist()}
    rows = [found[k] for k in sorted(found)]
    counts = np.concatenate([np.zeros(0, np.int64), *(_unpacked(r["_lengths"], r["_n"]) for r in rows)]).astype(np.int64)
    ids = np.concatenate([np.zeros(0, np.uint32), *(_unpacked(r["_words"], r["_size"]) for r in rows)]).astype(np.int32)
    ends = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int64())
    flat = pa.array(ids, pa.int32())
    place = np.empty(len(counts), np.int64)  # of a word's number in the order of the buckets
    place[_unpacked(first["_order"], len(counts))] = np.arange(len(counts))
    written = pc.binary_join(pa.LargeListArray.from_arrays(ends, flat.cast(pa.large_string())), pa.scalar(" ", pa.large_string()))
    raw = pc.binary_join(pa.LargeListArray.from_arrays(ends, table.take(flat)), pa.scalar(b"", pa.large_binary()))
    lists = pa.LargeListArray.from_arrays(ends, flat)
    sizes = _unpacked(first["_lengths"], first["_n"]).astype(np.int64)
    codes = place[_unpacked(first["_words"], first["_size"])]
    out: dict[str, list] = {"n": [], "ids_sha256": [], "decoded_sha256": [], "ids": [], "decoded": []}
    bounds, i = np.concatenate([[0], np.cumsum(sizes)]), 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + _PART_WORDS, side="right")) - 1)
        part = codes[bounds[i] : bounds[j]]
        offsets = pa.array(bounds[i : j + 1] - bounds[i], pa.int64())
        at = pa.array(part)
        before = np.concatenate([[0], np.cumsum(counts[part])])
        out["n"].append(np.diff(before[bounds[i : j + 1] - bounds[i]]))
        for key, values, between in (("ids_sha256", written, " "), ("decoded_sha256", raw, b"")):
            joined = pc.binary_join(pa.LargeListArray.from_arrays(offsets, values.take(at)), pa.scalar(between, values.type)).cast(pa.large_binary())
            out[key] += [hashlib.sha256(x.as_buffer()).hexdigest() for x in joined]
            if with_ids and key == "decoded_sha256":
                out["decoded"].append(joined.cast(pa.binary()))
        if with_ids:
            taken = lists.take(at).flatten()
            out["ids"].append(pa.ListArray.from_arrays(pa.array(before[bounds[i : j + 1] - bounds[i]], pa.int32()), taken))
        i = j
    columns = {
        "n_tokens": pa.array(np.concatenate([np.zeros(0, np.int64), *out["n"]]), pa.int64()),
        "ids_sha256": pa.array(out["ids_sha256"], pa.string()),
        "decoded_sha256": pa.array(out["decoded_sha256"], pa.string()),
    }
    if with_ids:
        columns |= {"ids": pa.chunked_array(out["ids"], pa.list_(pa.int32())), "decoded": pa.chunked_array(out["decoded"], pa.binary())}
    tables = []
    for data in own.column("_ids").to_pylist():
        tables.append(pa.table({id_col: pa.ipc.open_stream(data).read_all().column("id"), **columns}))
    return pa.concat_tables(tables)


def decode_ids(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded binary) from arrays of ids, by the token-byte table; null gives null, an unknown id fails."""

    def run(batches):
        table = {i: b for b, i in read_ranks(ranks_path).items()}
        for batch in batches:
            got = [None if ids is None else decode(ids, table) for ids in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(got, pa.binary())], [id_col, "decoded"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {encoded.schema[id_col].dataType.simpleString()}, decoded binary")
