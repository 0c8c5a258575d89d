"""Removal of repeated byte strings of ``LENGTH`` and more, by sampled suffixes sorted bucket by bucket.

A difference cover lets two suffixes be compared through sampled positions at a common distance. Here the cover is chosen
by content: of the ``LENGTH`` - ``GRAM`` + 1 grams in a window of ``LENGTH`` bytes the one of smallest hash is the window's
sample, so two equal windows always have their sample at the same distance, and about one position in 85 is a
sample instead of every one. Windows of one sample are consecutive and make a block.

1. Every block gets two ranks beforehand: of its sample's gram (the suffix bucket) and of all its bytes (the cover's rank, 64-bit
   hashes, for only equality matters).
2. Buckets of one block have no repeat. In buckets where all blocks have the same rank, long ties are settled by it: every
   window repeats. So does every window of a block whose rank comes twice.
3. The distinct blocks of the other buckets are brought together, and one bucket after another is sorted: the suffixes that
   begin in its blocks by their first two bytes, and where these tie by the ranks (hashes) of their first ``LENGTH`` bytes. Neighbours of
   equal rank are compared byte by byte; should one of them differ, the bucket is ranked by its bytes alone, by doubling.
   What a task holds is a bucket, or several small ones together.
4. A bucket of more than ``LARGE`` distinct blocks, which no task should hold, is dealt out once more by hashes of its windows, which
   are counted within it; counts combine before they are shuffled. Both ways give the same rows.

Counts, joins and sorts are of blocks or of doubtful windows, never of all positions. Texts are shuffled once, compressed.

Defined results: null and empty texts have no bytes; texts below ``LENGTH`` stay whole; two rows of the same text are copies of each
other; rows without id are treated as any other; ids of any type that can be cast to a string will do; very long texts are
cut to overlapping segments of ``SEGMENT`` window starts; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import batched, mix, slices, stored, text_bytes

LENGTH, GRAM = 200, 32
#: Distinct blocks of a bucket, of 368 bytes at most, beyond which it is dealt out.
LARGE = 8_000
#: Window starts that are worked on at once, and bytes of small buckets that are sorted together.
SEGMENT, TOGETHER = 1 << 16, 1 << 18

_B = 0x9E3779B97F4A7C15


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_B, n, 1 << 64))


_BYTE = mix(np.arange(256, dtype=np.uint64) + np.uint64(7))


def window_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the grams and of the windows of ``LENGTH`` bytes that begin at each place."""
    h, size, kept = _BYTE[data], 1, {}
    while size <= LENGTH:
        if size == GRAM or LENGTH & size:
            kept[size] = h
        if size * 2 <= LENGTH:
            h = h[:-size] * _power(size) + h[size:]
        size *= 2
    n = max(len(data) - LENGTH + 1, 0)
    whole, at = np.zeros(n, np.uint64), 0
    for size in sorted((s for s in kept if LENGTH & s), reverse=True):
        whole = whole * _power(size) + kept[size][at : at + n]
        at += size
    return kept[GRAM], whole


_EIGHT = 8


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as a number that orders as they do."""
    word = np.zeros(max(len(data) - _EIGHT + 1, 0), np.uint64)
    for i in range(_EIGHT):
        word <<= np.uint64(8)
        word |= data[i : i + len(word)]
    return word


def window_ranks(data: np.ndarray) -> np.ndarray:
    """The ranks of the ``LENGTH`` bytes from each place: equal for equal strings, and in the strings' order."""
    if len(data) < LENGTH:
        return np.zeros(0, np.int64)
    rank, size = eight_bytes(data), _EIGHT
    while size < LENGTH:
        rank = np.unique(rank, return_inverse=True)[1].astype(np.uint64)
        step = min(size, LENGTH - size)
        rank = (rank[:-step] << np.uint64(32)) | rank[step:]
        size += step
    return np.unique(rank, return_inverse=True)[1]


def repeated_windows(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether the ``LENGTH`` bytes from each of ``starts`` come from another one of them too."""
    word, (_, whole) = eight_bytes(data), window_hashes(data)
    key = (word[starts] >> np.uint64(48) << np.uint64(48)) | (whole[starts] >> np.uint64(16))
    order = np.argsort(key)
    at, key = starts[order], key[order]
    same = key[1:] == key[:-1]
    out = np.zeros(len(starts), bool)
    a, b = at[:-1][same], at[1:][same]
    if all((word[a + i] == word[b + i]).all() for i in range(0, LENGTH, _EIGHT)):
        out[order[:-1][same]] = out[order[1:][same]] = True
        return out
    rank = window_ranks(data)[starts]
    return np.bincount(rank)[rank] > 1


def blocks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, bucket, rank, first and last window start (in the row) of every block of the texts data[starts:ends]."""
    gram, whole = window_hashes(data)
    n, wide = len(whole), LENGTH - GRAM + 1
    packed = (mix(gram) >> np.uint64(32) << np.uint64(32)) | np.arange(len(gram), dtype=np.uint64)
    size = 1
    while size * 2 <= wide:
        packed = np.minimum(packed[:-size], packed[size:])
        size *= 2
    packed = np.minimum(packed[: len(packed) - (wide - size)], packed[wide - size :])[:n]
    sample = (packed & np.uint64(0xFFFFFFFF)).astype(np.int64)
    row_of = np.full(n, -1)
    for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        row_of[a : max(a, b - LENGTH + 1)] = i
    valid = np.flatnonzero(row_of >= 0)
    if not len(valid):
        return (np.zeros(0, np.int64),) * 5
    own = sample[valid]
    new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (valid[1:] != valid[:-1] + 1) | (row_of[valid[1:]] != row_of[valid[:-1]])]))
    first, last = valid[new], valid[np.concatenate([new[1:] - 1, [len(valid) - 1]])]
    bucket = mix(gram[own[new]])
    rank = mix(mix(whole[first]) + np.uint64(3) * whole[last] + (last - first).astype(np.uint64))
    row = row_of[first]
    return row, bucket.view(np.int64), rank.view(np.int64), first - starts[row], last - starts[row]


def _segments(data: np.ndarray, offsets: np.ndarray):
    """Runs of rows, or parts of a long row, with about ``SEGMENT`` window starts: (data, starts, ends, rows, shift)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SEGMENT, side="right")) - 1)
        a, b = offsets[i], offsets[j]
        if j == i + 1 and b - a > 2 * SEGMENT:
            for x in range(a, b - LENGTH + 1, SEGMENT):
                y = min(b, x + SEGMENT + LENGTH - 1)
                yield data[x:y], np.array([0]), np.array([y - x]), np.array([i]), x - a
        elif b - a >= LENGTH:
            yield data[a:b], offsets[i:j] - a, offsets[i + 1 : j + 1] - a, np.arange(i, j), 0
        i = j


def block_rows(docs: DataFrame) -> DataFrame:
    """(_d, _h, _bucket, _rank, _first, _last) of all blocks of ``docs`` (_d, _h, _text)."""

    def run(batches):
        for part in slices(batches, "_text", SEGMENT):
            data, offsets = text_bytes(part.column("_text"))
            d, h = part.column("_d").to_numpy(), part.column("_h").to_numpy()
            for own, starts, ends, rows, shift in _segments(data, offsets):
                row, bucket, rank, first, last = blocks(own, starts, ends)
                at = rows[row]
                yield pa.RecordBatch.from_arrays([pa.array(d[at]), pa.array(h[at]), pa.array(bucket), pa.array(rank), pa.array(first + shift), pa.array(last + shift)], ["_d", "_h", "_bucket", "_rank", "_first", "_last"])

    return batched(docs).mapInArrow(run, "_d long, _h int, _bucket long, _rank long, _first long, _last long")


def _runs(flags: np.ndarray, at: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last place of the runs of set flags with consecutive places in one row."""
    hit = np.flatnonzero(flags)
    if not len(hit):
        return hit, hit, hit
    new = np.flatnonzero(np.concatenate([[True], (np.diff(at[hit]) != 1) | (np.diff(row[hit]) != 0)]))
    end = np.concatenate([new[1:] - 1, [len(hit) - 1]])
    return row[hit[new]], at[hit[new]], at[hit[end]]


def _doubtful(packed: DataFrame, chosen: DataFrame, hashes: bool) -> DataFrame:
    """The bytes of the chosen blocks, or the hashes of their windows: (_d, _h, _first, _bucket, _bytes or _hashes)."""
    lists = chosen.groupBy("_d", "_h").agg(F.collect_list(F.struct("_first", "_last", "_bucket")).alias("_blocks"))
    joined = packed.join(lists, ["_d", "_h"]).select("_d", "_h", "_size", "_zip", "_blocks")
    name, kind = ("_hashes", pa.list_(pa.int64())) if hashes else ("_bytes", pa.binary())

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                text = pa.decompress(row["_zip"], row["_size"], "zstd", asbytes=True)
                out = []
                for b in row["_blocks"]:
                    own = text[b["_first"] : b["_last"] + LENGTH]
                    out.append((row["_d"], row["_h"], b["_first"], b["_bucket"], window_hashes(np.frombuffer(own, np.uint8))[1].view(np.int64) if hashes else own))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), kind)
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], ["_d", "_h", "_first", "_bucket", name])

    return batched(joined).mapInArrow(run, f"_d long, _h int, _first long, _bucket long, {name} {'array<long>' if hashes else 'binary'}")


def _repeats_in_buckets(rows: DataFrame) -> DataFrame:
    """(_d, _h, _start, _end): bytes of repeated windows among the blocks of one bucket, bucket after bucket.

    Equal windows have equal samples and so one bucket; small buckets can be sorted together.
    """

    def compare(table: pa.Table) -> pa.RecordBatch:
        data, offsets = text_bytes_of_binary(table.column("_bytes").combine_chunks())
        size = np.diff(offsets)
        row = np.repeat(np.arange(table.num_rows), np.maximum(size - LENGTH + 1, 0))
        starts = np.arange(len(row)) + (offsets[:-1] - np.cumsum(np.maximum(size - LENGTH + 1, 0)) + np.maximum(size - LENGTH + 1, 0))[row]
        at, first, last = _runs(repeated_windows(data, starts), starts - offsets[row], row)
        start = table.column("_first").to_numpy()[at] + first
        return pa.RecordBatch.from_arrays(
            [pa.array(table.column("_d").to_numpy()[at]), pa.array(table.column("_h").to_numpy()[at]), pa.array(start), pa.array(start + (last - first) + LENGTH)], ["_d", "_h", "_start", "_end"]
        )

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in slices(batches, "_bytes", TOGETHER):
            held.append(batch)
            size += batch.nbytes
            if size < TOGETHER:
                continue
            table = pa.Table.from_batches(held)
            buckets = table.column("_bucket").to_numpy()
            cut = int(np.searchsorted(buckets, buckets[-1]))  # the last bucket may go on
            held, size = table.slice(cut).to_batches(), table.slice(cut).nbytes
            if cut:
                yield compare(table.slice(0, cut))
        if held:
            yield compare(pa.Table.from_batches(held))

    return batched(rows.repartition("_bucket").sortWithinPartitions("_bucket")).mapInArrow(run, "_d long, _h int, _start long, _end long")


def text_bytes_of_binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) for each row, and with ``with_kept`` the binary ``kept``."""
    own = docs.select(
        F.col(id_col), F.xxhash64(F.col(id_col).cast("string"), F.lit("id"), text_col).alias("_d"), F.hash(text_col).alias("_h"), F.coalesce(text_col, F.lit("")).alias("_text")
    )
    rows = stored(block_rows(own.where(F.octet_length("_text") >= LENGTH).select("_d", "_h", "_text")))
    # Counts are written before they are joined, so that either side of the join is an exchange whose hot keys can be split.
    shared = stored(rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_c"), F.min("_rank").alias("_low"), F.max("_rank").alias("_high")).where("_c > 1").drop("_c"))
    meet = stored(rows.join(shared, "_bucket").withColumn("_same", F.col("_low") == F.col("_high")).drop("_low", "_high"))
    several = meet.where("not _same")
    code = F.xxhash64("_d", "_h", "_first")
    distinct = stored(several.groupBy("_bucket", "_rank").agg(F.count(F.lit(1)).alias("_n"), F.min(code).alias("_code")))
    large = stored(distinct.groupBy("_bucket").agg((F.count(F.lit(1)) > LARGE).alias("_large")))
    judged = stored(several.join(distinct, ["_bucket", "_rank"]).where((F.col("_n") > 1) | (F.col("_code") == code)).withColumn("_one", F.col("_code") == code).drop("_code", "_same"))
    whole = meet.where("_same").select("_d", "_h", "_first", "_last").unionByName(judged.where("_n > 1").select("_d", "_h", "_first", "_last"))
    chosen = judged.where("_one").join(large, "_bucket")

    packed = _packed(own, id_col)
    ordinary, hashed = _doubtful(packed, chosen.where("not _large"), False), _doubtful(packed, chosen.where("_large"), True)
    windows = hashed.select("_d", "_h", "_bucket", F.posexplode("_hashes").alias("_i", "_w"), "_first").withColumn("_start", F.col("_first") + F.col("_i"))
    twice = windows.groupBy("_bucket", "_w").agg(F.count(F.lit(1)).alias("_k")).where("_k > 1").select("_bucket", "_w")
    spans = (
        whole.select("_d", "_h", F.col("_first").alias("_start"), (F.col("_last") + LENGTH).alias("_end"))
        .unionByName(_repeats_in_buckets(ordinary))
        .unionByName(windows.join(twice, ["_bucket", "_w"]).select("_d", "_h", "_start", (F.col("_start") + LENGTH).alias("_end")))
    )
    lists = spans.groupBy("_d", "_h").agg(F.collect_list(F.struct("_start", "_end")).alias("_spans"))
    joined = packed.join(lists, ["_d", "_h"], "left").select(id_col, "_size", "_zip", "_spans")

    def cut(batches):
        for batch in batches:
            out: list[tuple] = []
            spans = batch.column("_spans")
            for i, (size, data) in enumerate(zip(batch.column("_size").to_pylist(), batch.column("_zip").to_pylist(), strict=True)):
                text = pa.decompress(data, size, "zstd", asbytes=True) if size else b""
                merged = _merged(spans[i])
                kept, at = [], 0
                for a, b in merged:
                    kept.append(text[at:a])
                    at = b
                kept = b"".join([*kept, text[at:]])
                out.append((size, size - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept if with_kept else None))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: 4 + with_kept]
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 4 + with_kept]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), *(pa.array([x[k] for x in out], t) for k, t in enumerate(kinds))], [id_col, *names])

    kind = docs.schema[id_col].dataType.simpleString()
    return batched(joined).mapInArrow(cut, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept)


def _packed(own: DataFrame, id_col: str) -> DataFrame:
    """The texts, compressed one by one and dealt by their key: one exchange for both uses."""

    def run(batches):
        for part in slices(batches, "_text"):
            raw = [t.encode("utf-8", "surrogatepass") for t in part.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(id_col), part.column("_d"), part.column("_h"), pa.array(list(map(len, raw)), pa.int64()), pa.array([pa.compress(t, "zstd", asbytes=True) if t else b"" for t in raw], pa.binary())],
                [id_col, "_d", "_h", "_size", "_zip"],
            )

    kind = own.schema[id_col].dataType.simpleString()
    return batched(own).mapInArrow(run, f"`{id_col}` {kind}, _d long, _h int, _size long, _zip binary").repartition("_d", "_h")


def _merged(spans: pa.Scalar) -> list[tuple[int, int]]:
    if not spans.is_valid:
        return []
    values = spans.values
    a, b = values.field(0).to_numpy(), values.field(1).to_numpy()
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
    return list(zip(a[new].tolist(), b[np.concatenate([new[1:] - 1, [len(b) - 1]])].tolist(), strict=True))


#: The same rows by counting all windows, in hexadecimal.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT k, i, md5(substr(h, 2 * i + 1, {2 * LENGTH})) AS m FROM (SELECT k, h, unnest(range(0, length(h) // 2 - {LENGTH - 1})) AS i FROM d)),
t AS (SELECT m FROM w GROUP BY m HAVING count(*) > 1),
f AS (SELECT k, i, (i > lag(i) OVER (PARTITION BY k ORDER BY i) + {LENGTH})::INT AS new FROM w WHERE m IN (SELECT m FROM t)),
g AS (SELECT k, i, sum(coalesce(new, 0)) OVER (PARTITION BY k ORDER BY i) AS part FROM f),
s AS (SELECT k, min(i) AS a, max(i) + {LENGTH} AS b FROM g GROUP BY k, part),
p AS (SELECT k, a, b, coalesce(lag(b) OVER (PARTITION BY k ORDER BY a), 0) AS after FROM s),
r AS (SELECT p.k, count(*) AS n, sum(b - a) AS removed, string_agg(substr(h, 2 * after + 1, 2 * (a - after)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM p JOIN d ON d.k = p.k GROUP BY p.k)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN r ON r.k = d.k
"""
