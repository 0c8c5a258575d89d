"""Shared helpers: Arrow slices of bounded bytes, hold-out rules, checkpoints, safe text pieces."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.materialise import stored as stored

#: Most text bytes that one slice hands to a Python function, unless a single text is longer.
SLICE_BYTES = 4 << 20

ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """True where crc32 of the id's decimal text leaves ``remainder``; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus == remainder, F.lit(False))


def byte_lengths(column: pa.Array) -> np.ndarray:
    """UTF-8 length of each text; null counts as 0."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def slices(batches: Iterable[pa.RecordBatch], text: str, most: int = SLICE_BYTES, tidy: bool = True) -> Iterator[pa.RecordBatch]:
    """Cut record batches into runs of rows whose texts hold about ``most`` bytes together.

    At the end of the task, with ``tidy``, the worker's unused memory goes back to the system, since workers live on between stages.
    """
    lean()
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(byte_lengths(batch.column(text)))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
        del batch
    if tidy:
        trim()


#: Most bytes of an Arrow batch between the JVM and a worker.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def batched(df: DataFrame) -> DataFrame:
    """``df``, whose session from now on bounds Arrow batches by bytes; a smaller bound that is set already stays.

    The default bounds rows alone in effect, so that batches of long texts hold more than a worker's share of memory.
    """
    conf = df.sparkSession.conf
    now = conf.get(_BATCH).lower().rstrip("b")
    if now.isdigit() and int(now) > BATCH_BYTES:
        conf.set(_BATCH, str(BATCH_BYTES))
    return df


_lean = False


def lean() -> None:
    """Let a worker's large arrays come from the system and go back to it when they are freed.

    Otherwise the allocator raises its thresholds with the first large array and keeps all that follow, for as long as the worker lives.
    Arrays of a few MB are kept for the next ones, which costs less than asking the system for zeroed pages each time.
    """
    global _lean
    if not _lean:
        _lean = True
        with contextlib.suppress(OSError, AttributeError):
            libc = ctypes.CDLL("libc.so.6")
            libc.mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD
            libc.mallopt(-1, 32 << 20)  # M_TRIM_THRESHOLD
        pa.set_memory_pool(pa.system_memory_pool())


def trim() -> None:
    """Give freed memory back to the system where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The concatenated UTF-8 bytes of a string column and each row's offsets into them; null is empty."""
    import pyarrow.compute as pc

    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text")))


#: A run of blanks with the run of other characters after it. Between two such pieces the left
#: neighbour is no white space and the right one is, where byte-level pre-tokenizers always cut.
_PIECES = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
#: White space on which libraries differ: no cut is made after it.
_ODD_BLANK = re.compile(r"[^\S \t\n\r]")
#: Between a letter and a sentence's punctuation they cut too.
_LETTER_THEN_SIGN = re.compile(r"(?<=[A-Za-z\u3041-\u3096\u30a1-\u30fa\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7a3])(?=[,.;:?!()\u3001\u3002\uff0c\uff1a\uff1b\uff1f\uff01\uff08\uff09\u300c\u300d])")
_LONG_PIECE = 256


def safe_pieces(text: str) -> list[str]:
    """Split ``text`` where every byte-level pre-tokenizer splits it too; concatenation gives it back.

    It is cut before blanks, tabs and line ends, unless other white space stands there; what is still long, such as text in scripts
    without blanks, is cut before the punctuation that follows a letter.
    """
    if not text:
        return []
    pieces = _PIECES.findall(text)
    if _ODD_BLANK.search(text):
        joined: list[str] = []
        open_ = False
        for p in pieces:
            if open_:
                joined[-1] += p
            else:
                joined.append(p)
            open_ = bool(_ODD_BLANK.match(p[-1]))
        pieces = joined
    if len(text) > _LONG_PIECE and max(map(len, pieces)) > _LONG_PIECE:
        return [q for p in pieces for q in (_LETTER_THEN_SIGN.split(p) if len(p) > _LONG_PIECE else (p,))]
    return pieces


def bounded_sample(rows: DataFrame, class_col: str, most: int, *key_cols: str, rank: str | None = None, size: Column | None = None, most_bytes: int = 0) -> DataFrame:
    """At most ``most`` rows of each class, those with the smallest hash of ``key_cols``; with ``size`` no more of them than those
    whose sizes come to ``most_bytes``, and one at least. ``rank`` names a column for their places from 1.

    The classes are counted first, so that a hash threshold thins every partition before the exact
    cut; what is ranked is about 1.25 times the bound for each class, whatever the input's size.
    """
    from pyspark.sql import Window

    counts = [r for r in rows.where(F.col(class_col).isNotNull()).groupBy(class_col).count().collect()]
    if not counts:
        return rows.limit(0).withColumn(rank, F.lit(0)) if rank else rows.limit(0)
    place = F.pmod(F.xxhash64(F.lit("sample"), *key_cols), F.lit(1 << 30)) / float(1 << 30)
    wanted = F.lit(False)
    for r in counts:
        share = min(1.0, (1.25 * most + 40) / r["count"])
        wanted = wanted | ((F.col(class_col) == r[class_col]) & (place < share))
    order = Window.partitionBy(class_col).orderBy(place, *key_cols)
    ranked = rows.where(wanted).withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= most)
    if size is not None:
        before = Window.partitionBy(class_col).orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)
        ranked = ranked.withColumn("_before", F.coalesce(F.sum(F.coalesce(size, F.lit(0))).over(before), F.lit(0))).where(F.col("_before") < most_bytes).drop("_before")
    return ranked.withColumnRenamed("_rank", rank) if rank else ranked.drop("_rank")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each 64-bit number: shifts and products, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distinct_words(column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct lower-case words (runs of letters and marks) of the texts, each word's code in text
    order, and the rows' offsets into the codes. Rows without words hold the empty word."""
    import pyarrow.compute as pc

    lower = pc.utf8_lower(pc.fill_null(column, "").cast(pa.large_string()))
    parts = pc.split_pattern(pc.utf8_trim(pc.replace_substring_regex(lower, r"[^\pL\pM]+", " "), " "), " ")
    offsets = parts.offsets.to_numpy() - parts.offsets[0].as_py()
    coded = parts.flatten().dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False), offsets.astype(np.int64)


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over each row's run; every run holds at least one value."""
    return np.add.reduceat(values, offsets[:-1], axis=0) if len(offsets) > 1 else values[:0]
