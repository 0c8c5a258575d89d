"""64-bit SimHash of character 3-grams by an Arrow function."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

N = 3
#: Characters of texts whose n-grams are looked up together.
_TOGETHER = 1 << 18
#: Distinct n-grams of one text whose bits are added up together.
_ROWS = 1 << 14
#: N-grams whose hashes a worker keeps for its next texts, 16 bytes each.
_KEPT = 1 << 18
#: Most bytes of texts that a worker gets at once; the default bounds rows alone in effect.
_BATCH, _BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
_POINT = 21  # bits of a code point, of which a gram has three


def _grams(text: str) -> np.ndarray:
    """The 3-grams of a text as numbers, a code point behind the other."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(c) < N:
        return np.zeros(0, np.uint64)
    return (c[:-2] << np.uint64(2 * _POINT)) | (c[1:-1] << np.uint64(_POINT)) | c[2:]


def _digests(grams: np.ndarray) -> np.ndarray:
    """The low 64 bits of each gram's MD5, as rows of 8 bytes; surrogates that no text can encode count as themselves."""
    mask = np.uint64((1 << _POINT) - 1)
    points = np.column_stack([grams >> np.uint64(2 * _POINT), (grams >> np.uint64(_POINT)) & mask, grams & mask]).astype("<u4")
    texts = points.tobytes().decode("utf-32-le", "surrogatepass")
    digests = b"".join(hashlib.md5(texts[i : i + N].encode("utf-8", "surrogatepass")).digest()[8:] for i in range(0, len(texts), N))
    return np.frombuffer(digests, np.uint8).reshape(-1, 8)


#: The sorted grams that this worker keeps, and their hashes.
_kept: tuple[np.ndarray, np.ndarray] = np.zeros(0, np.uint64), np.zeros((0, 8), np.uint8)


def _known(grams: np.ndarray) -> np.ndarray:
    """:func:`_digests` of sorted distinct grams, of which those kept from earlier texts aren't hashed again."""
    global _kept
    have, digests = _kept
    at = np.minimum(np.searchsorted(have, grams), max(len(have) - 1, 0))
    new = have[at] != grams if len(have) else np.ones(len(grams), bool)
    out = np.empty((len(grams), 8), np.uint8)
    out[~new] = digests[at[~new]]
    out[new] = _digests(grams[new])
    if len(have) + int(new.sum()) <= _KEPT:
        place = np.searchsorted(have, grams[new])
        _kept = np.insert(have, place, grams[new]), np.insert(digests, place, out[new], axis=0)
    else:
        _kept = grams[:_KEPT].copy(), out[:_KEPT].copy()
    return out


def _hashes(texts: list[str]) -> np.ndarray:
    counted = [np.unique(_grams(t), return_counts=True) for t in texts]
    known = np.unique(np.concatenate([g for g, _ in counted])) if counted else np.zeros(0, np.uint64)
    digests = _known(known)
    out = np.full(len(texts), -1, np.int64)
    for i, (grams, counts) in enumerate(counted):
        if len(grams):
            weight, place = counts.astype(np.float64), np.searchsorted(known, grams)  # whole numbers, exact in double precision
            votes = sum(weight[k : k + _ROWS] @ np.unpackbits(digests[place[k : k + _ROWS]], axis=1) for k in range(0, len(grams), _ROWS))
            out[i] = np.packbits(2 * votes >= weight.sum()).view(">i8")[0]
    return out


def simhash64(text: Column) -> Column:
    """Bit b is 1 unless more of the 3-grams' MD5 values (low 64 bits) have it 0; a text without 3-grams gives -1.

    Blanks are left out, a null text reads as ``None``. Each distinct 3-gram of some texts is hashed once for all of them. The session's Arrow batches are
    bounded to 4 MB from now on, unless a smaller bound is set.
    """
    spark = SparkSession.getActiveSession()
    if spark is not None:
        now = spark.conf.get(_BATCH).lower().rstrip("b")
        if now.isdigit() and int(now) > _BATCH_BYTES:
            spark.conf.set(_BATCH, str(_BATCH_BYTES))

    @F.pandas_udf("long")
    def run(column: pd.Series) -> pd.Series:
        texts = ["".join(t.split()) if t is not None else "None" for t in column]
        ends = np.cumsum([len(t) + 1 for t in texts])
        out, at = [np.zeros(0, np.int64)], 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _TOGETHER, side="right")))
            out.append(_hashes(texts[at:stop]))
            at = stop
        return pd.Series(np.concatenate(out))

    # Filters on the hash would else take the function with them and compute it once more.
    return run.asNondeterministic()(text)
