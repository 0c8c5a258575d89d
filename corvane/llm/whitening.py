"""Whitening of embeddings with exact integer statistics.

Entries become whole numbers, ``floor(scale * c) + shift``. One pass sums them. The second one centres them without loss (y = n x - S), splits
y into limbs of ``LIMB`` bits and multiplies the limbs block by block with double-precision BLAS: a block has at most ``ROWS`` rows, so
every product and sum stays below 2^53 and is exact. Products of limbs are recombined as numbers of digits with carries, tasks' sums are merged as
such, and the driver reads at most ``MERGED`` of them for each dimension, each of the square of the dimension. The exact covariance is then decomposed, and its
eigenvectors are refined in extended precision. A third pass measures the covariance of what is whitened, a fourth one gives the result.

Vectors of several lengths are fitted apart: each length has its own fit list, n, sums and components.

Defined results: vectors that are null, empty or hold null or non-finite entries take no part; entries are clipped at 2^62 after scaling, which no
long could hold otherwise; a deviation that no long holds is null; a component without variance (its eigenvalue is not above ``NOTHING`` times
the trace) has a null ``whitened``; one vector alone, or equal ones, have null ``explained`` too; repeated rows count and come out as often as they
are there; an empty table gives an empty result; columns besides id and vector are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import batched, lean, trim

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Bits of a limb and rows of a block: 2^LIMB squared times ROWS is 2^53.
LIMB, ROWS = 20, 1 << 13
#: Most partial sums that the driver reads for each dimension.
MERGED = 16
NOTHING = 1e-14
_MOST = 1 << 62


def blocks(batches: Iterable[pa.RecordBatch], vec_col: str, scale: int, shift: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(batch, row numbers, x) for rows of one length at a time, ``ROWS`` at most; x holds longs."""
    lean()
    for batch in batches:
        column = batch.column(vec_col)
        sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = column.flatten().cast(pa.float64())  # leaves null lists out
        values = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False)
        starts = np.cumsum(sizes) - sizes
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
        good = (sizes > 0) & (bad[starts + sizes] == bad[starts])
        for d in np.unique(sizes[good]):
            rows = np.flatnonzero(good & (sizes == d))
            for at in range(0, len(rows), ROWS):
                some = rows[at : at + ROWS]
                with np.errstate(over="ignore"):
                    scaled = np.floor(scale * values[starts[some, None] + np.arange(d)])
                yield batch, some, np.clip(scaled, -float(_MOST), float(_MOST)).astype(np.int64) + shift
    trim()


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S: longs where they hold it, else whole numbers of any size."""
    means = [s // n for s in sums]
    rest = np.array([s - n * m for s, m in zip(sums, means, strict=True)], object)
    least, most = x.min(0), x.max(0)
    far = max(max(abs(int(a) - m), abs(int(b) - m)) for a, b, m in zip(least, most, means, strict=True))
    if (far + 1) * n < _MOST:
        return n * (x - np.array(means, np.int64)) - rest.astype(np.int64)
    return n * (x.astype(object) - np.array(means, object)) - rest


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """Arrays of doubles below 2^LIMB in size, y being their sum with weights 2^(LIMB k)."""
    size, sign = np.abs(y), np.where(y < 0, -1.0, 1.0)
    out = []
    while not out or size.any():
        out.append((size & ((1 << LIMB) - 1)).astype(np.float64) * sign)
        size = size >> LIMB
    return out


def carried(digits: np.ndarray) -> np.ndarray:
    """The same numbers with all digits but the last in [0, 2^LIMB); the last one takes in what is above it while that is small."""
    out = np.concatenate([digits, np.zeros((3, *digits.shape[1:]), np.int64)])
    for k in range(len(out) - 1):
        over = out[k] >> LIMB
        out[k] -= over << LIMB
        out[k + 1] += over
    used = len(out)
    while used > 1 and np.abs(out[used - 1]).max(initial=0) < 1 << LIMB:
        out[used - 2] += out[used - 1] << LIMB
        used -= 1
    return out[:used]


def added(a: np.ndarray | None, b: np.ndarray) -> np.ndarray:
    if a is None:
        return carried(b)
    out = np.zeros((max(len(a), len(b)), *b.shape[1:]), np.int64)
    out[: len(a)] += a
    out[: len(b)] += b
    return carried(out)


def gram(y: np.ndarray) -> np.ndarray:
    """Digits of y'y: exact products of limbs, those of one weight added."""
    parts = limbs(y)
    out = np.zeros((2 * len(parts) - 1, y.shape[1], y.shape[1]), np.int64)
    for i, p in enumerate(parts):
        for j in range(i, len(parts)):
            product = (p.T @ parts[j]).astype(np.int64)
            out[i + j] += product if i == j else product + product.T
    return out


def whole(digits: np.ndarray) -> np.ndarray:
    """Numbers of any size from their digits."""
    return sum((digits[k].astype(object) << (LIMB * k) for k in range(len(digits))), np.zeros(digits.shape[1:], object))


@dataclass
class Whitening:
    """What the vectors of one length need: n and sums as whole numbers, eigenvalues (falling), unit eigenvectors in columns, shares of the trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    identity_error: float | None = None

    def whiten(self, y: np.ndarray) -> np.ndarray:
        live = np.isfinite(self.values)
        out = np.full((len(y), len(self.values)), np.nan)
        out[:, live] = (y.astype(np.float64) @ self.vectors[:, live]) / (self.n * np.sqrt(self.values[live]))
        return out


def refined(v: np.ndarray, x: np.ndarray, steps: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of ``v`` (extended precision) from approximate vectors, each step squaring their error."""
    one = np.eye(len(v), dtype=v.dtype)
    for _ in range(steps):
        off = one - x.T @ x
        s = x.T @ v @ x
        values = np.diag(s) / (1 - np.diag(off))
        apart = values[None, :] - values[:, None]
        unsure = 2 * (np.abs(s - np.diag(values)).max() + np.abs(v).max() * np.abs(off).max())
        far = np.abs(apart) > unsure
        turn = np.where(far, (s + values[None, :] * off) / np.where(far, apart, 1), 0)
        # Turning keeps lengths and angles; what these lack is mended apart from it, so that close values don't spoil them.
        x = x + x @ ((turn - turn.T) / 2 + off / 2)
    return values, x


def decompose(n: int, sums: list[int], total: np.ndarray, components: int) -> Whitening:
    """From n, the sums, and the exact sum of y y', which is n^3 times the covariance."""
    cube, d = n**3, len(sums)
    high = np.array([[int(c) / cube for c in row] for row in total])
    low = np.empty_like(high)
    for i in range(d):
        for j in range(d):
            p, q = float(high[i, j]).as_integer_ratio()
            low[i, j] = (int(total[i, j]) * q - p * cube) / (q * cube)
    trace = sum(int(total[i, i]) for i in range(d)) / cube
    values, vectors = np.linalg.eigh(high)
    if trace > 0:
        values, vectors = refined(high.astype(np.longdouble) + low, vectors.astype(np.longdouble))
    order = np.argsort(-values, kind="stable")[:components]
    values = values[order].astype(np.float64)
    vectors = vectors[:, order].astype(np.float64)
    explained = values / trace if trace > 0 else np.full(len(order), np.nan)
    return Whitening(n, sums, np.where(values > NOTHING * trace, values, np.nan) if trace > 0 else np.full(len(order), np.nan), vectors, explained)


def _partial(vectors: DataFrame, run, fields: str) -> DataFrame:
    return batched(vectors).mapInArrow(run, fields)


def _sums(vectors: DataFrame, vec_col: str, scale: int, shift: int) -> dict[int, tuple[int, list[int]]]:
    """n and the sums of x for each length: halves of 32 bits are summed apart, within tasks and then by Spark."""

    def run(batches):
        found: dict[int, list] = {}
        for _, rows, x in blocks(batches, vec_col, scale, shift):
            own = found.setdefault(x.shape[1], [0, np.zeros(x.shape[1], np.int64), np.zeros(x.shape[1], np.int64)])
            own[0] += len(rows)
            own[1] += (x & 0xFFFFFFFF).sum(0)
            own[2] += (x >> 32).sum(0)
        for d, (n, low, high) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(low), pa.array(high)], ["d", "i", "n", "low", "high"])

    parts = _partial(vectors, run, "d int, i int, n long, low long, high long")
    big = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    out: dict[int, tuple[int, list[int]]] = {}
    for r in parts.groupBy("d", "i").agg(F.sum("n").alias("n"), big("low"), big("high")).orderBy("d", "i").collect():
        out.setdefault(r["d"], (r["n"], []))[1].append((int(r["high"]) << 32) + int(r["low"]))
    return out


def _covariances(vectors: DataFrame, vec_col: str, scale: int, shift: int, sums: dict[int, tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """The exact sum of y y' for each length."""
    fields = "d int, part int, digits array<long>"

    def emit(found):
        for d, digits in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([digits.ravel()], pa.list_(pa.int64()))], ["d", "part", "digits"])

    def run(batches):
        found: dict[int, np.ndarray] = {}
        for _, _, x in blocks(batches, vec_col, scale, shift):
            d = x.shape[1]
            found[d] = added(found.get(d), gram(centred(x, *sums[d])))
        yield from emit(found)

    def merge(batches):
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, digits in zip(batch.column("d").to_pylist(), batch.column("digits"), strict=True):
                found[d] = added(found.get(d), digits.values.to_numpy().reshape(-1, d, d))
        yield from emit(found)

    parts = _partial(vectors, run, fields).repartition(MERGED, "part").mapInArrow(merge, fields)
    total: dict[int, np.ndarray] = {}
    for r in parts.toLocalIterator():
        total[r["d"]] = added(total.get(r["d"]), np.array(r["digits"], np.int64).reshape(-1, r["d"], r["d"]))
    return {d: whole(digits) for d, digits in total.items()}


def _joined(a: tuple | None, b: tuple) -> tuple:
    """(n, mean, centred products) of two lists of rows together."""
    if a is None:
        return b
    n, gap = a[0] + b[0], b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def _identity_errors(vectors: DataFrame, vec_col: str, scale: int, shift: int, models: dict[int, Whitening]) -> dict[int, float | None]:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, over the components with variance."""
    fields = "d int, part int, n long, mean array<double>, products array<double>"

    def emit(found):
        for d, (n, mean, products) in found.items():
            lists = [pa.array([v.ravel()], pa.list_(pa.float64())) for v in (mean, products)]
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n], pa.int64()), *lists], ["d", "part", "n", "mean", "products"])

    def run(batches):
        found: dict[int, tuple] = {}
        for _, _, x in blocks(batches, vec_col, scale, shift):
            model = models[x.shape[1]]
            w = model.whiten(centred(x, model.n, model.sums))[:, np.isfinite(model.values)]
            mean = w.mean(0)
            found[x.shape[1]] = _joined(found.get(x.shape[1]), (len(w), mean, (w - mean).T @ (w - mean)))
        yield from emit(found)

    def merge(batches):
        found: dict[int, tuple] = {}
        for batch in batches:
            for r in batch.to_pylist():
                k = len(r["mean"])
                found[r["d"]] = _joined(found.get(r["d"]), (r["n"], np.array(r["mean"]), np.array(r["products"]).reshape(k, k)))
        yield from emit(found)

    total: dict[int, tuple] = {}
    for r in _partial(vectors, run, fields).repartition(MERGED, "part").mapInArrow(merge, fields).toLocalIterator():
        k = len(r["mean"])
        total[r["d"]] = _joined(total.get(r["d"]), (r["n"], np.array(r["mean"]), np.array(r["products"]).reshape(k, k)))
    return {d: float(np.abs(p / n - np.eye(len(p))).max()) if len(p) else None for d, (n, _, p) in total.items()}


def fit(vectors: DataFrame, vec_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> dict[int, Whitening]:
    """A :class:`Whitening` for each length of vectors."""
    own = vectors.select(vec_col)
    sums = _sums(own, vec_col, scale, shift)
    totals = _covariances(own, vec_col, scale, shift, sums)
    models = {d: decompose(n, s, totals[d], components) for d, (n, s) in sums.items()}
    for d, error in _identity_errors(own, vec_col, scale, shift, models).items():
        models[d].identity_error = error
    return models


def deviations(y: np.ndarray) -> list[int | None]:
    """Sums of squares of the rows, exact; None where no long holds them."""
    if y.dtype != object and int(np.abs(y).max(initial=0)) ** 2 * y.shape[1] < _MOST:
        return (y * y).sum(1).tolist()
    sums = (y.astype(object) ** 2).sum(1)
    return [int(s) if s < 1 << 63 else None for s in sums]


def whiten(vectors: DataFrame, models: dict[int, Whitening], id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for each vector and component."""
    id_type = vectors.schema[id_col].dataType

    def run(batches):
        for batch, rows, x in blocks(batches, vec_col, scale, shift):
            model = models[x.shape[1]]
            y = centred(x, model.n, model.sums)
            w, k = model.whiten(y), len(model.values)
            each = np.repeat(rows, k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(id_col).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                    pa.array(np.full(len(each), model.n, np.int64)),
                    pa.array(deviations(y), pa.int64()).take(pa.array(np.repeat(np.arange(len(rows)), k))),
                    pa.array(w.ravel(), from_pandas=True),
                    pa.array(np.tile(model.explained, len(rows)), from_pandas=True),
                    pa.array([model.identity_error] * len(each), pa.float64()),
                ],
                [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    out = f"`{id_col}` {id_type.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return batched(vectors.select(id_col, vec_col)).mapInArrow(run, out)
