import math
import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from corvane.llm import whitening

random.seed(11)


def exact(vectors, scale=64, shift=1_000_000):
    """n, deviations and covariance by fractions."""
    x = [[math.floor(scale * float(c)) + shift for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    y = [[n * r[j] - s[j] for j in range(d)] for r in x]
    v = [[Fraction(sum(r[i] * r[j] for r in y), n**3) for j in range(d)] for i in range(d)]
    return x, y, v


def odd_rows():
    good = [[random.gauss(0, 3) * (1 + j) for j in range(6)] for _ in range(300)]
    good += good[:7] + [[0.0] * 6, [1e6, -1e6, 3.0, 0.0, 0.5, 0.25]]
    rows = [(i, v, 3, "x") for i, v in enumerate(good)]
    bad = [None, [], [1.0, None, 2.0, 1.0, 1.0, 1.0], [float("nan")] * 6, [1.0, 2.0, float("inf"), 0.0, 0.0, 0.0]]
    rows += [(1000 + i, v, 3, "x") for i, v in enumerate(bad)]
    rows += [(2000 + i, [random.random() * 100, random.random()], 3, "x") for i in range(40)]  # another length
    rows += [(3000, [5.0, 5.0, 5.0], 3, "x"), (3001, [5.0, 5.0, 5.0], 3, "x")]  # no variance
    return rows


@pytest.mark.parametrize("kind", ["double", "float"])
def test_equals_exact_arithmetic(spark, kind):
    rows = odd_rows()
    table = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, n int, component string").repartition(5)
    got = {(r.vec_id, r.component): r for r in whitening.whiten(table, whitening.fit(table)).collect()}
    cast = float if kind == "double" else lambda c: float(np.float32(c))
    for low, high, d in ((0, 1000, 6), (2000, 3000, 2)):
        own = [(i, [cast(c) for c in v]) for i, v, *_ in rows if low <= i < high]
        x, y, v = exact([r[1] for r in own])
        n = len(own)
        values, vectors = np.linalg.eigh(np.array([[float(c) for c in r] for r in v]))
        trace = float(sum(v[j][j] for j in range(d)))
        first = np.argsort(-values)
        for (i, _), of in zip(own, y, strict=True):
            for k in range(1, d + 1):
                r = got[i, k]
                square = sum(c * c for c in of)
                assert (r.n, r.deviation) == (n, square if square < 1 << 63 else None)
                e, u = values[first[k - 1]], vectors[:, first[k - 1]]
                wanted = sum(float(Fraction(c, n)) * t for c, t in zip(of, u, strict=True)) / math.sqrt(e)
                assert abs(abs(r.whitened) - abs(wanted)) < 1e-7 * (1 + abs(wanted)) and abs(r.explained - e / trace) < 1e-9
                assert r.identity_error < 1e-7
        assert sum(low <= i < high for i, _ in got) == n * d
    flat = [got[i, k] for i in (3000, 3001) for k in (1, 2, 3)]
    assert all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 for r in flat)
    assert not any(1000 <= i < 2000 for i, _ in got)


def test_limb_products_are_exact():
    rng = np.random.default_rng(1)
    for top in (5, 1 << 19, (1 << 33) + 7, 1 << 61):
        y = rng.integers(-top, top + 1, (whitening.ROWS, 3))
        y[0] = [top, -top, 0]
        wanted = y.astype(object).T @ y.astype(object)
        assert (whitening.whole(whitening.gram(y)) == wanted).all()
        total = None
        for _ in range(40):
            total = whitening.added(total, whitening.gram(y))
        assert (whitening.whole(total) == 40 * wanted).all() and len(total) < 12
    big = y.astype(object) * (1 << 40)
    assert (whitening.whole(whitening.gram(big)) == big.T @ big).all()


def test_centring_and_deviations_of_any_size():
    x = np.array([[1 << 61, 5], [-(1 << 61), 6], [3, 8]], np.int64)
    sums = [int(c) for c in x.astype(object).sum(0)]
    y = whitening.centred(x, 3, sums)
    assert y.tolist() == [[3 * int(c) - s for c, s in zip(r, sums, strict=True)] for r in x]
    assert whitening.deviations(y) == [None, None, sum(int(c) ** 2 for c in y[2])]
    assert whitening.deviations(np.array([[3, 4], [0, -2]])) == [25, 4]


def test_vectors_are_refined():
    rng = np.random.default_rng(2)
    q, _ = np.linalg.qr(rng.normal(size=(12, 12)))
    values = np.array([1 + 1e-7 * k for k in range(12)])
    v = (q * values) @ q.T
    v = ((v + v.T) / 2).astype(np.longdouble)
    _, x = np.linalg.eigh(v.astype(float))
    _, better = whitening.refined(v, x.astype(np.longdouble))
    off = lambda z: np.abs((z.T @ v @ z) - np.diag(np.diag(z.T @ v @ z))).max()
    assert off(better) < off(x.astype(np.longdouble)) / 50


def test_rows_of_blocks(monkeypatch):
    monkeypatch.setattr(whitening, "ROWS", 2)
    batch = pa.RecordBatch.from_pydict({"v": pa.array([[1.0], None, [2.0, 3.0], [4.0], [], [None], [5.0], [1e300]], pa.list_(pa.float64()))})
    got = [(rows.tolist(), x.tolist()) for _, rows, x in whitening.blocks([batch.slice(0, 8), batch.slice(6, 1)], "v", 1, 0)]
    assert got == [([0, 3], [[1], [4]]), ([6, 7], [[5], [1 << 62]]), ([2], [[2, 3]]), ([0], [[5]])]


def test_empty_table(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert whitening.whiten(none, whitening.fit(none)).collect() == []
