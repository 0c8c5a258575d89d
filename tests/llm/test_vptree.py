import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import vptree


def brute(rows, is_query, k):
    ok = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            ok.setdefault((i, tuple(np.float32(v).astype(float))), None)
    out = []
    for i, q in sorted({x for x in ok if is_query(x[0])}):
        near = []
        for j, v in ok:
            if j != i and len(v) == len(q):
                a, b = np.array(q), np.array(v)
                near.append((-(a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())), j))
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(near)[:k])]
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    out = [(i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(1500)]
    same = rng.normal(size=16).astype(np.float32).tolist()
    out += [(2000 + i, same) for i in range(300)]
    out += [(3000, None), (3050, [0.0] * 16), (3100, [float("nan")] * 16), (3150, [None] + [1.0] * 15), (3200, [float("inf")] * 16), (None, same), (3250, []), (3300, [1.0, 2.0]), (3350, [2.0, 1.0]), (50, out[50][1])]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")


def test_factor_one_is_exact(spark, rows, monkeypatch):
    monkeypatch.setattr(vptree, "SHARD_ROWS", 100)
    monkeypatch.setattr(vptree, "BLOCK", 20)
    got = vptree.nearest(frame(spark, rows), F.col("vec_id") % 50 == 0, 5, factor=1.0).collect()
    want = brute(rows, lambda i: i % 50 == 0, 5)
    got = sorted(map(tuple, got))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=0, atol=1e-15)


def test_recall_of_the_production_factor(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want = {(q, j) for q, _, j, _ in brute(rows, lambda i: i % 50 == 0, 5)}
    got = {(r.query_id, r.vec_id) for r in vptree.nearest(df, F.col("vec_id") % 50 == 0).collect()}
    assert len(want & got) / len(want) >= 0.95


def clustered(n=6000, dim=24, centres=40):
    rng = np.random.default_rng(8)
    middle = rng.normal(size=(centres, dim))
    return middle[rng.integers(0, centres, n)] + rng.normal(size=(n, dim)) * 0.25


def test_bounds_hold_and_prune():
    """Leaves and sides are passed over where rows gather: exactly at factor 1, and far more at the tuned factor."""
    v = clustered()
    unit = vptree._unit(v)
    queries = np.arange(0, len(v), 60)
    chord = np.sqrt(np.maximum(2 - 2 * unit[queries] @ unit.T, 0))
    top = vptree.TopTree(unit, 16)
    leaf, bounds = top.leaf_of(unit), top.bounds(unit[queries])
    assert (bounds[:, leaf] <= chord + 1e-9).all() and len(np.unique(leaf)) == 16
    chord[np.arange(len(queries)), queries] = 9
    want = [set(x) for x in np.argsort(chord, axis=1)[:, :5].tolist()]
    factor = vptree.tuned_factor(v, 5)
    assert factor > 1
    recall, share, visited = {}, {}, {}
    for f in (1.0, factor):
        found, share[f], visited[f] = vptree.in_memory(v, queries, 5, f, 375)
        recall[f] = np.mean([len(w & set(x)) / 5 for w, x in zip(want, found, strict=True)])
    assert recall[1.0] == 1 and recall[factor] >= 0.93
    assert share[factor] < 0.3 and share[factor] < 0.7 * share[1.0] and visited[factor] < 0.6


@pytest.mark.parametrize("dim", [2, 8, 32])
def test_the_factor_follows_the_vectors(dim):
    v = np.random.default_rng(dim).normal(size=(4000, dim))
    queries = np.arange(7, len(v), 40)
    cosine = vptree._unit(v)[queries] @ vptree._unit(v).T
    cosine[np.arange(len(queries)), queries] = -9
    want = [set(x) for x in np.argsort(-cosine, axis=1)[:, :5].tolist()]
    found, *_ = vptree.in_memory(v, queries, 5, vptree.tuned_factor(v, 5))
    assert np.mean([len(w & set(x)) / 5 for w, x in zip(want, found, strict=True)]) >= 0.93


def test_recall_on_gathered_rows(spark, monkeypatch):
    monkeypatch.setattr(vptree, "SHARD_ROWS", 300)
    rows = [(i, x) for i, x in enumerate(clustered(3000).astype(np.float32).tolist())]
    want = {(q, j) for q, _, j, _ in brute(rows, lambda i: i % 50 == 0, 5)}
    got = {(r.query_id, r.vec_id) for r in vptree.nearest(frame(spark, rows), F.col("vec_id") % 50 == 0).collect()}
    assert len(want & got) / len(want) >= 0.9


def test_few_or_no_rows(spark, rows):
    assert vptree.nearest(frame(spark, rows[:1]), F.lit(True)).count() == 0
    assert vptree.nearest(frame(spark, []), F.lit(True)).count() == 0
    assert vptree.nearest(frame(spark, rows[:3]), F.col("vec_id") == 0).count() == 2
