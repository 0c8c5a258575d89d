import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from corvane.llm import suffix_dedup as S


def brute(rows):
    texts = [(t or "").encode() for _, t in rows]
    count = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    out = []
    for (d, _), t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if count[t[i : i + 200]] > 1:
                gone[i : i + 200] = b"\x01" * 200
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(9)
    text = lambda n: "".join(r.choice("abcdefg é漢 ") for _ in range(n))
    passages = [text(n) for n in (199, 200, 150, 230, 260, 400, 900)]
    out = []
    for i in range(160):
        parts = []
        for _ in range(r.randrange(4)):
            parts.append(text(r.choice([0, 3, 90, 250])))
            p = r.choice(passages)
            parts.append(p if r.random() < 0.6 else p[r.randrange(60) : len(p) - r.randrange(60)])
        out.append((i, "".join(parts)))
    out += [(300 + i, "head" + str(i) * 3 + passages[6] + text(30)) for i in range(60)]
    out += [(i + 500, out[i][1]) for i in range(20)] + [(7, out[7][1]), (8, "other " + out[9][1])]
    return out + [(900, None), (901, ""), (902, "x" * 199), (903, "y" * 200), (904, "z" * 201), (905, "ab" * 400), (906, text(300) * 2), (None, text(500)), (None, passages[4])]


@pytest.mark.parametrize(("large", "segment"), [(8_000, 1 << 16), (3, 700)])
def test_equals_brute_force(spark, rows, large, segment, monkeypatch):
    monkeypatch.setattr(S, "LARGE", large)
    monkeypatch.setattr(S, "SEGMENT", segment)
    d = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, n_bytes int")
    assert sorted(map(tuple, S.remove_repeats(d).collect()), key=str) == brute(rows)


def test_windows_are_confirmed_on_bytes(monkeypatch):
    r = np.random.default_rng(3)
    data = r.integers(97, 99, 3000).astype(np.uint8)
    data[1500:2000] = data[100:600]
    starts = np.flatnonzero(r.random(len(data) - 199) < 0.9)
    count = Counter(data[i : i + 200].tobytes() for i in starts)
    want = [count[data[i : i + 200].tobytes()] > 1 for i in starts]
    assert any(want) and S.repeated_windows(data, starts).tolist() == want
    rank = S.window_ranks(data)
    order = sorted(range(len(rank)), key=lambda i: data[i : i + 200].tobytes())
    assert (np.diff(rank[order]) >= 0).all()
    hashes = S.window_hashes
    monkeypatch.setattr(S, "window_hashes", lambda d: (hashes(d)[0], hashes(d)[1] & np.uint64(3 << 40)))  # nearly all collide
    assert S.repeated_windows(data, starts).tolist() == want


def test_empty_and_short_tables(spark):
    d = spark.createDataFrame([(1, "short"), (2, None)], "doc_id long, text string")
    assert sorted(tuple(r)[:4] for r in S.remove_repeats(d).collect()) == [(1, 5, 0, 0), (2, 0, 0, 0)]
    assert S.remove_repeats(d.limit(0)).count() == 0
    assert {bytes(r.kept) for r in S.remove_repeats(d, with_kept=True).collect()} == {b"short", b""}
