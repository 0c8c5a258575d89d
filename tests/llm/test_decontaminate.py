import hashlib
import random
import re

import pytest

from corvane.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(docs, items):
    windows = {}
    for i, text in items:
        w = WORD.findall(lower(text))
        m = min(10, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            if i is not None:
                windows.setdefault(tuple(w[k : k + m]), set()).add(str(i))
    out = []
    for d, text in docs:
        w, hit, found = WORD.findall(lower(text)), set(), set()
        for m in {len(x) for x in windows}:
            for k in range(len(w) - m + 1):
                if own := windows.get(tuple(w[k : k + m])):
                    hit |= set(range(k, k + m))
                    found |= own
        ids = ",".join(sorted(found))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def tables():
    r = random.Random(3)
    word = lambda: r.choice(["the", "of", "a", "b", "É1", "xyz", "漢字", "The", "no-no"])
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(r.choice([0, 1, 2, 3, 9, 10, 11, 30]) if i % 3 else 14)) for i in range(40)] + [(None, text(12)), (50, None), (7, text(15))]
    docs = [(i, text(r.randrange(60))) for i in range(150)]
    docs += [(200 + i, text(5) + ", " + t.upper() + "!" + text(3)) for i, (_, t) in enumerate(items) if t]
    docs += [(900, None), (901, ""), (902, "  ,,"), (5, docs[5][1]), (903, text(20_000)), (None, items[3][1])]
    return docs, items


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_equals_brute_force(spark, tables, block, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_BYTES", block)
    docs, items = tables
    d = spark.createDataFrame([(*x, "n") for x in docs], "doc_id long, text string, n_words string")
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = D.decontaminate(d, b).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert sorted(map(tuple, rows), key=str) == brute(docs, items)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:4] for r in D.decontaminate(d, b).collect()] == [(1, 2, 0, 0)]
    assert D.decontaminate(d.limit(0), d.toDF("item_id", "text")).count() == 0
