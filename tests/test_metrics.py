import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.operators import dedup, metrics
from corvane.queries import QUERIES


def distance(a, b):
    return bin((a ^ b) & (1 << 64) - 1).count("1")


@pytest.fixture(scope="module")
def hashes():
    r = random.Random(2)
    bases = [r.getrandbits(64) for _ in range(12)]
    out = []
    for i in range(120):
        h = r.choice(bases)
        for _ in range(r.choice([0, 0, 1, 2, 3, 4])):
            h ^= 1 << r.randrange(64)
        out.append((i, h - (1 << 64) if h >> 63 else h))
    return out


def frame(spark, hashes):
    return spark.createDataFrame(hashes, "doc_id long, h long")


def test_near_pairs(spark, hashes):
    exact = {(i, j, distance(a, b)) for i, a in hashes for j, b in hashes if i < j and distance(a, b) <= 3}
    got = [tuple(r) for r in dedup.near_pairs(frame(spark, hashes), 3, "exact").collect()]
    assert len(got) == len(set(got)) and set(got) == exact
    h = dict(hashes)
    top = {p for p in exact if (h[p[0]] >> 48) == (h[p[1]] >> 48)}
    compat = dedup.near_pairs(frame(spark, hashes), 3, "compat")
    assert {tuple(r) for r in compat.collect()} == top and top < exact
    first = {}
    for i, x in hashes:
        first.setdefault(x >> 48, i)
    want = sorted(top, key=lambda p: (first[h[p[0]] >> 48], p[0], p[1]))[:10]
    for k in (1, 10):
        assert [tuple(r) for r in dedup.first_pairs(frame(spark, hashes), k).collect()] == want[:k]


def test_first_pairs_of_many_equal_hashes(spark):
    rows = [(i, 7 if i % 3 else 5) for i in range(60)]
    want = [(i, j, distance(dict(rows)[i], dict(rows)[j])) for i in range(60) for j in range(i + 1, 60)]
    for k in (1, 5, 59, 60, 130):
        assert [tuple(r) for r in dedup.first_pairs(frame(spark, rows), k).collect()] == want[:k]


def test_repeated_ids(spark):
    """Ids with several hashes, near ones among them, and rows that come twice."""
    r = random.Random(4)
    rows = [(r.randrange(25), r.choice([0, 1, 3, 255, 254, -1, -2, 1 << 40])) for _ in range(80)]
    exact = {(min(i, j), max(i, j), distance(a, b)) for i, a in rows for j, b in rows if i != j and distance(a, b) <= 3}
    assert {tuple(x) for x in dedup.near_pairs(frame(spark, rows), 3, "exact").collect()} == exact
    kept, want = [], []
    for i, h in sorted(rows):
        ok = all(distance(h, x) > 3 for x in kept)
        kept += [h] * ok
        want.append((i, ok))
    assert sorted(map(tuple, dedup.gate(frame(spark, rows), 3).collect())) == sorted(want)
    assert sorted(map(tuple, dedup.gate(frame(spark, [(1, 0), (1, 1)]), 3).collect())) == [(1, False), (1, True)]
    odd = spark.createDataFrame([(1, None), (1, None), (None, 8), (None, 8), (7, 8), (2, 9), (3, -1)], "doc_id long, h long")
    assert sorted(map(tuple, dedup.gate(odd, 3).collect()), key=str) == [(1, True), (1, True), (2, False), (3, True), (7, False), (None, False), (None, True)]


def test_gate_is_greedy_in_id_order(spark, hashes):
    kept = []
    for i, h in hashes:
        if all(distance(h, x) > 3 for _, x in kept):
            kept.append((i, h))
    got = {r.doc_id for r in dedup.gate(frame(spark, hashes), 3).collect() if r.accepted}
    assert got == {i for i, _ in kept}
    assert dedup.gate(frame(spark, []), 3).count() == 0


def test_hamming(spark, hashes):
    d = [distance(a, b) for i, a in hashes for j, b in hashes if i < j]
    exact = metrics.hamming_stats(frame(spark, hashes)).first()
    assert exact.pairs == len(d) and exact["mean"] == pytest.approx(sum(d) / len(d)) and metrics.hamming_moments(frame(spark, hashes)).first()["mean"] == pytest.approx(exact["mean"])
    sampled = metrics.hamming_stats(frame(spark, hashes), max_pairs=1000).first()
    assert 500 <= sampled.pairs <= 1000 and sampled["mean"] == pytest.approx(exact["mean"], rel=0.1)
    assert metrics.hamming_stats(frame(spark, [])).first()["mean"] == 0.0


@pytest.mark.parametrize("n", [0, 1, 2, 7, 8, 25, 26])
def test_drawn_pairs_are_different_and_all_there(spark, n):
    pairs = lambda most: [frozenset(r) for r in metrics.drawn_pairs(spark, n, most).collect()]
    assert sorted(map(sorted, pairs(10_000))) == [[i, j] for i in range(n) for j in range(i + 1, n)]
    some = pairs(20)
    assert len(set(some)) == len(some) == min(20, n * (n - 1) // 2) and all(len(p) == 2 for p in some)


def test_drawn_pairs_of_many_rows(spark):
    n = 6 * 10**9
    rows = metrics.drawn_pairs(spark, n, 2000).collect()
    assert len({frozenset(r) for r in rows}) == 2000 and all(0 <= r.i < n and 0 <= r.j < n and r.i != r.j for r in rows)
    assert 0.45 < sum(r.i for r in rows) / 2000 / n < 0.55 and 0.45 < sum(r.j for r in rows) / 2000 / n < 0.55


def test_distinct_n(spark):
    texts = ["a b", "abab", "", "c"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    assert metrics.distinct_n(df, X.char_tokens(F.col("t")), 2).first()[0] == pytest.approx((1 + 2 / 3) / 2)
    words = "x y|  |x|y x y".split("|")
    rows = spark.createDataFrame(list(enumerate(words)), "i long, t string")
    flat = " ".join(words).split()
    for n in (1, 2, 3):
        grams = [tuple(flat[i : i + n]) for i in range(len(flat) - n + 1)]
        assert metrics.distinct_n_corpus(rows, "t", "i", n).first()[0] == pytest.approx(len(set(grams)) / len(grams))


def test_self_bleu_against_all_others(spark):
    texts = ["abcd", "abce", "xyz", "", "abcdabcd"]

    def bleu(c, refs):
        size = min((len(r) for r in refs), key=lambda n: (abs(n - len(c)), n))
        logs = 0.0
        for n in (1, 2):
            mine = Counter(c[i : i + n] for i in range(len(c) - n + 1))
            most = Counter()
            for r in refs:
                most |= Counter(r[i : i + n] for i in range(len(r) - n + 1))
            p = sum(min(k, most[g]) for g, k in mine.items()) / max(1, sum(mine.values()))
            logs += math.log(p or 1e-9)
        return (1.0 if len(c) > size else math.exp(1 - size / len(c))) * math.exp(logs / 2)

    want = [bleu(c, [r for j, r in enumerate(texts) if j != i and r]) for i, c in enumerate(texts) if c]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    assert metrics.self_bleu(df, X.char_tokens(F.col("t")), "i").first()[0] == pytest.approx(sum(want) / len(want))
    assert metrics.self_bleu(df.limit(1), X.char_tokens(F.col("t")), "i").first()[0] == 0.0


def test_self_bleu_query_is_of_all_pairs(spark, tmp_path):
    r = random.Random(4)
    texts = ["".join(r.choice("abcdefghijklmnop"[: r.choice([3, 16])]) for _ in range(r.choice([0, 1, 2, 5, 9, 30, r.randrange(60)]))) for _ in range(70)]

    def grams(t, n):
        return Counter(t[i : i + n] for i in range(len(t) - n + 1))

    want = []
    for i, c in enumerate(texts):
        refs = [x for j, x in enumerate(texts) if j != i and x]
        if c:
            size = min((len(x) for x in refs), key=lambda n: (abs(n - len(c)), n))
            logs = 0.0
            for n in (1, 2):
                most = Counter()
                for x in refs:
                    most |= grams(x, n)
                p = sum(min(k, most[g]) for g, k in grams(c, n).items()) / max(1, len(c) - n + 1)
                logs += math.log(p if p > 1e-12 else 1e-9)
            want.append((1.0 if len(c) > size else math.exp(1 - size / len(c))) * math.exp(logs / 2))
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert QUERIES["self_bleu2"](spark, str(tmp_path)).first()[0] == pytest.approx(sum(want) / len(want))
    one = spark.createDataFrame([(1, "abc"), (2, "")], "i long, t string")
    assert metrics.self_bleu_of_all(one, X.char_tokens(F.col("t")), "i").first()[0] == 0.0


def test_kl_pearson_histogram(spark):
    counts = spark.createDataFrame([("a", 3), ("z", 1)], "key string, count long")
    prior = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "key string, q double")
    want = sum(p * math.log(p / q) for p, q in ((4 / 7, 0.5), (1 / 7, 0.5), (2 / 7, 1e-8)))
    assert metrics.kl_divergence(counts, prior).first()[0] == pytest.approx(want)
    assert metrics.kl_divergence(counts.limit(0), prior).first()[0] == 0.0
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert metrics.pearson(flat, "x", "y").first()[0] == 0.0 and metrics.pearson(flat.limit(0), "x", "y").first()[0] == 0.0
    h = metrics.histogram(spark.createDataFrame([(v,) for v in (0.0, 1.0, 2.0, 12.0, None)], "v double"), "v").orderBy("bin").collect()
    assert [r["count"] for r in h] == [1, 1, 1] + [0] * 8 + [1]
    assert [tuple(r)[3] for r in metrics.histogram(flat, "x").collect()] == [2] and metrics.histogram(flat.limit(0), "x").count() == 0


def test_ranked_and_mentions(spark):
    items = spark.createDataFrame([(0, ["a"], []), (1, [], ["w"]), (2, ["a"], []), (3, ["a", "b"], [])], "o long, errors array<string>, warnings array<string>")
    assert [r.o for r in metrics.suspicious(items, "o", 3).collect()] == [3, 0, 2]
    df = spark.createDataFrame([(["数学"], "爱数学"), (["语文"], "x"), ([], "y")], "s array<string>, t string")
    assert metrics.mention_ratio(df, F.col("s"), F.col("t")).first()[0] == 0.5


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hashes_are_not_broadcast(spark, hashes):
    """Ten keys are made of each hash, so tables that are small in their files pass no driver."""
    own = frame(spark, hashes)
    for mode in ("exact", "compat"):
        assert "Broadcast" not in _plan(dedup.near_pairs(own, 3, mode))


def test_gate_broadcasts_no_hashes(spark, hashes):
    assert "Broadcast" not in _plan(dedup.gate(frame(spark, hashes), 3))


def test_no_round_of_the_gate_broadcasts(spark, hashes, monkeypatch):
    """The keys and edges are made in tables that the gate stores, which its last plan doesn't show."""
    plans, write = [], dedup.stored
    monkeypatch.setattr(dedup, "stored", lambda df: plans.append(_plan(df)) or write(df))
    dedup.gate(frame(spark, hashes), 3)
    assert len(plans) >= 5 and any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_shares_of_characters_in_one_pass(spark):
    texts = ["", "a", "aa", "abab，ab", "漢字😀漢字😀x", " \t", "x" * 50]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = metrics.distinct_chars(df, F.col("t"), 1, 2, 3).first()
    want = [metrics.distinct_n(df, X.char_tokens(F.col("t")), n).first()[0] for n in (1, 2, 3)]
    assert list(got) == pytest.approx(want) and 0 < got[1] < 1


def test_whole_texts_are_not_numbered_for_ngrams(spark, monkeypatch):
    """Only the ends of rows go through the numbering, and n-grams over short rows still run on."""
    seen, number = [], metrics.numbered
    monkeypatch.setattr(metrics, "numbered", lambda df, *more: seen.append(df) or number(df, *more))
    rows = [(1, "a b c d a b"), (2, "c"), (3, None), (4, "d a"), (5, "b c d")]
    words = [w for _, t in rows for w in (t or "").split()]
    for n in (2, 3, 4):
        grams = list(zip(*(words[k:] for k in range(n)), strict=False))
        got = metrics.distinct_n_corpus(spark.createDataFrame(rows, "i long, t string"), "t", "i", n).first()[0]
        assert got == pytest.approx(len(set(grams)) / len(grams))
        assert seen[-1].agg(F.max(F.greatest(F.size("_head"), F.size("_tail")))).first()[0] <= n - 1 and "_t" not in seen[-1].columns
