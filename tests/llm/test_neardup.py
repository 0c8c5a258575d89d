import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import neardup as N


def brute(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None:
                c = len(a & b)
                if rows[i][0] == rows[j][0] or 100 * c >= 75 * (len(a) + len(b) - c):
                    parent[root(i)] = root(j)
    out = []
    for i, (d, _) in enumerate(rows):
        group = [rows[j][0] for j in range(len(rows)) if root(j) == root(i)]
        c = None if d is None else min(group) if sets[i] else d
        out.append((d, len(sets[i]), c, True if d is None else d == c))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randrange(1, 5)))
    out, i = [], 0
    for _ in range(40):
        base = [word() for _ in range(r.choice([3, 4, 5, 6, 30, 80, 200]))]
        for _ in range(r.choice([1, 1, 2, 5, 9])):
            own = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3, 5])):
                own[r.randrange(len(own))] = word()
            base = own if r.random() < 0.5 else base
            sep = r.choice([" ", "\n", " \t "])
            t = sep.join(own)
            out.append((i * 7 % 1009, t.upper() if r.random() < 0.2 else t))
            i += 1
    hot = [word() for _ in range(60)]
    for k in range(40):
        own = list(hot)
        own[k] = "x" + str(k)
        out.append((2000 + k, " ".join(own)))
    return out + [(5000, None), (5001, ""), (5002, " \n "), (5003, "é\xa0 x"), (5004, "é\xa0 X"), (5005, "w " * 30_000), (5006, "w " * 4), (None, out[0][1]), (5007, out[3][1])]


def test_equals_brute_force(spark, rows):
    d = spark.createDataFrame([(*x, "k") for x in rows], "doc_id long, text string, kept string")
    assert sorted(map(tuple, N.near_duplicates(d).collect()), key=str) == brute(rows)


def test_texts_of_one_id_are_documents_of_their_own(spark):
    r = random.Random(11)
    a, b, c, d = (" ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(60)) for _ in range(4))
    rows = [(1, a, "x"), (5, a, "y"), (5, b, "z"), (5, b, "z"), (7, b, "x"), (8, c, "x"), (8, d, "x"), (8, None, "x"), (9, c + " end", "x"), (None, a, "x"), (None, a, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = [(1, a, "x"), (5, b, "z"), (8, c, "x"), (8, d, "x"), (8, None, "x"), (None, a, "x"), (None, a, "x")]
    got = N.keep_representatives(docs)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def near_copies(n, seed=2):
    """Copies of 100 words with two or three random changes each: most pairs lie just below the level."""
    r = random.Random(seed)
    base = [f"w{r.randrange(10**6)}" for _ in range(100)]
    out = []
    for i in range(n):
        own = list(base)
        for k in r.sample(range(100), r.choice([2, 2, 3])):
            own[k] = f"x{r.randrange(10**6)}"
        out.append((i, " ".join(own)))
    return out


@pytest.mark.parametrize("growth", [2, 16])
def test_unsettled_buckets(spark, growth, monkeypatch):
    monkeypatch.setattr(N, "GROWTH", growth)
    rows = near_copies(150)
    want = brute(rows)
    assert 5 < len({x[2] for x in want}) < 150
    assert sorted(map(tuple, N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str) == want


def test_shares_of_the_samples():
    assert N._shares(0) == N._shares(16) == [1.0] and N._shares(17) == [1 / 16, 1.0] and N._shares(3000) == [1 / 256, 1 / 16, 1.0]


def test_parities_lose_no_link(spark):
    """Of pairs at and around the level, none that reaches it is refused, and few below it pass."""
    rng = np.random.default_rng(6)
    rows, wrong = [], 0
    for i in range(200):
        n = int(rng.integers(4, 1500))
        shared = rng.integers(0, 1 << 62, n)
        a, b = (np.unique(np.concatenate([shared, rng.integers(0, 1 << 62, int(n * rng.uniform(0, 0.33)))])) for _ in range(2))
        rows += [(2 * i, a.tolist()), (2 * i + 1, b.tolist())]
    sets = spark.createDataFrame(rows, "_id long, _set array<long>")
    own = N.set_parities(sets).join(sets.selectExpr("_id", "size(_set) AS _n"), "_id")
    x, y = own.alias("x"), own.alias("y")
    passed = {r[0] for r in x.join(y, (F.col("x._id") % 2 == 0) & (F.col("y._id") == F.col("x._id") + 1) & N._reach("x", "y")).select(F.col("x._id")).collect()}
    for i in range(0, 400, 2):
        a, b = set(rows[i][1]), set(rows[i + 1][1])
        c = len(a & b)
        linked = 100 * c >= 75 * (len(a) + len(b) - c)
        assert not linked or i in passed
        wrong += not linked and i in passed
    assert wrong <= 20 and 20 < len(passed) < 180


def test_the_survivor_of_equal_texts_is_defined(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(5, text, "z", 1), (5, text, "a", 2), (5, text, "a", 2), (5, text, None, 3), (6, text, "q", 1)]
    schema = "doc_id long, text string, source string, n_chars long"
    got = [[tuple(x) for x in N.keep_representatives(spark.createDataFrame(part, schema).repartition(3)).collect()] for part in (rows, rows[::-1])]
    assert len(got[0]) == 1 and got[0] == got[1] and got[0][0][0] == 5


def test_empty_table(spark):
    assert N.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_odd_sketches_estimate_similarity():
    rng = np.random.default_rng(0)
    limit = N.sketch_limit(0.75, 128, 512, 1e-6)
    for _ in range(60):
        common = rng.integers(0, 1 << 63, 600, np.uint64)
        a, b = (np.concatenate([common, rng.integers(0, 1 << 63, 100, np.uint64)]) for _ in range(2))
        _, keys, sketch = N.signatures([np.unique(a), np.unique(b)])
        assert np.bitwise_count((sketch[0] ^ sketch[1]).view(np.uint64)).sum() <= limit
        assert (keys[0] == keys[1]).any()
    _, _, far = N.signatures([np.unique(rng.integers(0, 1 << 63, 500, np.uint64)) for _ in range(2)])
    assert np.bitwise_count((far[0] ^ far[1]).view(np.uint64)).sum() > limit


def test_components(spark):
    rng = random.Random(1)
    edges = [(i + 1, i) for i in range(0, 30)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)]
    got = {r._id: r._component for r in N.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {}
    for a, b in edges:
        if a != b:
            x = want.setdefault(a, {a}) | want.setdefault(b, {b})
            for i in x:
                want[i] = x
    assert got == {i: min(x) for i, x in want.items()}


def of_one_template(n, seed=3):
    """Documents that share 100 words and have 45 of their own, and now and then a copy with a change: one wide bucket, few links."""
    r = random.Random(seed)
    base = [f"w{r.randrange(10**6)}" for _ in range(100)]
    out = []
    for i in range(n):
        own = out[-1][1].split() if i % 25 == 7 else base + [f"x{r.randrange(10**6)}" for _ in range(45)]
        if i % 25 == 7:
            own[-20] = "changed"
        out.append((i, " ".join(own)))
    return out


def test_wide_buckets_of_unlinked_documents(spark):
    rows = of_one_template(200)
    want = brute(rows)
    assert 180 < len({x[2] for x in want}) < 200
    assert sorted(map(tuple, N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str) == want


@pytest.mark.parametrize(("wide", "tile"), [(0, 8), (2, 4096)])
def test_all_buckets_by_finer_keys_and_tiles(spark, rows, monkeypatch, wide, tile):
    monkeypatch.setattr(N, "WIDE", wide)
    monkeypatch.setattr(N, "TILE", tile)
    own = rows[-60:] + near_copies(40)[::2]
    d = spark.createDataFrame(own, "doc_id long, text string")
    assert sorted(map(tuple, N.near_duplicates(d).collect()), key=str) == brute(own)


def compared(keys):
    """Pairs within the buckets of (_id, _key)."""
    return sum(r["count"] * (r["count"] - 1) // 2 for r in keys.groupBy("_key").count().collect())


def test_comparisons_of_a_template_grow_with_the_documents(spark):
    got = []
    for n in (1500, 3000):
        d = spark.createDataFrame([(i, t) for i, t in of_one_template(n)], "_id long, text string")
        sets = N.full_sets(d, d.select("_id"), "_id", "text")
        got.append(compared(N.fine_keys(sets, d.select("_id"))))
    assert 0 < got[0] <= 100 * 1500 and got[1] <= 2.5 * got[0]


def test_finer_keys_lose_no_link(spark):
    """Pairs just above the level, of all sizes, also at the bounds of thinning, among documents that share much."""
    rng = np.random.default_rng(8)
    common = np.unique(rng.integers(0, 1 << 63, 3000, np.uint64) * np.uint64(2))
    sets, i = [], 0
    for n in [1, 2, 3, 4, 7, 20, 100, 383, 384, 385, 500, 511, 512, 513, 682, 683, 684, 1023, 1024, 1025, 1500, 2047, 2048, 5000] * 5:
        shared = np.unique(np.concatenate([common[: n // 2], rng.integers(0, 1 << 63, n - n // 2, np.uint64)]))
        extra = rng.integers(0, 1 << 63, len(shared) // 3, np.uint64)  # the larger set holds the smaller one and a third more
        for s in (shared, np.unique(np.concatenate([shared, extra]))):
            sets.append((i, s.view(np.int64).tolist()))
            i += 1
    full = spark.createDataFrame(sets, "_id long, _set array<long>")
    of = {}
    for r in N.fine_keys(full, full.select("_id")).collect():
        of.setdefault(r._id, set()).add(r._key)
    linked = [k for k in range(0, i, 2) if 100 * len(sets[k][1]) >= 75 * len(sets[k + 1][1]) and sets[k][1] != sets[k + 1][1]]
    assert len(linked) > 80 and all(of.get(k, set()) & of.get(k + 1, set()) for k in linked)


def test_key_shares():
    assert [N.thinning(n) for n in (0, 1, 511, 512, 1023, 1024, 5000)] == [0, 0, 0, 1, 1, 2, 4]
    assert [N.key_share(n, False) for n in (0, 1, 4, 100, 101)] == [0, 1, 2, 26, 26] and N.key_share(0, True) == 0
    assert 26 < 100 * N.key_share(300, True) / 300 < 42


def test_finer_keys_only_where_they_can_pay(spark, monkeypatch):
    """Shingles are counted only for wide buckets of unlike members, and only where these are more than their shingles are worth."""
    asked, made = [], N.fine_keys
    monkeypatch.setattr(N, "fine_keys", lambda full, ids: asked.append(sorted(r._id for r in ids.collect())) or made(full, ids))
    r = random.Random(5)
    base, alike = [f"w{r.randrange(10**6)}" for _ in range(100)], []
    for i in range(120):
        own = list(base)
        for k in r.sample(range(100), 2):
            own[k] = f"x{r.randrange(10**6)}"
        alike.append((i, " ".join(own)))
    rows = alike + [(1000 + i, t) for i, t in of_one_template(200)]
    docs, want = spark.createDataFrame(rows, "doc_id long, text string"), brute(rows)
    assert sorted(map(tuple, N.near_duplicates(docs).collect()), key=str) == want and not asked
    monkeypatch.setattr(N, "COST", 0)
    assert sorted(map(tuple, N.near_duplicates(docs).collect()), key=str) == want
    assert len(asked) == 1 and len(asked[0]) > N.WIDE and min(asked[0]) >= 1000


def rows_joined(spark, run):
    """Rows that come out of inner joins on _id, where rows of bucket members meet their sketches, while ``run`` runs."""
    store = spark._jsparkSession.sharedState().statusStore()
    listed = lambda: (lambda found: [found.apply(i).executionId() for i in range(found.size())])(store.executionsList())
    last = max(listed(), default=-1)
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    total = 0
    for k in listed():
        if k > last:
            nodes, values = store.planGraph(k).allNodes(), store.executionMetrics(k)
            for node in (nodes.apply(i) for i in range(nodes.size())):
                metrics = node.metrics()
                if re.search(r"Join \[_id#\d+L?\], \[_id#\d+L?\], Inner", node.desc()):
                    ids = [metrics.apply(i).accumulatorId() for i in range(metrics.size()) if metrics.apply(i).name() == "number of output rows"]
                    total += sum(int(values.apply(i).replace(",", "")) for i in ids if values.contains(i))
    return total


def linked_and_outsiders(linked, outsiders, seed=4):
    """Copies of 100 words with one change, which are one component, and others with three, of which most stand alone."""
    r = random.Random(seed)
    base = [f"w{r.randrange(10**6)}" for _ in range(100)]
    out = []
    for i in range(linked + outsiders):
        own = list(base)
        for k in r.sample(range(10, 90), 1 if i < linked else 3):
            own[k] = f"x{r.randrange(10**6)}"
        out.append((i, " ".join(own)))
    return out


def test_members_meet_their_sketches_once(spark):
    """In unsettled buckets all members come once and the outsiders once more, not all members twice a round."""
    rows = linked_and_outsiders(150, 12)
    docs, want = spark.createDataFrame(rows, "doc_id long, text string"), brute(rows)
    assert 5 < len({x[2] for x in want}) <= 13
    got = []
    joined = rows_joined(spark, lambda: got.extend(N.near_duplicates(docs).collect()))
    assert sorted(map(tuple, got), key=str) == want
    keys = N.features(docs, "doc_id", "text").select(F.explode("_keys").alias("_key")).groupBy("_key").count().where("count > 2")
    members = keys.agg(F.sum("count")).first()[0]
    assert len(rows) < joined < 2 * members


def test_tiles_hold_each_pair_across_components_once(spark, monkeypatch):
    monkeypatch.setattr(N, "TILE", 8)
    component = {i: 0 if i < 70 else i for i in range(100)}
    buckets = {7: range(90), 8: range(60, 100), 9: range(5)}
    rest = spark.createDataFrame([(k, 0, i) for k, own in buckets.items() for i in own], "_key long, _band int, _id long")
    now = N._unsettled(rest, spark.createDataFrame([(i, 0) for i in range(70)], "_id long, _component long"))
    x, y = (part.collect() for part in N._tiles(now))
    sides = {}
    for side, part in ((0, x), (1, y)):
        for r in part:
            sides.setdefault((r._key, r._row, r._column), ([], []))[side].append(r)
    pairs = [(k[0], *sorted((p._id, q._id))) for k, (a, b) in sides.items() for p in a for q in b if not q._out or p._component < q._component]
    want = [(k, i, j) for k in (7, 8) for i in buckets[k] for j in buckets[k] if i < j and component[i] != component[j]]
    assert sorted(pairs) == want
    # Bucket 7 has 3 blocks of outsiders and 9 of its largest component, bucket 8 has 4 and 2, bucket 9 is settled.
    assert len(x) == 20 * 12 + 30 * 6 and len(y) == 90 * 3 + 40 * 4
