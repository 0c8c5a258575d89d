"""Streams against their batch twins."""

import datetime as dt
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corvane.operators.dedup import gate
from corvane.streaming import compose as C
from corvane.streaming import gate as T
from corvane.streaming import limiter as L
from corvane.streaming import monitor as M
from corvane.streaming import retry as R
from corvane.streaming import window as W
from corvane.streaming.state import committed


def parts(folder, frames):
    folder.mkdir()
    for k, rows in enumerate(frames):
        rows.to_parquet(folder / f"{k:03}.parquet", coerce_timestamps="us")
        time.sleep(0.02)
    return str(folder)


def hashes(n):
    random.seed(4)
    centres = [random.getrandbits(64) - (1 << 63) for _ in range(n // 4)]
    flip = lambda h: h ^ (1 << random.randrange(63)) ^ (1 << random.randrange(63))
    return [flip(random.choice(centres)) if random.random() < 0.8 else random.choice(centres) for _ in range(n)]


@pytest.mark.parametrize("at_once", [False, True])
def test_stream_gate_equals_the_batch_gate(spark, tmp_path, monkeypatch, at_once):
    rows = pd.DataFrame({"sid": range(200), "h": hashes(200), "note": [f"n{i}" for i in range(200)]})
    rows.loc[[7, 90], "h"] = None
    rows["h"] = rows["h"].astype("Int64")
    frames = [rows[i : i + 50] for i in range(0, 200, 50)]
    frames[2] = pd.concat([frames[2], frames[0][:5], frames[2][:5]])  # replays
    src = parts(tmp_path / "in", frames)
    stream = spark.readStream.schema("sid long, h long, note string").option("maxFilesPerTrigger", 1).parquet(src)
    table, compared = str(tmp_path / "table"), []
    near = T.near_known
    monkeypatch.setattr(T, "near_known", lambda *a: compared.append(1) or near(*a))
    monkeypatch.setattr(T, "SHARDS", 4)
    writer = T.gated_writer(stream, table, str(tmp_path / "ck"))
    if at_once:
        writer.trigger(availableNow=True).start().awaitTermination(200)
    else:
        q = writer.start()
        q.processAllAvailable()
        q.stop()
    got = sorted(tuple(r) for r in committed(spark, table).select("sid", "note").collect())
    wanted = sorted(r.sid for r in gate(spark.createDataFrame(rows[["sid", "h"]].astype(object).where(rows[["sid", "h"]].notna(), None).values.tolist(), "sid long, h long"), 3, "sid").where("accepted").collect())
    assert got == [(i, f"n{i}") for i in wanted] and 20 < len(wanted) < 150
    assert bool(compared) == at_once  # with notices on their way, nothing reads what was written


def test_each_sid_is_written_once(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    frames = [[(1, 0, "a"), (2, 5, "a"), (2, 6, "b")], [(1, 10, "c"), (3, 11, "a")], [(4, 5000, "a"), (3, 12, "b")], [(4, 5000, "c")], [(1, 20, "late"), (5, 30, "late"), (4, 5001, "b"), (6, 5002, "a")]]
    src = parts(tmp_path / "in", [pd.DataFrame([(s, at(t), n) for s, t, n in f], columns=["sid", "ts", "note"]) for f in frames])
    stream = spark.readStream.schema("sid long, ts timestamp, note string").option("maxFilesPerTrigger", 1).parquet(src)
    table = str(tmp_path / "table")
    T.once_writer(stream, table, str(tmp_path / "ck"), delay="60 seconds").trigger(availableNow=True).start().awaitTermination(120)
    got = sorted(r.sid for r in committed(spark, table).collect())
    assert got == [1, 2, 3, 4, 6]
    # A batch whose mark is missing doesn't count, and a batch that is run again replaces itself.
    first = T.Files(spark, table).names("_committed")[0]
    rows = committed(spark, table).where(F.col("batch") == int(first)).drop("batch").toPandas()
    T.Files(spark, table).delete(f"_committed/{first}")
    assert committed(spark, table).count() == len(got) - len(rows)
    T.write_batch(spark.createDataFrame(rows), table, int(first))
    assert sorted(r.sid for r in committed(spark, table).collect()) == got
    assert committed(spark, str(tmp_path / "none")) is None


def test_sliding_stream_equals_the_batch(spark, tmp_path):
    random.seed(9)
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = sorted(((round(random.random() * 600, random.choice([0, 3])), random.choice([1, 1, 2, None]), random.random() < 0.3) for _ in range(400)), key=lambda x: x[0])
    frame = pd.DataFrame([(i, at(t), u, b) for i, (t, u, b) in enumerate(rows)], columns=["event_id", "ts", "user_id", "bad"]).astype({"user_id": "Int64"})
    # Shuffled within half a minute, which the watermark allows.
    near = frame.iloc[sorted(range(400), key=lambda i: rows[i][0] + random.random() * 30)]
    end = pd.DataFrame([(1000, at(5000), 1, False), (1001, at(9000), 3, False)], columns=frame.columns).astype({"user_id": "Int64"})
    late = pd.DataFrame([(1002, at(100), 1, True)], columns=frame.columns).astype({"user_id": "Int64"})
    src = parts(tmp_path / "in", [near[:150], near[150:300], near[300:], end[:1], late, end[1:]])
    stream = spark.readStream.schema("event_id long, ts timestamp, user_id long, bad boolean").option("maxFilesPerTrigger", 1).parquet(src)
    found = []
    out = W.sliding_stream(stream, "user_id", "event_id", "ts", F.col("bad"), "40 seconds")
    out.writeStream.foreachBatch(lambda b, _: found.extend(b.collect())).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(200)
    frame.to_parquet(tmp_path / "all.parquet", coerce_timestamps="us")
    wanted = L.sliding_counts(spark.read.parquet(str(tmp_path / "all.parquet")), "user_id", "ts", F.col("bad")).collect()
    assert sorted((r.event_id, r.successes, r.violations) for r in found if r.event_id < 1000) == sorted((r.event_id, r.successes, r.violations) for r in wanted)
    assert [(r.event_id, r.successes, r.violations) for r in found if r.event_id >= 1000] == [(1000, 1, 0)]


def plain_states(rows, start, step):
    states = {}
    for k, *_, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        states[k] = step(states.get(k, start), v)
    return states


@pytest.mark.parametrize("most", [9, 180, 3])
def test_one_users_events_spread_over_tasks(spark, most):
    random.seed(most)
    quiet = lambda i: random.random() < (0.002 if i % 3000 < 1500 else 0.2)
    rows = [(7, i, quiet(i)) for i in range(6000)] + [(random.choice([None, 1, 2, 3, 9, 11]), i, random.random() < 0.1) for i in range(300)] + [(20, 1, None), (21, 1, True)]
    table = spark.createDataFrame(random.sample(rows, len(rows)), "k long, t long, bad boolean").repartition(3)
    tasks, step = [], L.aimd(most)
    for parts_ in (1, 4, 40):
        df = C.composed(table, "k", ["t"], ["bad"], (6, 0, 0), step, L.AIMD, C.AimdRuns(6, most), parts_)
        assert {r.k: tuple(r)[1:] for r in df.collect()} == plain_states(rows, (6, 0, 0), step)
        tasks.append(C.parts_of(table, "k", ["t"], ["bad"], (6, 0, 0), step, L.AIMD, C.AimdRuns(6, most), parts_).where("k = 7").count())
    assert tasks[0] == 1 and tasks[2] > 30


def test_averages_compose(spark):
    random.seed(2)
    rows = [(7, i, random.random() * 10) for i in range(3000)] + [(k, i, float(k or 0) + i) for k in (None, 1, 9) for i in range(5)] + [(30, 0, None), (31, 0, None), (31, 1, 2.5)]
    table = spark.createDataFrame(rows, "k long, t long, v double")
    got = {r.k: r.latency for r in C.composed(table, "k", ["t"], ["v"], (None,), C.ewma_step, "latency double", C.EwmaRuns(), 25).collect()}
    wanted = {k: s[0] for k, s in plain_states(rows, (None,), C.ewma_step).items()}
    assert got.pop(30) is None and wanted.pop(30) is None and got == pytest.approx(wanted, rel=1e-13)
    none = spark.createDataFrame([], "k long, t long, v double")
    assert C.composed(none, "k", ["t"], ["v"], (None,), C.ewma_step, "latency double", C.EwmaRuns(), 3).collect() == []


def test_runs_combine_in_any_grouping():
    random.seed(8)
    runs, step = C.AimdRuns(6, 12), L.aimd(12)
    events = [random.random() < 0.04 for _ in range(700)]
    for cuts in ([], [1], [300, 301, 420], sorted(random.sample(range(700), 60))):
        summaries = [runs.add(runs.empty(), events[a:b]) for a, b in zip([0, *cuts], [*cuts, 700], strict=True)]
        while len(summaries) > 1:  # neighbours, from any place
            i = random.randrange(len(summaries) - 1)
            summaries[i : i + 2] = [runs.combine(summaries[i], summaries[i + 1])]
        for state in ((6, 0, 0), (1, 19, 4), (12, 3, 0)):
            wanted = state
            for bad in events:
                wanted = step(wanted, bad)
            assert runs.apply(state, runs.decode(runs.encode(summaries[0]))) == wanted


def flaky(key, payload):
    """Busy as often as the payload says, then a result; asks for a pause of its own the second time."""
    n = FLAKY.get(key, 0) + 1
    FLAKY[key] = n
    return (429 if n % 2 else 503, None, 0.05 if n == 2 else None) if n <= int(payload) else (200, f"{key} after {n}", None)


FLAKY: dict[str, int] = {}


def test_busy_calls_are_asked_again_by_timers(spark, tmp_path):
    calls = pd.DataFrame([("a", "0"), ("b", "1"), ("c", "2"), ("d", "3"), ("e", "4"), ("f", "9")], columns=["id", "payload"])
    src = parts(tmp_path / "in", [calls[:4], calls[4:]])
    stream = spark.readStream.schema("id string, payload string").parquet(src)

    def counted(key, payload, folder=str(tmp_path)):
        # Tries are counted in files, for workers may change between them.
        with open(f"{folder}/{key}", "a+") as f:
            f.write("x")
            f.seek(0)
            n = len(f.read())
        return (429 if n % 2 else 503, None, 0.05 if n == 2 else None) if n <= int(payload) else (200, f"{key} after {n}", None)

    found = []
    q = R.retried(stream, counted, 4, 0.02, 1.8).writeStream.foreachBatch(lambda b, _: found.extend(b.collect())).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    until = time.time() + 100
    while len(found) < 6 and time.time() < until and q.isActive:
        time.sleep(0.3)
    q.stop()
    got = {r.id: r for r in found}
    assert len(found) == 6
    for key, payload in calls.itertuples(index=False):
        FLAKY.clear()
        pauses, tries = [], [0]
        try:
            result = L.with_backoff(lambda: flaky(key, payload), 4, 0.02, 1.8, pauses.append)  # noqa: B023
        except RuntimeError:
            result = None
        assert (got[key].result, got[key].tries) == (result, FLAKY[key]) and list(got[key].pauses) == pytest.approx(pauses)
        assert (got[key].status == 200) == (result is not None)


def test_monitor_shows_limiters_while_they_run(spark, tmp_path):
    frames = [pd.DataFrame([(f"p{p}", float(b * 10 + i), (i + p) % 5 == 0, float(p)) for p in range(3) for i in range(10)], columns=["provider", "seconds", "violation", "latency"]) for b in range(3)]
    src = parts(tmp_path / "in", frames)
    stream = spark.readStream.schema("provider string, seconds double, violation boolean, latency double").option("maxFilesPerTrigger", 1).parquet(src)
    from corvane.streaming.state import keyed_state

    keyed_state(spark)
    monitor = M.Monitor(spark)
    try:
        q = monitor.watched(L.limiter_stream(stream)).queryName("limits").option("checkpointLocation", str(tmp_path / "ck")).start()
        q.processAllAvailable()
        now = {r.provider: r for r in monitor.snapshots().collect()}  # while it runs
        assert q.isActive and sorted(now) == ["p0", "p1", "p2"] and all((r.batch, r.calls) == (2, 30) for r in now.values())
        assert [r.provider for r in monitor.worst(2).collect()] == sorted(now, key=lambda p: (-now[p].score, p))[:2]
        q.stop()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        rows = monitor.reports().where("name = 'limits' and rows > 0").collect()
        assert [(r.batch, r.rows, r.state) for r in rows] == [(0, 30, "ended"), (1, 30, "ended"), (2, 30, "ended")] and rows[-1].state_rows == 3
        for _ in range(M.REPORTS + 5):
            monitor._reports[rows[0].query].append(monitor._reports[rows[0].query][0])
        assert len(monitor._reports[rows[0].query]) == M.REPORTS
    finally:
        monitor.stop()
