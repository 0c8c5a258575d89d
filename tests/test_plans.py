import json
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corvane import schema as S
from corvane.plans import generate as G
from corvane.plans import quota as Q
from corvane.streaming import gate as T
from corvane.streaming import limiter as L


@pytest.mark.parametrize("n", [1, 7, 96, 200])
def test_schedule_counts(spark, n):
    mix = {S.LEVELS[0]: 0.4, S.LEVELS[1]: 0.3, S.LEVELS[2]: 0.2, S.LEVELS[3]: 0.1}
    rows = Q.schedule(spark, n, mix).collect()
    assert sorted(r.sid for r in rows) == list(range(1, n + 1))
    triplets = [(r.slot["年级"], r.slot["性别"], r.slot["优势学科偏向"][0]) for r in rows]
    assert len(set(triplets)) == min(n, 96)
    assert {x: sum(r.slot["目标学术水平"] == x for r in rows) for x in S.LEVELS} == Q.level_counts(n, mix)
    if n == 200:
        assert [r.sid for r in sorted(rows, key=lambda r: triplets[r.sid - 1])] != list(range(1, n + 1))


def test_level_counts_sum():
    for n in range(40):
        for mix in ({x: 0.25 for x in S.LEVELS}, {S.LEVELS[0]: 1.0}, {S.LEVELS[0]: 0.5, S.LEVELS[3]: 0.5}):
            assert sum(Q.level_counts(n, mix).values()) == n and min(Q.level_counts(n, mix).values()) >= 0


def test_quota_cycles_and_extends(spark):
    own = spark.createDataFrame([(0, ("初一", "男", ["理科向"], None))], "pos long, slot struct<`年级`:string,`性别`:string,`优势学科偏向`:array<string>,`目标学术水平`:string>")
    plan = Q.schedule(spark, 5, quota=own)
    assert {r.slot["年级"] for r in plan.collect()} == {"初一"} and plan.count() == 5
    with pytest.raises(ValueError, match="no slots"):
        Q.schedule(spark, 5, quota=own.limit(0))
    assert sorted(r.sid for r in Q.extend(plan, spark, 8).collect()) == list(range(1, 9))
    assert sorted(level_sizes(Q.round_robin_levels(spark, 10))) == [2, 2, 3, 3]


def level_sizes(df):
    return [r["count"] for r in df.groupBy("level").count().collect()]


def test_resume(spark):
    done = spark.createDataFrame([(1,), (3,)], "sid long")
    assert [r.sid for r in Q.next_batch(Q.pending(spark, 6, done), 2).collect()] == [2, 4]
    assert Q.concurrency(60) == 2 and Q.concurrency(60, violated=True) == 1 and Q.batch_size(3, 5) == 10
    Q.assert_same_run({}, 1, 1)
    with pytest.raises(ValueError, match="began with"):
        Q.assert_same_run({"total_n": 2, "chunk_size": 1}, 1, 1)


def test_generation_with_the_stub(spark):
    slots = Q.schedule(spark, 12)
    out = G.generate(slots)
    accepted, failures = out.accepted.collect(), out.failures.collect()
    assert len(accepted) + len(failures) == 12 and len(accepted) >= 10
    facts = json.loads(accepted[0].facts)
    assert set(S.REQUIRED) <= set(facts)
    again = G.generate(slots, accepted_before=out.accepted)
    assert again.accepted.count() == 0 and {"SimHash" in r.error for r in again.failures.collect()} == {True}
    assert G.used_names(out.accepted).count() >= 1


def test_revision_sees_the_issues(spark):
    def bad_level(call):
        """Answers as a server does, in a fence; gives a wrong name and a level in other words until an issue reaches it."""
        if call.agent == "fast":
            return json.dumps({"issues": [{"code": "F1", "owner": "学籍与发展阶段"}]})
        text = G.stub_model(call)
        if call.agent == "学业画像":
            text = json.dumps(json.loads(text) | {"学术水平": "很差"}, ensure_ascii=False)
        if call.agent == "学籍与发展阶段" and call.mode == "propose":
            text = json.dumps(json.loads(text) | {"代理名": "Zhao"}, ensure_ascii=False)
        if call.mode == "revise":
            assert [(x["code"], x["fields"]) for x in call.issues] == [("R6", ["代理名"])] and "zhang1" in call.issues[0]["hint"] and call.agent == "学籍与发展阶段"
        return {"choices": [{"message": {"content": [{"type": "text", "text": "```json\n"}, {"text": text}, "\n```"]}}]}

    slots = Q.schedule(spark, 4)
    revised = G.orchestrate(slots, bad_level).collect()
    assert len(revised) == 4 and not any(r.issues for r in revised)
    for r in revised:
        facts = json.loads(r.facts)
        assert facts["代理名"] != "Zhao" and facts["学术水平"] == facts["_采样约束"]["目标学术水平"] and facts["id"] == r.sid


def test_agents_answer_one_after_another_as_configured(spark):
    def check(call):
        order = [a.name for a in G.AGENTS]
        if call.agent in order:
            i = order.index(call.agent)
            assert (call.temperature, call.max_tokens) == (G.AGENTS[i].temperature, G.AGENTS[i].max_tokens) and call.seed.startswith("SEED-")
            assert {k for a in G.AGENTS[:i] for k in a.fields} <= set(call.facts) and not set(G.AGENTS[i].fields) & set(call.facts)
        return G.stub_model(call)

    assert {len(json.loads(r.facts)) for r in G.orchestrate(Q.schedule(spark, 2), check).collect()} == {16}


def test_failure(spark):
    slots = Q.schedule(spark, 4)
    out = G.generate(slots, lambda call: "sorry", attempts=2, max_rounds=1)
    assert out.accepted.count() == 0 and {r.attempts for r in out.failures.collect()} == {2}
    retry, final = G.route_failures(spark.createDataFrame([(1, "SimHash", 1), (2, "x", 1), (3, "x", 4)], "sid long, error string, attempts int"), 4)
    assert [r.sid for r in retry.collect()] == [2] and sorted(r.sid for r in final.collect()) == [1, 3]
    assert G.generate(slots.limit(0)).accepted.count() == 0

    def dies(call):
        raise OSError("no server")

    asked = G.ask(G._first(slots), dies, G.AGENTS[0], 0)
    assert [r.answer for r in asked.collect()] == [""] * 4
    before, after = ({r.sid: json.loads(r.facts) for r in x.collect()} for x in (asked, G.merged(asked, G.AGENTS[0])))
    assert before == after


def test_single_shot_modes(spark):
    slots = Q.schedule(spark, 6)
    for mode, key, value in (("age_15", "年龄", 15), ("grade_chu2", "年级", "初二")):
        out = G.single_shot(slots, mode)
        facts = [json.loads(r.facts) for r in out.accepted.collect()]
        assert len(facts) == 6 and out.failures.count() == 0 and {f[key] for f in facts} == {value}
    seeds = spark.sparkContext.accumulator(0)

    def deaf(call):
        """Ignores the constraint, and counts its calls."""
        seeds.add(1)
        return G.stub_model(G.Call(call.agent, call.facts, call.seed, call.temperature, call.max_tokens))

    out = G.single_shot(Q.schedule(spark, 96), "grade_chu2", deaf, retries=2)
    assert 0 < out.accepted.count() < 96 and {r.error for r in out.failures.collect()} == {"constraint grade_chu2"}
    assert G.single_shot(slots.limit(0)).accepted.count() == 0


def plain_limiter(events, start=6, most=180):
    capacity, streak, violations, tokens, last, granted, latency, success = start, 0, 0, float(start), None, 0, None, None
    for now, bad, took in sorted(events):
        tokens = min(float(capacity), tokens + (0 if last is None else now - last) * capacity / 60)
        last = now
        if tokens >= 1:
            tokens, granted = tokens - 1, granted + 1
        if bad:
            capacity, streak, violations = max(1, int(capacity * 0.7)), 0, violations + 1
        elif streak + 1 >= 20:
            capacity, streak = min(capacity + 1, most), 0
        else:
            streak += 1
        latency = took if latency is None else 0.8 * latency + 0.2 * took
        success = float(not bad) if success is None else 0.8 * success + 0.2 * (not bad)
    return capacity, streak, violations, tokens, granted, latency, success


def test_streaming_limiter_equals_the_fold(spark, tmp_path):
    events = [(p, float(i * (p + 1) // 2 * 2), i % 23 == 22, float(i % 7)) for p in range(2) for i in range(90)]
    for k, part in enumerate((events[:46] + events[90:120], events[46:90] + events[120:])):
        pd.DataFrame([(f"p{p}", *x) for p, *x in part[::-1]], columns=["provider", "seconds", "violation", "latency"]).to_parquet(tmp_path / f"{k}.parquet")
        time.sleep(0.05)
    stream = spark.readStream.schema("provider string, seconds double, violation boolean, latency double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = []
    q = L.limiter_stream(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).foreachBatch(lambda b, _: out.append(b.collect())).trigger(availableNow=True).start()
    q.awaitTermination(120)
    for p in range(2):
        capacity, streak, violations, tokens, granted, latency, success = plain_limiter([x for y, *x in events if y == p])
        rows = [r for batch in out for r in batch if r.provider == f"p{p}"]
        last = rows[-1]
        assert tuple(last)[1:4] == (capacity, streak, violations) and last.tokens == pytest.approx(tokens) and sum(r.granted for r in rows) == granted
        assert (last.latency, last.success, last.calls) == (pytest.approx(latency), pytest.approx(success), 90)
        assert last.used == pytest.approx(1 - min(1, tokens / capacity)) and last.score == pytest.approx(L.score_value(last.latency, last.success, last.used, 90, 90))


def test_folds_carry_states_over_batches(spark):
    rows = [(i % 3 if i % 7 else None, i // 2, i % 5 == 0) for i in range(900)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        got = L.folded(spark.createDataFrame(rows, "k long, t long, bad boolean"), "k", ["t", "bad"], ["bad"], (6, 0, 0), L.aimd(9), L.AIMD).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    step = L.aimd(9)
    for k in (0, 1, 2, None):
        state = (6, 0, 0)
        for _, _, bad in sorted((x for x in rows if x[0] == k), key=lambda x: x[1:]):
            state = step(state, bad)
        assert [tuple(r)[1:] for r in got if r.k == k] == [state]
    assert L.folded(spark.createDataFrame([], "k long, t long"), "k", ["t"], ["t"], (0,), lambda s, t: s, "n long").count() == 0


def test_stored_tables_can_be_cleared(spark):
    from corvane.operators import materialise

    kept = materialise._written[:]
    materialise._written.clear()
    try:
        df = materialise.stored(spark.range(3))
        assert df.count() == 3 and materialise.clear(spark) == 1 and materialise.clear(spark) == 0
        with pytest.raises(Exception, match="does not exist|FILE_NOT_EXIST|PATH_NOT_FOUND"):
            spark.read.parquet(df.inputFiles()[0]).count()
    finally:
        materialise._written.extend(kept)


def test_gated_stream_writes_each_record_once(spark, tmp_path):
    src, table = tmp_path / "in", str(tmp_path / "table")
    src.mkdir()
    for k, rows in enumerate(([(1, 0), (2, 1 << 40), (2, 1 << 40)], [(1, 0), (3, 3), (4, (1 << 50) - 1)])):
        pd.DataFrame(rows, columns=["sid", "h"]).to_parquet(src / f"{k}.parquet")
        time.sleep(0.05)
    stream = spark.readStream.schema("sid long, h long").option("maxFilesPerTrigger", 1).parquet(str(src))
    T.gated_writer(stream, table, str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(r.sid for r in spark.read.parquet(table).collect()) == [1, 4]


def test_calls_go_to_providers_by_score_and_capacity(spark):
    from corvane.plans import pool as P

    providers = spark.createDataFrame([("slow", 3.0, 0.9, 0.1, 50, 2), ("good", 0.5, 1.0, 0.1, 50, 3), ("full", 0.5, 1.0, 1.0, 50, 0)], P.FIELDS)
    calls = spark.createDataFrame([(i * 3, "x") for i in range(40)], "sid long, provider string")
    got = [r.provider for r in P.allot(calls, providers).orderBy("sid").collect()]
    assert got == (["good"] * 3 + ["full"] + ["slow"] * 2) * 6 + ["good"] * 3 + ["full"]
    after = {r.name: r for r in P.updated(providers, spark.createDataFrame([("good", False), ("good", True)], "provider string, ok boolean")).collect()}
    assert after["good"].success == pytest.approx(0.9) and after["good"].calls == 52 and after["slow"].success == 0.9
    assert P.allot(calls.limit(0), providers).collect() == []
    f = spark.createDataFrame([(6.0, 1.0, False), (60.0, 1.0, True), (6000.0, 99.0, False), (60.0, 0.0, False)], "q double, l double, v boolean")
    assert [r[0] for r in f.select(P.concurrency_of(F.col("q"), F.col("l"), F.col("v"))).collect()] == [Q.concurrency(6), Q.concurrency(60, 1.0, True), Q.concurrency(6000, 99.0), Q.concurrency(60, 0.0)]


def test_generation_with_several_models(spark):
    def broken(call):
        raise ConnectionError("no route")

    from corvane.plans import pool as P

    providers = spark.createDataFrame([("a", 0.1, 1.0, 0.1, 50, 2), ("b", 0.5, 1.0, 0.1, 50, 2)], P.FIELDS)
    out = G.generate(Q.schedule(spark, 6), {"a": broken, "b": G.stub_model}, attempts=1, providers=providers)
    accepted, failures = {r.sid for r in out.accepted.collect()}, {r.sid: r.error for r in out.failures.collect()}
    assert {sid for sid, e in failures.items() if "ConnectionError: no route" in e} == {1, 2, 5, 6} and accepted <= {3, 4} and accepted
    assert all("SimHash" in e for sid, e in failures.items() if sid not in (1, 2, 5, 6))


def test_backoff():
    calls, pauses = iter([(429, None, None), (503, None, 2.0), (200, "ok", None)]), []
    assert L.with_backoff(lambda: next(calls), sleep=pauses.append) == "ok" and pauses == pytest.approx([0.8, 0.8 * 1.8 + 2.0])
    with pytest.raises(RuntimeError, match="429"):
        L.with_backoff(lambda: (429, None, None), sleep=lambda _: None)


def test_provider_scores(spark):
    df = spark.createDataFrame([("a", 1.0, 0.9, 0.95, 100, 50), ("b", 0.2, 1.0, 0.1, 100, 3)], "name string, l double, s double, u double, t long, n long")
    scored = df.withColumn("score", L.provider_score(*map(F.col, "lsutn")))
    assert [r.score for r in scored.collect()] == pytest.approx([L.score_value(1.0, 0.9, 0.95, 100, 50), L.score_value(0.2, 1.0, 0.1, 100, 3)])
    assert L.pick_provider(scored, "name", "score").first().name == "b"


def test_entry_without_optional_parts(spark):
    import __spark_entry__ as entry

    assert {"rule_reasons", "near_pairs_exact", "record_items", "run_records"} <= entry.queries().keys() and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["doc_id", "errors", "warnings"]
