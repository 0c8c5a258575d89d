import json

import pytest
from pyspark.sql import functions as F

from corvane import schema as S
from corvane.operators import rules
from corvane.plans import evaluate
from corvane.plans.generate import AGENTS, Call, stub_model
from corvane.sources import records as R
from corvane.sources import sinks as K


def good(i=1, **changes):
    facts = {"id": i}
    for a in AGENTS:
        facts |= json.loads(stub_model(Call(a.name, {"id": i, "_采样约束": {"年级": "五年级", "性别": "女", "目标学术水平": S.LEVELS[1]}}, "", 1.0, 1)))
    facts |= changes
    return {k: v for k, v in facts.items() if v != "gone"}


def write(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in lines), encoding="utf-8")


def frame(spark, records):
    return R.normalised(spark.createDataFrame([(i, json.dumps(r, ensure_ascii=False)) for i, r in enumerate(records)], "row_idx long, t string").select("row_idx", F.parse_json("t").alias("record")))


def messages(spark, record, profile="full"):
    r = rules.per_item(frame(spark, [record]), profile).first()
    return r.errors, r.warnings


def test_reading_skips_blank_and_malformed_lines_in_path_order(spark, tmp_path):
    write(tmp_path / "students_chunk_10.jsonl", [{"id": 3}, "", "bad{", "[1]"])
    write(tmp_path / "students_chunk_2.jsonl", [{"id": 1, "a": 1}, '{"id": 5, "id": 6}', "   "])
    rows = R.numbered(R.read_records(spark, str(tmp_path), chunked=True)).orderBy("row_idx").select("row_idx", F.to_json("record")).collect()
    assert [(r[0], json.loads(r[1])["id"]) for r in rows] == [(0, 3), (1, 1), (2, 6)]
    assert [r.line for r in R.read_quarantine(spark, str(tmp_path), chunked=True).collect()] == ["bad{", "[1]"]
    assert sorted(r.lines for r in R.line_counts(spark, str(tmp_path)).collect()) == [2, 3]
    records = R.read_records(spark, str(tmp_path), chunked=True)
    assert sorted(r.sid for r in R.completed_ids(records).collect()) == [1, 3, 6]
    assert tuple(R.progress(records).first()) == (10, 1)
    assert [json.loads(r[0])["id"] for r in R.preview(records, 2).select(F.to_json("record")).collect()] == [1, 6]


def test_runs(spark, tmp_path):
    for run in ("b", "a"):
        write(tmp_path / run / "students_chunk_1.jsonl", [good(1), good(2, 学术水平="x")])
    assert [r.run_id for r in R.list_runs(spark, str(tmp_path)).collect()] == ["a", "b"]
    runs = evaluate.evaluate_runs(spark, str(tmp_path))
    assert sorted(tuple(r)[:3] for r in runs.collect()) == [("a", 2, 0.5), ("b", 2, 0.5)]
    K.save_index(runs, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "_index.json")).count() == 2


def test_index_of_runs_has_all_measures(spark, tmp_path):
    write(tmp_path / "a" / "students_chunk_1.jsonl", [good(1), good(2, 学术水平="x"), good(1)])
    write(tmp_path / "b" / "students_chunk_1.jsonl", [good(3)])
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "students_chunk_1.jsonl").write_text("bad{\n")
    rows = {r.run_id: r for r in evaluate.evaluate_runs(spark, str(tmp_path), str(tmp_path / "eval")).collect()}
    assert sorted(rows) == ["a", "b"] and rows["a"].near_duplicate_pairs >= 1 and rows["b"].near_duplicate_pairs == 0
    for run, r in rows.items():
        s = evaluate.evaluate(spark, str(tmp_path / run), "chunk").summary
        assert (r.distinct_1, r.distinct_2, r.score_overall_0_100) == (s["distinct_1"], s["distinct_2"], s["score"])
        assert spark.read.json(str(tmp_path / "eval" / run / "per_item.jsonl")).count() == r.records


def test_index_of_many_runs_takes_no_more_jobs(spark, tmp_path):
    for run in range(6):
        write(tmp_path / f"r{run}" / "students_chunk_1.jsonl", [good(1), good(2, 姓名="x" * (run + 1)), good(1), good(3, 价值观="另一段 文字 " * 9), good(4, 价值观=f"第 {run} 段 话")])
        write(tmp_path / f"r{run}" / "students_chunk_2.jsonl", [good(5), good(6)][: run % 3])
    tracker, taken = spark.sparkContext.statusTracker(), []
    for n in (2, 6):
        spark.sparkContext.setJobGroup(f"runs{n}", "index")
        records = R.read_run_records(spark, str(tmp_path)).where(F.col("run_id") < f"r{n}")
        rows = {r.run_id: r for r in evaluate.run_index(records).collect()}
        taken.append(len(tracker.getJobIdsForGroup(f"runs{n}")))
        assert len(rows) == n
    spark.sparkContext.setJobGroup("", "")
    assert abs(taken[1] - taken[0]) <= 3
    for run in (0, 5):
        s = evaluate.evaluate(spark, str(tmp_path / f"r{run}"), "chunk", limit=None).summary
        r = rows[f"r{run}"]
        assert (r.records, r.error_rate, r.warning_rate, r.near_duplicate_pairs) == tuple(s[k] for k in ("n", "error_rate", "warning_rate", "near_duplicate_pairs"))
        assert (r.distinct_1, r.distinct_2, r.score_overall_0_100) == pytest.approx((s["distinct_1"], s["distinct_2"], s["score"]))


def test_last_chunk_alone_is_read(spark, tmp_path):
    for n in (1, 9, 10):
        write(tmp_path / f"students_chunk_{n}.jsonl", [good(n * 10 + k) for k in range(n)])
    last = R.read_last_chunk(spark, str(tmp_path))
    assert [f.rsplit("/", 1)[1] for f in last.inputFiles()] == ["students_chunk_10.jsonl"]
    assert tuple(R.progress(last).first()) == tuple(R.progress(R.read_records(spark, str(tmp_path), chunked=True)).first()) == (10, 10)
    assert [json.loads(r[0])["id"] for r in R.preview(last, 2).select(F.to_json("record")).collect()] == [108, 109]
    (tmp_path / "none").mkdir()
    assert R.last_chunk(spark, str(tmp_path / "none")) is None


def test_names_in_failures_by_automaton(spark, monkeypatch):
    names = ["QWEN-1", "qwen-12", "", None, "a", "QWEN-2", "nobody", "Ä.B|*"]
    texts = ["x qwen-12 QWEN-12", "QWEN-1", None, "", "ä.b|* qwen-2", "b"] * 3
    frames = spark.createDataFrame([(t,) for t in texts], "error string"), spark.createDataFrame([(n,) for n in names], "name string")
    wanted = {n: sum(n is not None and t is not None and n.lower() in t.lower() for t in texts) for n in names}
    for most in (R.NAME_BYTES, 8):  # several passes
        monkeypatch.setattr(R, "NAME_BYTES", most)
        rows = R.failures_by_provider(*frames).collect()
        assert {r.name: r.failures for r in rows} == wanted and [r.failures for r in rows] == sorted(wanted.values(), reverse=True)
    monkeypatch.undo()
    many = spark.range(12_000).select(F.format_string("name%dx", "id").alias("name"))
    assert R.failures_by_provider(frames[0].limit(1).select(F.lit("Name77x name11999x").alias("error")), many).where("failures > 0").count() == 2


def test_schedules(spark, tmp_path):
    slot = {"年级": "初一", "性别": "男", "优势学科偏向": ["理科向"], "目标学术水平": S.LEVELS[0]}
    write(tmp_path / "ui.json", [json.dumps([{"sid": 1, "slot": slot}, {"sid": "2", "slot": slot}, {"sid": 3, "slot": None}, 5, {"sid": 1, "slot": slot | {"年级": "初二"}}])])
    got = R.read_schedule(spark, str(tmp_path / "ui.json")).collect()
    assert [(r.sid, r.slot["年级"]) for r in got] == [(1, "初二")]
    write(tmp_path / "cli.json", [json.dumps([slot, slot])])
    assert sorted(r.sid for r in R.read_schedule(spark, str(tmp_path / "cli.json")).collect()) == [1, 2]
    assert R.read_schedule(spark, str(tmp_path / "none.json")).count() == 0


def test_a_good_record_passes_all_rules(spark):
    assert messages(spark, good()) == ([], [])
    assert frame(spark, [good(_采样约束={"目标学术水平": S.LEVELS[1]})]).select(rules.online_reasons()).first()[0] == []
    assert frame(spark, [good()]).select(rules.baseline_reasons()).first()[0] == []


BASELINE = [
    ({"年龄": "15"}, []), ({"年龄": 15.7}, []), ({"年龄": "15.7"}, ["age not whole"]), ({"年龄": 0}, ["missing 年龄", "age out of range"]), ({"年龄": 19}, ["age out of range"]), ({"年龄": None}, ["missing 年龄", "age not whole"]),
    ({"年龄": "gone"}, ["missing 年龄"]), ({"id": 0}, ["missing id"]), ({"擅长科目": "数学"}, ["subjects empty"]), ({"擅长科目": ["数学"], "薄弱科目": ["数学"]}, ["subjects overlap"]), ({"发展阶段": "x"}, ["stages not an object"]),
    ({"发展阶段": dict.fromkeys(S.STAGE_FIELDS[:2])}, [f"stage {S.STAGE_FIELDS[2]}"]), ({"人格": " "}, ["no text in 人格"]), ({"人格": ["x"]}, ["no text in 人格"]), ({"社交关系": "a\n 1. b"}, ["paragraph 社交关系"]), ({"社交关系": "a\n\nb"}, ["paragraph 社交关系"]),
    ({"性别": "x", "年级": 3, "学术水平": "高", "代理名": "li"}, ["academic level", "agent name", "gender", "grade"]),
]


def test_baseline_validator(spark):
    got = frame(spark, [good(**change) for change, _ in BASELINE]).select("row_idx", rules.baseline_reasons().alias("r")).collect()
    for r in got:
        assert r.r == BASELINE[r.row_idx][1], BASELINE[r.row_idx]
    assert len(got) == len(BASELINE)


def test_constraints(spark):
    rows = frame(spark, [good(年龄=15), good(年龄=15.0), good(年龄="15"), good(年级="初二"), good(年龄=True)])
    got = rows.orderBy("row_idx").select(rules.constraint("age_15"), rules.constraint("grade_chu2"), rules.constraint("unconstrained")).collect()
    assert [tuple(r) for r in got] == [(True, False, True), (True, False, True), (False, False, True), (False, True, True), (False, False, True)]


CHANGES = [
    ({"姓名": " "}, "缺失或为空：姓名", 0), ({"姓名": "gone"}, "缺失或为空：姓名", 0), ({"学术水平": "高"}, "学术水平", 0), ({"薄弱科目": "语文"}, "薄弱科目", 0), ({"薄弱科目": ["数学"], "擅长科目": ["数学"]}, "相交", 0),
    ({"代理名": "li"}, "代理名", 0), ({"价值观": "a\n\nb" * 40}, "非单段", 0), ({"价值观": "x" * 100}, "七维", 1), ({"创造力": "x" * 100}, "八维", 1), ({"心理健康": "x" * 100}, "槽位", 1), ({"年龄": 15.0}, "年龄非整数", 1),
    ({"年龄": "15"}, "年龄非整数", 1), ({"年龄": True}, "年龄-年级", 1), ({"年龄": 20}, "年龄-年级", 1), ({"发展阶段": dict(zip(S.STAGE_FIELDS, ("形式运算", "x", "y"), strict=True))}, "形式运算", 1), ({"心理健康": "背景" + "x" * 77}, "过短", 1),
    ({"心理健康": "背景" + "x" * 799}, "过长", 1),
]


def test_each_rule(spark):
    got = rules.per_item(frame(spark, [good(**change) for change, *_ in CHANGES])).collect()
    for r in got:
        _, word, severity = CHANGES[r.row_idx]
        assert any(word in m for m in (r.errors, r.warnings)[severity]), CHANGES[r.row_idx]
    assert len(got) == len(CHANGES)


NAMES = [
    ("li1_huan4ying1", 1, 1, 1), ("wang2_xiao3_ming2", 1, 1, 0), ("a1_b2_c3_d4_e5", 0, 1, 0), ("li1_", 0, 0, 0), ("li1", 0, 0, 0), ("li1_huan4\n", 0, 0, 1), ("ou3yang2_ming2hao3", 1, 1, 1), ("a1b2c3_d1", 0, 0, 0), ("Li1_a2", 0, 0, 0),
]


def test_agent_names(spark):
    n = F.col("n")
    df = spark.createDataFrame([(x[0],) for x in NAMES], "n string").select("n", rules.name_ok_full(n), rules.name_ok_chunk(n), rules.name_ok_online(n))
    assert {tuple(r) for r in df.collect()} == {(name, *map(bool, ok)) for name, *ok in NAMES}


def test_profiles_differ(spark):
    child = good(年级="一年级", 年龄=15)
    assert any("年龄-年级" in m for m in messages(spark, child)[1]) and not any("年龄-年级" in m for m in messages(spark, child, "chunk")[1])


def test_online_filter_asks_for_low_levels(spark):
    r = good(_采样约束={"目标学术水平": S.LEVELS[3]}, 价值观="道德修养高" + "，法治意识高" * 12, 心理健康="综合心理状况高，幸福指数高，抑郁风险低，焦虑风险低")
    reasons = frame(spark, [r]).select(rules.online_reasons()).first()[0]
    assert any("价值观等级分布过高" in x for x in reasons) and sum("心理健康与锚不符" in x for x in reasons) == 2


def test_canonical_form(spark):
    rows = [{"extra": 1, "id": 1, "年龄": None, "擅长科目": "语文", "薄弱科目": None, "发展阶段": "x"}]
    text = frame(spark, rows).select(K.canonical()).first()[0]
    assert text == '{"id":1,"发展阶段":{"备注":"x"},"擅长科目":["语文"],"薄弱科目":[]}'


def test_appending_twice_writes_once(spark, tmp_path):
    d = str(tmp_path)
    rows = spark.createDataFrame([(i, json.dumps({"id": i})) for i in (1, 2, 12)], "sid long, t string").select("sid", F.parse_json("t").alias("record"))
    none = spark.createDataFrame([], "sid long")
    assert K.append_records(rows, none, d, 10).count() == 3
    done = R.completed_ids(R.read_records(spark, d, chunked=True))
    assert K.append_records(rows, done, d, 10).count() == 0
    assert R.read_records(spark, d, chunked=True).count() == 3 and K.next_sid(done, 12) == 3
    K.save_meta(spark, d, 12, 10)
    assert R.read_meta(spark, d) == {"total_n": 12, "chunk_size": 10} and R.read_meta(spark, d + "/none") == {}
    K.append_failures(spark.createDataFrame([(3, "e", 1)], "sid long, error string, attempts int"), d)
    assert spark.read.json(d + "/failures.jsonl").first().error == "e"


def test_providers(spark, tmp_path):
    p = tmp_path / "p.txt"
    p.write_text("﻿# list\nA|http://x|key|m|qpm=10\n{\"name\":\"B\",\"base_url\":\"u\",\"api_key\":\"k\",\"model\":\"m\"}\nbroken\n", encoding="utf-8")
    found, errors = R.load_providers(p)
    assert [(x.name, x.qpm) for x in found] == [("A", 10.0), ("B", 6)] and len(errors) == 1
    failures = spark.createDataFrame([("error at a",), ("b B",), ("x",), ("A again",)], "error string")
    counts = R.failures_by_provider(failures, R.providers_frame(spark, found))
    assert {r.name: r.failures for r in counts.collect()} == {"A": 2, "B": 1}
    bad = {r.name for r in K.unhealthy(counts, 2).collect()}
    assert K.remove_providers(str(p), bad, dry_run=True) == (["B"], ["A"]) and len(R.load_providers(p)[0]) == 2
    K.remove_providers(str(p), bad)
    assert [x.name for x in R.load_providers(p)[0]] == ["B"] and (tmp_path / "p.txt.bak").exists()
    with pytest.raises(ValueError, match="no provider"):
        p.write_text("broken")
        R.load_providers(p)


def test_safe_paths(tmp_path):
    assert K.is_safe_subpath(str(tmp_path), "a/b") and not K.is_safe_subpath(str(tmp_path), "../b")


@pytest.mark.parametrize("profile", ["full", "chunk"])
def test_evaluation_and_report(spark, tmp_path, profile):
    rows = [good(i) for i in range(1, 9)] + [good(9, 学术水平="x"), good(1)]
    write(tmp_path / ("merged_students.jsonl" if profile == "full" else "students_chunk_1.jsonl"), rows)
    plan = spark.createDataFrame([(i, ("五年级", "女", ["理科向"], S.LEVELS[1])) for i in range(1, 7)], f"sid long, slot {R._SLOT}")
    e = evaluate.evaluate(spark, str(tmp_path), profile, schedule=plan)
    assert e.summary["n"] == 10 and e.summary["error_rate"] == 0.1 and e.summary["near_duplicate_pairs"] >= 1
    assert 0 < e.summary["score"] <= 100 and e.suspicious.first().row_idx == 8
    if profile == "full":
        assert e.summary["plan_年级"] == 1.0 and 0 < e.summary["self_bleu"] <= 1 and e.summary["kl_性别"] > 0
    K.save_report(str(tmp_path / "out"), e.summary, e.items, e.near, e.suspicious, e.buckets)
    assert spark.read.json(str(tmp_path / "out" / "per_item.jsonl")).count() == 10
    assert "Dashboard" in spark.read.text(str(tmp_path / "out" / "dashboard.md")).first()[0]


def test_reports_list_all_lines(spark, tmp_path):
    buckets = spark.createDataFrame([("b", f"k{i:04d}", 1 + i % 3) for i in range(1500)], "bucket string, key string, count long")
    none = spark.createDataFrame([], "a int")
    K.save_report(str(tmp_path / "r"), {"n": 1500, "score": 0.12345}, none, none, none, buckets)
    lines = [r[0] for r in spark.read.text(str(tmp_path / "r" / "dashboard.md"), wholetext=False).collect()]
    assert len(lines) == 1507 and sum(x.startswith("b k") for x in lines) == 1500 and "- score: 0.1235" in lines
    parts = sorted(p for p in (tmp_path / "r" / "dashboard.md").iterdir() if p.name.startswith("part"))
    text = "".join(p.read_text(encoding="utf-8") for p in parts).splitlines()
    assert text[0] == "# Dashboard" and text[6].startswith("b k0002 ") and text[-1] == "```" and text[6:-1] == sorted(text[6:-1], key=lambda x: (-int(x.split()[-1]), x.split()[1]))
    runs = spark.createDataFrame([(f"r{i:05d}", i) for i in range(1200)], "run_id string, records long")
    K.save_index(runs, str(tmp_path / "i"))
    assert spark.read.text(str(tmp_path / "i" / "overview.md")).count() == 1204 and spark.read.json(str(tmp_path / "i" / "_index.json")).count() == 1200


def test_required_fields_are_tested_once_each(spark):
    """The test of all fields isn't put into the test of each, and the index joins its features with nothing."""
    from corvane import record_queries as Q

    keys = spark.range(3).select(F.col("id").alias("key"), F.lit('{"id":1,"姓名":" "}').alias("line")).withColumn("record", F.try_parse_json("line")).drop("line")
    told = R.normalised(keys).select(F.array_join(Q.rules.required(["姓名", "id", "年龄"], "-"), "|").alias("m"))
    assert [r.m for r in told.collect()] == ["-姓名|-年龄"] * 3
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    assert "map_from_entries" not in plan and len(plan) < 200_000


def test_index_features_are_not_joined(spark, tmp_path, monkeypatch):
    spark.range(4).select(F.lit('{"id":1}').alias("value"), F.lit("a").alias("run"), F.lit("students_chunk_1.jsonl").alias("chunk")).write.partitionBy("run", "chunk").text(str(tmp_path / "runs"))
    written, keep = [], evaluate.stored
    monkeypatch.setattr(evaluate, "stored", lambda df: written.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df))
    (row,) = evaluate.run_index(R.read_run_records(spark, str(tmp_path / "runs"))).collect()
    # One join: the rows with their partition's first rank.
    assert row.records == 4 and written[0].count("Join") == 1


def test_merged_file_is_written_in_ranges(spark, tmp_path):
    """Several parts, whose names' order is that of the keys."""
    from corvane import record_queries as Q

    spark.range(1, 301).toDF("c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    lines = R.read_lines(spark, f"{Q._merged(spark, str(tmp_path))}/{R.MERGED}").where("line like '{%'").orderBy("place")
    got = lines.select("place.file", F.get_json_object("line", "$.id").cast("long").alias("id")).collect()
    assert [r.id for r in got] == [i for i in range(1, 301) if i % 5 in (0, 4)] and len({r.file for r in got}) > 1


def test_append_makes_lines_of_new_records_alone(spark, tmp_path, monkeypatch):
    from corvane.operators import materialise

    plans, keep = [], materialise.stored
    monkeypatch.setattr(materialise, "stored", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df))
    records = spark.range(1, 6).select(F.col("id").alias("sid"), F.try_parse_json(F.format_string('{"id":%d}', "id")).alias("record"))
    done = spark.createDataFrame([(2,), (3,)], "sid long")
    assert sorted(r.sid for r in K.append_records(records, done, str(tmp_path / "run"), 100).collect()) == [1, 4, 5]
    assert plans[0].index("array_join") < plans[0].index("LeftAnti")
