import hashlib
import re

import pytest
from pyspark.sql import functions as F

from corvane import schema as S
from corvane.functions import json_text as J
from corvane.functions import text as X
from corvane.functions.simhash import simhash64


def apply(spark, values, *columns):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


def one(spark, values, column):
    return [r[0] for r in apply(spark, values, column)]


T = F.col("t")


def test_single_paragraph(spark):
    cases = {"- item": True, "1. x": False, "12.5 分": False, "a\n1. x": True, "a\n\nb": False, "a\n　\nb": False, "３. x": False, "": True, None: False, "•. x": False}
    assert one(spark, list(cases), X.is_single_paragraph(T)) == list(cases.values())


def test_blanks_grams_and_tokens(spark):
    assert one(spark, [" a　b\tc ", ""], X.without_blanks(T)) == ["abc", ""]
    assert one(spark, ["　x\n"], X.stripped(T)) == ["x"]
    assert one(spark, ["a bcd", "ab", "😀漢字x"], X.char_ngrams(T, 3)) == [["abc", "bcd"], [], ["😀漢字", "漢字x"]]
    assert one(spark, ["a，b c。d", "，"], X.char_tokens(T)) == [["a", "b", "c", "d"], []]


def test_simhash_equals_a_plain_restatement(spark):
    def plain(t):
        t = re.sub(r"\s+", "", t)
        votes = [0] * 64
        for i in range(len(t) - 2):
            v = int(hashlib.md5(t[i : i + 3].encode()).hexdigest(), 16) & (1 << 64) - 1
            for b in range(64):
                votes[b] += 1 if v >> b & 1 else -1
        x = sum(1 << b for b in range(64) if votes[b] >= 0)
        return x - (1 << 64) if x >> 63 else x

    texts = ["", "ab", "abc", "abcabc", "漢字 かな 漢字", "hello world " * 20, "😀😀😀😀", "a b c d"]
    assert one(spark, texts, simhash64(T)) == [plain(t) for t in texts]
    assert one(spark, [""], simhash64(T)) == [-1]


def test_simhash_is_computed_once_in_batches_of_bounded_bytes(spark):
    hashed = spark.createDataFrame([(1, "some text")], "i int, t string").select("i", simhash64(T).alias("h")).where("h is not null")
    assert hashed._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").lower().rstrip("b")) <= 4 << 20


def test_simhash_keeps_a_bounded_number_of_grams(monkeypatch):
    from corvane.functions import simhash

    texts = ["".join(chr(97 + (i * k * k) % 26) for i in range(60)) for k in range(1, 9)]
    want = list(simhash._hashes(texts))
    monkeypatch.setattr(simhash, "_KEPT", 20)
    monkeypatch.setattr(simhash, "_ROWS", 7)
    assert [simhash._hashes([t])[0] for t in texts] == want and len(simhash._kept[0]) <= 20


def test_polarities(spark):
    def plain(t):
        c = {w: len(re.findall(w, t)) for w in S.POLARITY}
        n = sum(c.values())
        return sum(S.POLARITY[w] * k for w, k in c.items()) / n if n else 0.0

    texts = ["较高", "中上", "较低而高", "", "无"]
    assert one(spark, texts, X.polarity(T)) == pytest.approx([plain(t) for t in texts])
    got = one(spark, ["抑郁风险、焦虑风险低风险", "综合心理状况较高，幸福指数低", "抑郁风险轻度，焦虑风险重度", ""], X.psychology_polarity(T))
    assert got == pytest.approx([-0.2, (0.8 - 1.0) / 2, (-0.4 - 1.0) / 2, 0.0])


def test_levels(spark):
    assert one(spark, ["中中上低较低", "中", "中上"], X.lowish_count(T)) == [3, 1, 0]
    assert one(spark, ["可行性：中上，较低", "可行性中", "可行性" + "x" * 13 + "高"], X.dimension_level(T, "可行性")) == ["中上", "中", ""]
    assert one(spark, ["偏高", "其他", "低"], X.normalised_level(T, F.lit(""))) == [S.LEVELS[0], "其他", S.LEVELS[2]]
    assert one(spark, ["高"], X.normalised_level(T, F.lit(S.LEVELS[3]))) == [S.LEVELS[3]]
    assert X.parse_level_mix("高:3,low:1")[S.LEVELS[0]] == 0.75
    assert X.parse_level_mix("高0.25") == X.parse_level_mix("高:x") == X.parse_level_mix(None) == {x: 0.25 for x in S.LEVELS}


def test_jaccard_and_bar(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), (["a"], [])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(X.jaccard(F.col("a"), F.col("b"))).collect()] == [pytest.approx(1 / 3), 0.0]
    assert one(spark, ["x"], X.ascii_bar(F.lit(0.5), 4)) == ["██░░"]
    assert one(spark, ["x"], X.hamming(F.lit(-1).cast("long"), F.lit(0).cast("long"))) == [64]


def test_key_text_reads_null_as_none(spark):
    assert one(spark, [None, "a"], X.key_text([T, F.lit("b")])) == ["None｜b", "a｜b"]


def test_json_repair_and_content(spark):
    texts = ['```json\n{"a": 1}\n```', 'so: {"a": 1}, ok', "none", '{"a": 1}']
    assert one(spark, texts, J.field(J.repaired(T), "a", "long")) == [1, 1, None, 1]
    bodies = ['{"choices":[{"message":{"content":"x"}}]}', '{"output_text":"y"}', '{"choices":[{"message":{"content":[{"text":"a"},{"text":"b"}]}}]}', "plain", '{"choices":[{"content":["p",{"content":"q"},{"text":1},5]}]}', '{"choices":[],"text":3,"result":"r"}', '{"a":1}']
    assert one(spark, bodies, J.response_content(T)) == ["x", "y", "ab", "plain", "pq", "r", '{"a":1}']


def test_kinds_and_presence(spark):
    values = ['{"a": 0}', '{"a": false}', '{"a": null}', '{"a": " 　"}', '{"a": []}', '{"a": {}}', '{"a": "x"}', "{}", '{"a": 15.0}', '{"a": [1]}']
    v = J.field(F.try_parse_json(T), "a")
    assert one(spark, values, J.non_empty(v)) == [True, True, False, False, False, False, True, False, True, True]
    assert one(spark, values, J.as_text(v)) == ["0", "false", "None", " 　", "[]", "{}", "x", "", "15", "[1]"]
    assert one(spark, values, J.kind_of(v))[:3] == ["integer", "boolean", "null"]


@pytest.mark.parametrize(
    ("record", "keys"),
    [
        ('{"id":1,"name":"a","age":9,"grade":"g","gender":"男"}', ["id", "姓名", "年龄", "年级", "性别"]),
        ('{"development_stage":{},"advantageSubjects":["a"],"weakSubjects":["b"],"academicLevel":"x"}', ["发展阶段", "擅长科目", "薄弱科目", "学术水平"]),
        ('{"student_id":2,"persona":"p","morals":"m","psychological":"s","socialRelationships":"r"}', ["id", "人格", "价值观", "心理健康", "社交关系"]),
        ('text {"name":"a","agent_name":"b","development":{}} text', ["姓名", "代理名", "发展阶段"]),
    ],
)
def test_other_field_names(spark, record, keys):
    columns = [J.field_by_alias(J.repaired(T), k).isNotNull() for k in keys]
    assert all(apply(spark, [record], *columns)[0])
    assert one(spark, ['{"姓名":"x","name":"y"}'], J.field_by_alias(J.repaired(T), "姓名", "string")) == ["x"]
