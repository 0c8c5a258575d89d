"""Queries over persona records, with the same rows in SQL.

A record is built for each customer: of every field one of a few JSON texts, chosen by arithmetic on the key, so that good, odd, missing, null and
wrongly typed values meet in all ways. Both sides build the same JSON lines; the queries then use the engine's operators, the SQL its own
functions of JSON and text.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane import schema as S
from corvane.functions import json_text as J
from corvane.functions import text as X
from corvane.functions.simhash import simhash64
from corvane.operators import dedup, metrics, rules
from corvane.operators.materialise import new_folder, stored
from corvane.plans import evaluate, quota
from corvane.queries import _DISTANCE, _HASHES, _hashed, _table, query
from corvane.sources import records as R
from corvane.sources import sinks as K

# --- the records ----------------------------------------------------------------------------------------------------------------

_PLAIN = "喜欢读书和运动，愿意倾听别人，做事认真细致，" * 5
_VALUE = "道德修养较高，身心健康中上，法治意识中，社会责任较低，政治认同高，文化素养低，家庭观念中。" + "她相信努力会有回报。" * 6
_CREATIVE = "流畅性中，新颖性较低，灵活性低，可行性较低，问题发现中上，问题分析中，提出方案高，改善方案低，总结：均衡。" + "他常有新的想法。" * 6
_CALM = "综合心理状况中上，幸福指数较高，抑郁风险低，焦虑风险低风险，背景稳定，家庭支持。" + "遇到转折会求助老师。" * 6


def _j(*values) -> list[str]:
    return [json.dumps(v, ensure_ascii=False, separators=(",", ":")) for v in values]


def _stage(*words: str) -> dict:
    return dict(sorted(zip(S.STAGE_FIELDS, words, strict=True)))


#: The JSON texts of each field, good ones first; None stands for a missing field.
_VARIANTS: dict[str, list[str | None]] = {
    "姓名": [*_j("李明", "王芳", "  ", "赵强"), None, "null", *_j("", "　")],
    "年龄": [*_j(7, 10, 12, 13, 15, 15.5, "15", True, 20, 6, 17, 9, 0, 11), None, "null", *_j("x", 16)],
    "性别": [*_j("男", "女", "x"), None],
    "年级": [*_j(*S.GRADES, "大一"), None],
    "发展阶段": [*_j(_stage("前运算阶段", "勤奋对自卑", "前习俗水平"), _stage("具体运算阶段", "身份与角色混淆", "常规水平"), _stage("形式运算阶段", "勤奋", "习俗水平"), "形式运算", {}, {S.STAGE_FIELDS[0]: "前运算"}), None],
    "代理名": [*_j("li1_huan4ying1", "wang2_xiao3_ming2", "a1_b2_c3_d4_e5", "li1_", "li1", "ou3yang2_ming2hao3", "a1b2c3_d1", "Li1_a2", "li1_huan4\n", "zhang1_shuang3", 5), None],
    "擅长科目": [*_j(["数学", "物理"], ["语文"], [], "数学", ["英语", "历史", "数学"]), None],
    "薄弱科目": [*_j(["历史", "地理"], ["数学"], []), "null", *_j(["体育"])],
    "学术水平": [*_j(*S.LEVELS, "高", "偏低"), None],
    "人格": [*_j("开朗", ["开朗", "认真"], "安静而细心", []), None],
    "价值观": [*_j(_VALUE, "身心健康高", "道德修养高\n\n家庭观念低", "1. 道德修养高，" * 3, _PLAIN, "道德修养高，" * 150, 5), None, "null", *_j("身心健康较高，" + _PLAIN)],
    "社交关系": [*_j("与同伴相处融洽，喜欢数学小组", "朋友不多", "a\n 1. 语文"), None],
    "创造力": [*_j(_CREATIVE.replace("提出方案高", "提出方案中"), _CREATIVE, "可行性低，提出方案较高，雷达图", _PLAIN, _VALUE, "流畅性高，新颖性高，雷达总结"), None],
    "心理健康": [*_j(_CALM, "综合心理状况低，幸福指数中，抑郁风险轻度，焦虑风险中度。", "抑郁风险、焦虑风险重度，" + _PLAIN, _PLAIN, "综合心理状况高，幸福指数高，抑郁风险低，焦虑风险低"), None],
    "_采样约束": [*({"目标学术水平": x} for x in S.LEVELS), {"年级": "初一"}, None],
}
_VARIANTS["_采样约束"] = [x and _j(x)[0] for x in _VARIANTS["_采样约束"]]


def _literal(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(map(_literal, values)) + "]"


def _step(i: int) -> tuple[int, int]:
    """Multiplier and divisor that choose the variant of the i-th field; every tenth record has the first one of each."""
    return 2 * i + 1, 3 * i + 7


def _lines(spark: SparkSession, sf_dir: str, in_order: bool = False) -> DataFrame:
    """(key, line); with ``in_order`` in the order of the keys, partition behind partition."""
    c = F.col("c_custkey")
    parts = [F.concat(F.lit('"id":'), c.cast("string"))]
    for i, (k, values) in enumerate(_VARIANTS.items()):
        m, d = _step(i)
        place = F.when(c % 10 == 0, 0).otherwise(F.pmod(c * m + F.floor(c / d), F.lit(len(values))))
        chosen = F.get(F.array(*(F.lit(v).cast("string") for v in values)), place.cast("int"))
        parts.append(F.concat(F.lit(f'"{k}":'), chosen))
    line = F.concat(F.lit("{"), F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull()), ","), F.lit("}"))
    # A few bytes a key become a record whose rules cost a thousand times as much as reading it, so a small file's keys are dealt out first, to a number of tasks that small rows would else be gathered from.
    keys, tasks = _table(spark, sf_dir, "customer").select("c_custkey"), spark.sparkContext.defaultParallelism
    keys = keys.repartitionByRange(tasks, "c_custkey").sortWithinPartitions("c_custkey") if in_order else keys.repartition(tasks, "c_custkey")
    return keys.select(c.alias("key"), line.alias("line"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).withColumn("record", F.try_parse_json("line"))


def _normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.normalised(_records(spark, sf_dir).drop("line"))


def _chosen_sql(i: int, k: str, values: list[str | None]) -> str:
    m, d = _step(i)
    return f"'\"{k}\":' || ({_list(values)})[(CASE WHEN c_custkey % 10 = 0 THEN 0 ELSE (c_custkey * {m} + c_custkey // {d}) % {len(values)} END + 1)::INT]"


_LINES = f"""lines AS (SELECT c_custkey AS key, '{{' || array_to_string(list_filter(['"id":' || c_custkey, {', '.join(_chosen_sql(i, k, v) for i, (k, v) in enumerate(_VARIANTS.items()))}], lambda p: p IS NOT NULL), ',') || '}}' AS line FROM customer)"""
_BLANK = r"[\s\x{3000}]"
#: Columns of the SQL side: k0.. the kinds and t0.. the texts of the fields, in their order.
_NAMES = list(_VARIANTS)


def _k(name: str) -> str:
    return f"k{_NAMES.index(name)}"


def _t(name: str) -> str:
    return f"t{_NAMES.index(name)}"


def _v(name: str) -> str:
    return f"v{_NAMES.index(name)}"


_VALUES_SQL = ", ".join(f"json_extract(line, '$.\"{k}\"') AS v{i}, json_type(line, '$.\"{k}\"') AS k{i}" for i, k in enumerate(_NAMES))
_TEXTS_SQL = ", ".join(f"CASE WHEN k{i} IS NULL THEN '' WHEN k{i} = 'NULL' THEN 'None' WHEN k{i} = 'VARCHAR' THEN v{i} ->> '$' ELSE v{i}::VARCHAR END AS t{i}" for i in range(len(_NAMES)))
_AGE_KIND, _AGE = _k("年龄"), f"CASE WHEN {_k('年龄')} IN ('UBIGINT', 'BIGINT') THEN {_v('年龄')}::BIGINT WHEN {_k('年龄')} = 'BOOLEAN' THEN ({_v('年龄')}::VARCHAR = 'true')::BIGINT END"
_TARGET = f"json_extract_string({_v('_采样约束')}, '$.\"目标学术水平\"')"
_STAGES = ", ".join(f"CASE WHEN {_k('发展阶段')} = 'OBJECT' THEN coalesce(json_extract_string({_v('发展阶段')}, '$.\"{x}\"'), '') END AS s{i}" for i, x in enumerate(S.STAGE_FIELDS))
_RECORDS = f"{_LINES}, found AS (SELECT key, line, {_VALUES_SQL} FROM lines), texts AS (SELECT *, {_TEXTS_SQL}, {_AGE} AS age, {_TARGET} AS target, {_STAGES} FROM found)"


def _messages(*cases: str) -> str:
    return f"list_filter([{', '.join(cases)}], lambda m: m IS NOT NULL)"


def _case(condition: str, message: str) -> str:
    return f"CASE WHEN {condition} THEN {message} END"


def _present(k: str) -> str:
    """SQL for a value that isn't empty."""
    if k == "id":
        return "true"
    return f"CASE WHEN {_k(k)} IS NULL OR {_k(k)} = 'NULL' THEN false WHEN {_k(k)} = 'VARCHAR' THEN NOT regexp_full_match({_t(k)}, '{_BLANK}*') WHEN {_k(k)} IN ('ARRAY', 'OBJECT') THEN {_t(k)} NOT IN ('[]', '{{}}') ELSE true END"


def _has(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def _required(fields: list[str], label: str) -> str:
    return _messages(*(_case(f"NOT ({_present(k)})", f"'{label}{k}'") for k in fields))


_LEVEL_LIST = ", ".join(f"'{x}'" for x in S.LEVELS)
_V, _C, _P = _t("价值观"), _t("创造力"), _t("心理健康")


def _strings(k: str) -> str:
    return f"CASE WHEN {_k(k)} = 'ARRAY' THEN json_extract_string({_v(k)}, '$[*]') ELSE []::VARCHAR[] END"


_GOOD, _WEAK = _strings("擅长科目"), _strings("薄弱科目")
_ACADEMIC = _messages(
    _case(f"{_t('学术水平')} NOT IN ({_LEVEL_LIST})", "'学术水平非四选一固定文案'"), _case(f"len({_GOOD}) = 0", "'擅长科目为空或非数组'"),
    _case(f"len({_WEAK}) = 0", "'薄弱科目为空或非数组'"), _case(f"len(list_intersect({_GOOD}, {_WEAK})) > 0", "'擅长/薄弱科目集合相交'"),
)
_SYLLABLES = f"list_transform(string_split({_t('代理名')}, '_'), lambda p: CASE WHEN regexp_full_match(p, '([a-z]+[1-5])+') THEN len(regexp_extract_all(p, '[a-z]+[1-5]')) ELSE 0 END)"
_NAME_FULL = f"(len({_SYLLABLES}) >= 2 AND NOT list_contains({_SYLLABLES}, 0) AND list_sum({_SYLLABLES}) BETWEEN 2 AND 4 AND ({_SYLLABLES})[1] BETWEEN 1 AND 2 AND list_sum({_SYLLABLES}) - ({_SYLLABLES})[1] BETWEEN 1 AND 3)"
_NAME_CHUNK = f"(len({_SYLLABLES}) >= 2 AND list_min({_SYLLABLES}) >= 1 AND list_max({_SYLLABLES}) <= 2)"
_NAME_ONLINE = rf"regexp_matches({_t('代理名')}, '^(?:[a-z]+[1-5]){{1,2}}_(?:[a-z]+[1-5]){{1,3}}\n?\z')"
_NAME_MESSAGE = "'代理名不合规（小写拼音+声调；姓/名用下划线分隔；复姓/名可1–2音节连写或分节）'"


def _single(k: str) -> str:
    return rf"(({_k(k)} IS NULL OR {_k(k)} = 'VARCHAR') AND NOT regexp_matches({_t(k)}, '(\n\s*\n)|(^\s*[-•\d]+\.)'))"


_PARAGRAPHS = _messages(*(_case(f"NOT {_single(k)}", f"'{k} 非单段体裁'") for k in S.PARAGRAPHS))
_VALUE_WORDS = _messages(_case(f"NOT {_has(_V, S.VALUE_DIMENSIONS)}", "'价值观未见七维显式名词（至少缺大部分）'"), _case(f"NOT {_has(_V, S.LEVEL_WORDS)}", "'价值观未见等级词'"))
_CREATIVITY_WORDS = _messages(
    _case(f"NOT {_has(_C, S.CREATIVITY_DIMENSIONS)}", "'创造力未见八维显式名词（至少缺大部分）'"),
    _case(f"{_has(_C, ['可行性较低', '可行性低'])} AND {_has(_C, ['提出方案高', '提出方案较高'])}", "'创造力一致性：可行性低但‘提出方案’高'"), _case(f"NOT {_has(_C, ['雷达', '总结'])}", "'创造力未见雷达总结提示词'"),
)
_PSYCHOLOGY_WORDS = _messages(
    _case(f"NOT {_has(_P, S.PSYCHOLOGY_WORDS)}", "'心理健康未见关键槽位关键词'"), _case(f"{_has(_V, ['身心健康高', '身心健康较高'])} AND contains({_P}, '重度')", "'一致性：价值观身心健康高/较高 ↔ 心理出现重度术语'"),
)


def _age_grade(ages: dict[str, tuple[int, int]]) -> str:
    low, high = (" ".join(f"WHEN '{g}' THEN {x[i]}" for g, x in ages.items()) for i in (0, 1))
    grade = _t("年级")
    shown = f"CASE WHEN {_AGE_KIND} = 'BOOLEAN' THEN CASE WHEN age = 1 THEN 'True' ELSE 'False' END ELSE age::VARCHAR END"
    return _messages(_case("age IS NULL", "'年龄非整数或缺失'"), _case(f"age < CASE {grade} {low} END - 1 OR age > CASE {grade} {high} END + 1", f"'年龄-年级非常模(年级:' || {grade} || ', 年龄:' || {shown} || ')'"))


_STAGE_AGE = _messages(
    _case("contains(s0, '前运算') AND age >= 10", "'发展阶段不一致：前运算阶段通常对应学前及低年级儿童'"),
    _case("contains(s0, '具体运算') AND (age < 7 OR age > 15)", "'发展阶段不一致：具体运算阶段通常对应约7–12岁儿童'"),
    _case("contains(s0, '形式运算') AND age < 11", "'发展阶段不一致：形式运算阶段通常对应11岁以上青少年'"),
    _case("contains(s1, '身份与角色混淆') AND age < 11", "'发展阶段不一致：身份与角色混淆多见于青春期阶段'"),
    _case("contains(s1, '勤奋') AND age > 15", "'发展阶段不一致：勤奋与自卑阶段多见于小学阶段儿童'"),
    _case("contains(s2, '常规水平') AND age < 9", "'发展阶段不一致：道德发展常规水平通常出现在9岁以上'"),
    _case("contains(s2, '前习俗') AND age > 13", "'发展阶段不一致：前习俗水平多见于儿童早期'"),
)


def _bare(text: str) -> str:
    return rf"regexp_replace({text}, '{_BLANK}+', '', 'g')"


_LENGTHS = _messages(
    *(c for k in S.PARAGRAPHS for c in (_case(f"length({_bare(_t(k))}) < 80", f"'{k} 段落过短(' || length({_bare(_t(k))}) || ')'"), _case(f"length({_bare(_t(k))}) > 800", f"'{k} 段落过长(' || length({_bare(_t(k))}) || ')'")))
)


def _chars(text: str) -> str:
    return rf"list_filter(list_distinct(string_split(regexp_replace({text}, '[ ，。、“”‘’？！：；,.!?\t\r\n｜]', '', 'g'), '')), lambda x: x <> '')"


def _similar(a: str, b: str) -> str:
    both = f"len(list_intersect({_chars(a)}, {_chars(b)}))"
    return f"CASE WHEN len({_chars(a)}) = 0 OR len({_chars(b)}) = 0 THEN 0.0 ELSE {both}::DOUBLE / (len({_chars(a)}) + len({_chars(b)}) - {both}) END"


_TEMPLATE = _messages(_case(f"greatest({_similar(_V, _C)}, {_similar(_V, _P)}, {_similar(_C, _P)}) >= 0.8", "'价值观/创造力/心理健康文本高度相似，疑似模板化'"))


def _rule(expression: str) -> str:
    return f"WITH {_RECORDS} SELECT key, array_to_string({expression}, '|') AS messages FROM texts"


def _told(df: DataFrame, messages: Column) -> DataFrame:
    return df.select("key", F.array_join(messages, "|").alias("messages"))


# --- rules of the evaluators ------------------------------------------------------------------------------------------------------


@query(_rule(_required(S.REQUIRED, "缺失或为空：")))
def record_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(_normal(spark, sf_dir), rules.required(S.REQUIRED, "缺失或为空："))


@query(_rule(_ACADEMIC))
def record_academic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(_normal(spark, sf_dir), rules.academic())


@query(f"WITH {_RECORDS} SELECT key, {_NAME_FULL} AS full_ok, {_NAME_CHUNK} AS chunk_ok, {_NAME_ONLINE} AS online_ok FROM texts")
def record_agent_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("代理名")
    return _normal(spark, sf_dir).select("key", rules.name_ok_full(name).alias("full_ok"), rules.name_ok_chunk(name).alias("chunk_ok"), rules.name_ok_online(name).alias("online_ok"))


@query(_rule(_PARAGRAPHS))
def record_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(_normal(spark, sf_dir), rules.paragraphs())


@query(_rule(_VALUE_WORDS))
def record_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(_normal(spark, sf_dir), rules.value_words())


@query(_rule(_CREATIVITY_WORDS))
def record_creativity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(_normal(spark, sf_dir), rules.creativity_words())


@query(_rule(_PSYCHOLOGY_WORDS))
def record_psychology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(_normal(spark, sf_dir), rules.psychology_words())


@query(f"WITH {_RECORDS} SELECT key, array_to_string({_age_grade(S.GRADE_AGES)}, '|') AS full_messages, array_to_string({_age_grade(S.GRADE_AGES_CHUNK)}, '|') AS chunk_messages FROM texts")
def record_age_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _normal(spark, sf_dir)
    return n.select("key", F.array_join(rules.age_and_grade(S.GRADE_AGES), "|").alias("full_messages"), F.array_join(rules.age_and_grade(S.GRADE_AGES_CHUNK), "|").alias("chunk_messages"))


@query(_rule(_STAGE_AGE))
def record_stage_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(_normal(spark, sf_dir), rules.stage_and_age())


@query(_rule(_LENGTHS))
def record_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(_normal(spark, sf_dir), rules.paragraph_lengths())


@query(_rule(_TEMPLATE))
def record_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(_normal(spark, sf_dir), rules.template_like())


_ERRORS = f"list_concat(list_concat({_required(S.REQUIRED, '缺失或为空：')}, {_ACADEMIC}), list_concat({_messages(_case(f'NOT {_NAME_FULL}', _NAME_MESSAGE))}, {_PARAGRAPHS}))"
_WARNINGS = f"list_concat(list_concat(list_concat({_VALUE_WORDS}, {_CREATIVITY_WORDS}), list_concat({_PSYCHOLOGY_WORDS}, {_age_grade(S.GRADE_AGES)})), list_concat(list_concat({_STAGE_AGE}, {_LENGTHS}), {_TEMPLATE}))"
_ITEMS = f"{_RECORDS}, items AS MATERIALIZED (SELECT *, {_ERRORS} AS errors, {_WARNINGS} AS warnings FROM texts)"


@query(f"WITH {_ITEMS} SELECT key, array_to_string(errors, '|') AS errors, array_to_string(warnings, '|') AS warnings FROM items")
def record_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All errors and warnings of the full evaluator."""
    return rules.per_item(_normal(spark, sf_dir)).select("key", F.array_join("errors", "|").alias("errors"), F.array_join("warnings", "|").alias("warnings"))


def _share(column: str, word: str) -> str:
    return f"avg((len(list_filter({column}, lambda m: contains(m, '{word}'))) > 0)::INT)::DOUBLE"


@query(f"""WITH {_ITEMS} SELECT count(*)::BIGINT AS n, avg((len(errors) > 0)::INT)::DOUBLE AS error_rate, avg((len(warnings) > 0)::INT)::DOUBLE AS warning_rate, {_share('errors', '缺失或为空')} AS missing_rate,
{_share('errors', '非单段体裁')} AS paragraph_rate, {_share('warnings', '年龄')} AS age_rate, {_share('errors', '学术水平')} AS level_rate FROM items""")
def record_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.rates(rules.per_item(_normal(spark, sf_dir)))


@query(f"WITH {_ITEMS} SELECT key, len(errors)::INTEGER AS n_errors, len(warnings)::INTEGER AS n_warnings FROM items ORDER BY 2 DESC, 3 DESC, 1 LIMIT 100")
def record_suspicious(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = metrics.suspicious(rules.per_item(_normal(spark, sf_dir)).select("key", "errors", "warnings"), "key")
    return top.select("key", F.size("errors").alias("n_errors"), F.size("warnings").alias("n_warnings"))


@query(f"WITH {_RECORDS} " + " UNION ALL ".join(f"SELECT '{k}' AS bucket, {_t(k)} AS key, count(*)::BIGINT AS count FROM texts GROUP BY 2" for k in ("年级", "性别", "学术水平")))
def record_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.bucket_counts(_normal(spark, sf_dir), "年级", "性别", "学术水平")


# --- the online filter and the validators of generation ----------------------------------------------------------------------------


def _level(text: str, key: str, words: str = "高|较高|中上|中|较低|低") -> str:
    return f"regexp_extract({text}, '{key}.{{0,12}}?({words})', 1)"


_SPLIT = f"string_split({_V}, '')"
_LOWISH = f"(len(list_filter(range(1, len({_SPLIT}) + 1), lambda i: ({_SPLIT})[i] = '中' AND coalesce(({_SPLIT})[i - 1], '') <> '中' AND coalesce(({_SPLIT})[i + 1], '') <> '上')) + len(regexp_extract_all({_V}, '较低|低')))"
_RANK = f"CASE target {' '.join(f'WHEN {_literal(S.LEVELS[i])} THEN {i}' for i in (1, 2, 3))} ELSE 0 END"
_LOW_DIMENSIONS = "(" + " + ".join(f"({_level(_C, d)} IN ('中', '较低', '低'))::INT" for d in S.CREATIVITY_DIMENSIONS) + ")"
_WORDS = "高|较高|中上|中|较低|低|轻度|中度|重度|低风险"
_ANCHORED = f"coalesce(target IN ({_literal(S.LEVELS[2])}, {_literal(S.LEVELS[3])}), false)"
_ONLINE = f"list_concat(list_concat({_required(S.REQUIRED_ONLINE, '缺字段或为空：')}, " + _messages(
    _case(f"{_t('学术水平')} NOT IN ({_LEVEL_LIST})", "'学术水平非四选一固定文案'"), _case(f"NOT {_NAME_ONLINE}", "'代理名不合规（需拼音分节+声调数字；姓1-2节，名1-3节）'")
) + f"), list_concat(list_concat({_PARAGRAPHS}, {_VALUE_WORDS}), " + _messages(
    _case(f"{_RANK} > 0 AND {_LOWISH} < {_RANK}", f"'价值观等级分布过高（锚=' || target || '）：需要≥' || {_RANK} || '处“中/较低/低”'"),
    _case(f"NOT {_has(_C, S.CREATIVITY_DIMENSIONS)}", "'创造力未见八维显式名词（至少缺大部分）'"), _case(f"NOT {_has(_C, ['雷达', '总结'])}", "'创造力未见雷达总结提示词'"),
    _case(f"{_RANK} > 0 AND {_LOW_DIMENSIONS} < {_RANK} + 1", f"'创造力八维整体偏高（锚=' || target || '）：要求≥' || ({_RANK} + 1) || '个维度为“中及以下”，当前=' || {_LOW_DIMENSIONS}"),
    _case(f"{_level(_C, '可行性')} IN ('较低', '低') AND {_level(_C, '提出方案')} IN ('高', '较高', '中上')", "'创造力一致性：可行性低但‘提出方案’高'"),
    _case(f"NOT {_has(_P, S.PSYCHOLOGY_WORDS[:-1])}", "'心理健康未见核心槽位关键词'"),
    _case(f"{_ANCHORED} AND NOT ({_level(_P, '综合心理状况', _WORDS)} IN ('中', '较低', '低') OR {_level(_P, '幸福指数', _WORDS)} IN ('中', '较低', '低'))", "'心理健康与锚不符：综合心理状况/幸福指数至少1处需“中或较低/低”'"),
    _case(f"{_ANCHORED} AND contains({_level(_P, '抑郁风险', _WORDS)}, '低') AND contains({_level(_P, '焦虑风险', _WORDS)}, '低')", "'心理健康与锚不符：抑郁/焦虑风险不应双双为‘低/低风险’'"),
) + "))"


@query(_rule(_ONLINE))
def record_online_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(_normal(spark, sf_dir), rules.online_reasons())


def _truthy(k: str) -> str:
    if k == "id":
        return "key <> 0"
    t = _t(k)
    return f"CASE WHEN {_k(k)} IS NULL OR {_k(k)} = 'NULL' THEN false WHEN {_k(k)} = 'VARCHAR' THEN {t} <> '' WHEN {_k(k)} IN ('ARRAY', 'OBJECT') THEN {t} NOT IN ('[]', '{{}}') WHEN {_k(k)} = 'BOOLEAN' THEN {t} = 'true' ELSE {t}::DOUBLE <> 0 END"


def _strict(k: str, values: list[str]) -> str:
    return f"({_k(k)} = 'VARCHAR' AND {_t(k)} IN ({', '.join(map(_literal, values))}))"


_INT = f"CASE WHEN {_AGE_KIND} = 'VARCHAR' THEN try_cast(CASE WHEN regexp_full_match(trim({_t('年龄')}), '[+-]?[0-9]+') THEN trim({_t('年龄')}) END AS BIGINT) WHEN {_AGE_KIND} = 'DOUBLE' THEN trunc({_t('年龄')}::DOUBLE)::BIGINT ELSE age END"
_BOTH = f"{_k('擅长科目')} IS NOT NULL AND {_k('薄弱科目')} IS NOT NULL"


def _baseline_paragraph(k: str) -> list[str]:
    blank = f"({_k(k)} <> 'VARCHAR' OR regexp_full_match({_t(k)}, '{_BLANK}*'))"
    listed = rf"(contains({_t(k)}, chr(10) || chr(10)) OR regexp_matches({_t(k)}, '(?m)^\s*[-•\d]+\.'))"
    return [_case(f"{_k(k)} IS NOT NULL AND {blank}", f"'no text in {k}'"), _case(f"{_k(k)} IS NOT NULL AND NOT {blank} AND {listed}", f"'paragraph {k}'")]


_BASELINE = _messages(
    *(_case(f"NOT ({_truthy(k)})", f"'missing {k}'") for k in S.REQUIRED),
    _case(f"{_k('学术水平')} IS NOT NULL AND NOT {_strict('学术水平', S.LEVELS)}", "'academic level'"), _case(f"{_k('代理名')} IS NOT NULL AND NOT {_NAME_ONLINE}", "'agent name'"),
    _case(f"{_k('性别')} IS NOT NULL AND NOT {_strict('性别', S.GENDERS)}", "'gender'"), _case(f"{_k('年级')} IS NOT NULL AND NOT {_strict('年级', S.GRADES)}", "'grade'"),
    _case(f"{_AGE_KIND} IS NOT NULL AND ({_INT}) IS NULL", "'age not whole'"), _case(f"{_AGE_KIND} IS NOT NULL AND ({_INT}) NOT BETWEEN 6 AND 18", "'age out of range'"),
    _case(f"{_BOTH} AND (len({_GOOD}) = 0 OR len({_WEAK}) = 0)", "'subjects empty'"), _case(f"{_BOTH} AND len(list_intersect({_GOOD}, {_WEAK})) > 0", "'subjects overlap'"),
    _case(f"{_k('发展阶段')} IS NOT NULL AND {_k('发展阶段')} <> 'OBJECT'", "'stages not an object'"),
    *(_case(f"{_k('发展阶段')} = 'OBJECT' AND json_type({_v('发展阶段')}, '$.\"{x}\"') IS NULL", f"'stage {x}'") for x in S.STAGE_FIELDS),
    *(c for k in ("人格", "价值观", "社交关系", "创造力", "心理健康") for c in _baseline_paragraph(k)),
)


@query(_rule(_BASELINE))
def record_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(_normal(spark, sf_dir), rules.baseline_reasons())


@query(f"WITH {_RECORDS} SELECT key, coalesce({_AGE_KIND} IN ('UBIGINT', 'DOUBLE') AND try_cast({_t('年龄')} AS DOUBLE) = 15, false) AS age_15, coalesce({_k('年级')} = 'VARCHAR' AND {_t('年级')} = '初二', false) AS grade_chu2, true AS unconstrained FROM texts")
def record_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normal(spark, sf_dir).select("key", *(rules.constraint(m).alias(m) for m in ("age_15", "grade_chu2", "unconstrained")))


@query(_rule(_messages(_case(f"{_t('学术水平')} NOT IN ({_LEVEL_LIST})", "'R14:学业画像:学术水平'"), _case(f"NOT {_NAME_ONLINE}", "'R6:学籍与发展阶段:代理名'"), _case(f"target <> '' AND {_t('学术水平')} <> target", "'R14-anchored:学业画像:学术水平'"))))
def record_local_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(_normal(spark, sf_dir), F.transform(rules.deep_issues(), lambda x: F.concat_ws(":", x["code"], x["owner"], F.array_join(x["fields"], ","))))


# --- text functions on records ------------------------------------------------------------------------------------------------------


def _count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


def _polarity(text: str) -> str:
    total = " + ".join(f"{_count(text, w)}" for w in S.POLARITY)
    return f"coalesce(({' + '.join(f'{_count(text, w)} * ({x})::DOUBLE' for w, x in S.POLARITY.items())}) / nullif({total}, 0), 0)::DOUBLE"


_STATE = [f"regexp_extract_all({_P}, '{k}.{{0,8}}?(高|较高|中上|中|较低|低)', 1)" for k in ("综合心理状况", "幸福指数")]
_WEIGHT = "CASE w " + " ".join(f"WHEN '{w}' THEN ({x})::DOUBLE" for w, x in S.POLARITY.items()) + " END"
_RISKS = [(_count(_P, f"(抑郁风险|焦虑风险).{{0,8}}?{w}"), x) for w, x in S.RISK_WORDS.items()]
_PSYCHOLOGY = f"""coalesce(({' + '.join(f'coalesce(list_sum(list_transform({s}, lambda w: {_WEIGHT})), 0)' for s in _STATE)} + {' + '.join(f'{c} * ({x})::DOUBLE' for c, x in _RISKS)})
 / nullif({' + '.join(f'len({s})' for s in _STATE)} + {' + '.join(c for c, _ in _RISKS)}, 0), 0)::DOUBLE"""


@query(f"WITH {_RECORDS} SELECT key, {_polarity(_V)} AS value_score, {_polarity(_C)} AS creativity_score, {_PSYCHOLOGY} AS psychology_score, {_LOWISH}::INTEGER AS lowish, {' || '.join(f'{_level(_C, d)}' + chr(32) + '||' + chr(32) + repr(',') for d in S.CREATIVITY_DIMENSIONS)} AS levels FROM texts")
def record_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, c, p = F.col("价值观"), F.col("创造力"), F.col("心理健康")
    levels = F.concat(*(x for d in S.CREATIVITY_DIMENSIONS for x in (X.dimension_level(c, d), F.lit(","))))
    return _normal(spark, sf_dir).select("key", X.polarity(v).alias("value_score"), X.polarity(c).alias("creativity_score"), X.psychology_polarity(p).alias("psychology_score"), X.lowish_count(v).alias("lowish"), levels.alias("levels"))


_PERSONA = f"CASE WHEN {_k('人格')} = 'ARRAY' THEN array_to_string(json_extract_string({_v('人格')}, '$[*]'), ' ') ELSE {_t('人格')} END"
_KEY_TEXT = " || '｜' || ".join(_PERSONA if k == "人格" else _t(k) for k in S.KEY_TEXT_FIELDS)


@query(f"WITH {_RECORDS} SELECT key, {_KEY_TEXT} AS key_text FROM texts")
def record_key_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normal(spark, sf_dir).select("key", X.key_text([F.col(k) for k in S.KEY_TEXT_FIELDS]).alias("key_text"))


@query(f"WITH {_RECORDS}, s AS (SELECT key, {_bare(_t('社交关系'))} AS t FROM texts) SELECT key, CASE WHEN length(t) < 3 THEN '' ELSE array_to_string(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3)), '/') END AS grams FROM s")
def record_char_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normal(spark, sf_dir).select("key", F.array_join(X.char_ngrams(F.col("社交关系"), 3), "/").alias("grams"))


@query(f"WITH {_RECORDS} SELECT key, coalesce(nullif(target, ''), CASE {' '.join(f'WHEN contains({_t(chr(23398) + chr(26415) + chr(27700) + chr(24179))}, {_literal(k)}) THEN {_literal(v)}' for k, v in S.LEVEL_SHORT.items())} ELSE {_t('学术水平')} END) AS level FROM texts")
def record_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normal(spark, sf_dir).select("key", X.normalised_level(F.col("学术水平"), F.col("target")).alias("level"))


@query(f"WITH {_RECORDS}, g AS (SELECT {_t('年级')} AS grade, count(*)::DOUBLE / (SELECT count(*) FROM texts) AS share FROM texts GROUP BY 1) SELECT grade, repeat('█', floor(share * 40)::INT) || repeat('░', 40 - floor(share * 40)::INT) AS bar FROM g")
def record_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = metrics.bucket_counts(_normal(spark, sf_dir), "年级")
    total = counts.agg(F.sum("count").alias("_total"))
    return counts.crossJoin(total).select(F.col("key").alias("grade"), X.ascii_bar(F.col("count") / F.col("_total")).alias("bar"))


_LONG = f"{_V} || {_C} || {_P} || {_t('社交关系')}"


@query(f"WITH {_RECORDS}, g AS (SELECT {_GOOD} AS good, {_LONG} AS long FROM texts) SELECT avg((len(list_filter(good, lambda s: contains(long, s))) > 0)::INT)::DOUBLE AS ratio FROM g WHERE len(good) > 0")
def record_mention_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _normal(spark, sf_dir)
    return metrics.mention_ratio(n, F.col("擅长科目"), F.concat_ws("", *(F.col(k) for k in (*S.PARAGRAPHS, "社交关系"))))


@query(f"WITH {_LINES}, n AS (SELECT length({_bare('line')}) AS n FROM lines) SELECT sum(n)::BIGINT AS total, avg(n)::DOUBLE AS mean, min(n)::INTEGER AS least, max(n)::INTEGER AS most FROM n")
def record_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _records(spark, sf_dir).select(F.char_length(X.without_blanks(F.to_json("record"))).alias("n"))
    return n.agg(F.sum("n").alias("total"), F.avg("n").alias("mean"), F.min("n").alias("least"), F.max("n").alias("most"))


def _canonical_part(k: str) -> str:
    if k == "id":
        return "'\"id\":' || key"
    kind, v = _k(k), f"{_v(k)}::VARCHAR"
    if k == "发展阶段":
        body = f"CASE WHEN {kind} = 'OBJECT' THEN {v} WHEN {kind} IS NOT NULL AND {kind} <> 'NULL' THEN '{{\"备注\":' || to_json({_t(k)})::VARCHAR || '}}' END"
    elif k in ("擅长科目", "薄弱科目"):
        body = f"CASE WHEN {kind} = 'ARRAY' THEN {v} WHEN {kind} = 'NULL' THEN '[]' WHEN {kind} IS NOT NULL THEN '[' || to_json({_t(k)})::VARCHAR || ']' END"
    else:
        body = f"CASE WHEN {kind} IS NOT NULL AND {kind} <> 'NULL' THEN {v} END"
    return f"'\"{k}\":' || {body}"


_CANONICAL = f"'{{' || array_to_string({_messages(*map(_canonical_part, S.FIELDS))}, ',') || '}}'"


@query(f"WITH {_RECORDS} SELECT key, {_CANONICAL} AS line FROM texts")
def record_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).select("key", K.canonical("record").alias("line"))


# --- sources and sinks, through files in the shared folder ---------------------------------------------------------------------------


def _run_of(spark: SparkSession, sf_dir: str) -> str:
    """A run whose first two thirds of the customers' records were appended, and then all of them."""
    folder = new_folder(spark)
    records = _records(spark, sf_dir).where("key > 0").select(F.col("key").alias("sid"), "record")
    none = spark.createDataFrame([], "sid long")
    K.append_records(records.where("sid % 3 < 2"), none, folder, 100)
    K.append_records(records, R.completed_ids(R.read_records(spark, folder, chunked=True)), folder, 100)
    return folder


@query(f"WITH {_RECORDS} SELECT key AS sid, ((key - 1) // 100 + 1)::BIGINT AS chunk_no, md5({_CANONICAL}) AS digest FROM texts WHERE key > 0")
def run_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run holds that was appended to twice: each record once, in its chunk, in canonical form."""
    found = R.read_records(spark, _run_of(spark, sf_dir), chunked=True)
    return found.select(J.field("record", "id", "long").alias("sid"), R.chunk_number().alias("chunk_no"), F.md5(K.canonical("record")).alias("digest"))


@query("SELECT (c_custkey // 100 + CASE WHEN c_custkey % 100 = 0 THEN 0 ELSE 1 END)::BIGINT AS chunk_no, count(*)::BIGINT AS lines FROM customer WHERE c_custkey > 0 GROUP BY 1")
def run_line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.line_counts(spark, _run_of(spark, sf_dir)).select(R.chunk_number().alias("chunk_no"), "lines")


@query("WITH c AS (SELECT (c_custkey - 1) // 100 + 1 AS chunk_no, count(*) AS records FROM customer WHERE c_custkey > 0 GROUP BY 1) SELECT chunk_no::BIGINT AS chunk_no, records::BIGINT AS records FROM c ORDER BY 1 DESC LIMIT 1")
def run_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.progress(R.read_last_chunk(spark, _run_of(spark, sf_dir)))


@query("SELECT min(i)::BIGINT AS next_sid FROM (SELECT unnest(range(1, (SELECT count(*) FROM customer) + 100)) AS i) WHERE i NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 < 2)")
def run_next_sid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest sid that a run lacks, from the ids in its files."""
    folder = new_folder(spark)
    K.append_records(_records(spark, sf_dir).where("key % 3 < 2").select(F.col("key").alias("sid"), "record"), spark.createDataFrame([], "sid long"), folder, 100)
    done = R.completed_ids(R.read_records(spark, folder, chunked=True))
    return spark.createDataFrame([(K.next_sid(done, _table(spark, sf_dir, "customer").count() + 99),)], "next_sid long")


_MERGED = f"{_LINES}, m AS (SELECT key, CASE key % 5 WHEN 1 THEN '   ' WHEN 2 THEN '[1]' WHEN 3 THEN substr(line, 3) ELSE line END AS line FROM lines)"


def _merged(spark: SparkSession, sf_dir: str) -> str:
    """A merged file, as a directory of parts in the order of the keys, with blank lines, lines that are no objects and broken ones. The keys are sorted before lines are
    made of them, and each range is written by a task of its own."""
    folder, key = new_folder(spark), F.col("key") % 5
    odd = F.when(key == 1, "   ").when(key == 2, "[1]").when(key == 3, F.expr("substring(line, 3)")).otherwise(F.col("line"))
    _lines(spark, sf_dir, in_order=True).select(odd.alias("value")).write.text(f"{folder}/{R.MERGED}")
    return folder


@query(f"WITH {_MERGED}, r AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS row_idx FROM m WHERE key % 5 IN (0, 4)) SELECT row_idx::BIGINT AS row_idx, key AS id FROM r WHERE row_idx < 50")
def merged_first_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 50 records of a merged file, numbered in its order."""
    rows = R.numbered(R.read_records(spark, _merged(spark, sf_dir)))
    return rows.where("row_idx < 50").select("row_idx", J.field("record", "id", "long").alias("id"))


@query(f"WITH {_MERGED} SELECT line, count(*)::BIGINT AS lines FROM m WHERE key % 5 IN (2, 3) GROUP BY 1")
def merged_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.read_quarantine(spark, _merged(spark, sf_dir)).groupBy("line").agg(F.count(F.lit(1)).alias("lines"))


@query(f"WITH {_MERGED}, r AS (SELECT key FROM m WHERE key % 5 IN (0, 4) ORDER BY key DESC LIMIT 6) SELECT key AS id FROM r")
def merged_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.preview(R.read_records(spark, _merged(spark, sf_dir))).select(J.field("record", "id", "long").alias("id"))


@query("""WITH e AS (SELECT c_custkey AS pos, c_custkey % 9 AS kind, CASE WHEN c_custkey % 9 = 4 THEN c_custkey // 2 ELSE c_custkey END AS sid, 'N' || c_nationkey AS grade, c_mktsegment AS gender FROM customer WHERE c_custkey > 0)
SELECT sid::BIGINT AS sid, arg_max(grade, pos) AS grade, arg_max(gender, pos) AS gender FROM e WHERE kind NOT IN (1, 2, 3) GROUP BY sid""")
def schedule_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A schedule file with a slot for each customer, among them elements that are no objects, sids that are no numbers, slots that are none, and sids that come twice."""
    c, kind = F.col("c_custkey"), F.col("c_custkey") % 9
    slot = F.to_json(F.struct(F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("年级"), F.col("c_mktsegment").alias("性别")))
    of = lambda sid, what: F.concat(F.lit('{"sid":'), sid, F.lit(',"slot":'), what, F.lit("}"))
    item = F.when(kind == 1, F.lit("5")).when(kind == 2, of(F.concat(F.lit('"'), c.cast("string"), F.lit('"')), slot)).when(kind == 3, of(c.cast("string"), F.lit("null")))
    item = item.when(kind == 4, of(F.floor(c / 2).cast("string"), slot)).otherwise(of(c.cast("string"), slot))
    # A schedule is one JSON array, which is one row whoever writes it.
    items = _table(spark, sf_dir, "customer").where("c_custkey > 0").select(F.struct(c.alias("c"), item.alias("item")).alias("x")).agg(F.array_sort(F.collect_list("x")).alias("l"))
    path = f"{new_folder(spark)}/schedule.json"
    items.select(F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: x["item"]), ","), F.lit("]"))).write.text(path)
    return R.read_schedule(spark, path).select("sid", F.col("slot.`年级`").alias("grade"), F.col("slot.`性别`").alias("gender"))


_ERRORS_CHUNK = f"list_concat(list_concat({_required(S.REQUIRED, '缺失或为空：')}, {_ACADEMIC}), list_concat({_messages(_case(f'NOT {_NAME_CHUNK}', _NAME_MESSAGE))}, {_PARAGRAPHS}))"
_WARNINGS_CHUNK = f"list_concat(list_concat({_VALUE_WORDS}, {_CREATIVITY_WORDS}), list_concat({_PSYCHOLOGY_WORDS}, {_age_grade(S.GRADE_AGES_CHUNK)}))"
_RUN_HASHES = _HASHES.replace("documents", "keyed")


def _run_distinct(n: int) -> str:
    gram = "w" if n == 1 else "w || chr(1) || lead(w) OVER o"
    return f"(SELECT run_id, count(DISTINCT g)::DOUBLE / count(g) AS distinct_{n} FROM (SELECT run_id, {gram} AS g FROM words_of WINDOW o AS (PARTITION BY run_id ORDER BY key, i)) WHERE g IS NOT NULL GROUP BY run_id)"


@query(f"""WITH {_RECORDS}, items AS MATERIALIZED (SELECT key, 'run=' || (key % 4) AS run_id, {_ERRORS_CHUNK} AS errors, {_WARNINGS_CHUNK} AS warnings, {_KEY_TEXT} AS text, {_V} || ' ' || {_C} || ' ' || {_P} AS joined FROM texts),
keyed AS MATERIALIZED (SELECT key AS doc_id, text FROM items), {_RUN_HASHES.strip()},
h AS (SELECT i.run_id, hashed.h FROM hashed JOIN items i ON i.key = hashed.doc_id), c AS (SELECT run_id, h, count(*) AS c FROM h GROUP BY 1, 2),
near AS (SELECT run_id, sum(p) AS p FROM (SELECT run_id, c * (c - 1) // 2 AS p FROM c UNION ALL SELECT a.run_id, a.c * b.c FROM c a JOIN c b ON a.run_id = b.run_id AND a.h < b.h AND (a.h >> 48) = (b.h >> 48) AND bit_count(xor(a.h, b.h)) <= 3) GROUP BY 1),
words_of AS MATERIALIZED (SELECT run_id, key, generate_subscripts(l, 1) AS i, unnest(l) AS w FROM (SELECT run_id, key, list_filter(regexp_split_to_array(joined, '{_BLANK}+'), lambda x: x <> '') AS l FROM items)),
r AS (SELECT run_id, count(*)::BIGINT AS records, avg((len(errors) > 0)::INT)::DOUBLE AS error_rate, avg((len(warnings) > 0)::INT)::DOUBLE AS warning_rate, {_share('errors', '缺失或为空')} AS m, {_share('errors', '非单段体裁')} AS p,
  {_share('warnings', '年龄')} AS a, {_share('errors', '学术水平')} AS l FROM items GROUP BY 1)
SELECT run_id, records, error_rate, warning_rate, distinct_1, distinct_2, least(100, near.p)::BIGINT AS near_duplicate_pairs,
  25 * (1 - m) + 25 * (1 - a) + 15 * (1 - r.p) + 20 * least(greatest(distinct_1 / 0.4 * 0.5 + distinct_2 / 0.6 * 0.5, 0), 1) + 15 * (1 - l) AS score_overall_0_100
FROM r JOIN near USING (run_id) JOIN {_run_distinct(1)} d1 USING (run_id) JOIN {_run_distinct(2)} d2 USING (run_id)""")
def run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index over four runs that hold the customers' records in the order of their keys."""
    root = new_folder(spark)
    lines = _lines(spark, sf_dir).select((F.col("key") % 4).alias("run"), F.lit("students_chunk_1.jsonl").alias("chunk"), "key", F.col("line").alias("value"))
    # Ranges of keys, each sorted: files are named by range, and their names' order is that of the keys.
    lines.repartitionByRange(3, "key").sortWithinPartitions("run", "key").drop("key").write.partitionBy("run", "chunk").text(root)
    return evaluate.run_index(R.read_run_records(spark, root))


@query(f"""WITH {_HASHES}, r AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS r, h FROM hashed), s AS (SELECT count(*)::HUGEINT AS n, count(*)::HUGEINT * (count(*) - 1) // 2 AS t FROM hashed),
k AS (SELECT k::HUGEINT AS k, n, t, least(50000, t) AS m FROM (SELECT unnest(range(50000)) AS k), s), p AS (SELECT n, k * t // m + (('0x' || substr(md5(k::VARCHAR), 1, 8))::UBIGINT::HUGEINT * ((k + 1) * t // m - k * t // m)) // 4294967296 AS p FROM k WHERE k < m),
ij AS (SELECT (p % n)::BIGINT AS i, ((p % n + p // n + 1) % n)::BIGINT AS j FROM p), d AS (SELECT {_DISTANCE} AS d FROM ij JOIN r a ON a.r = i JOIN r b ON b.r = j)
SELECT count(*)::BIGINT AS pairs, avg(d)::DOUBLE AS mean, stddev_pop(d)::DOUBLE AS std, avg(d)::DOUBLE / 64 AS mean_normalized, stddev_pop(d)::DOUBLE / 64 AS std_normalized FROM d""")
def hamming_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of 50,000 pairs of documents drawn from all, for the table has more."""
    return metrics.hamming_stats(stored(_hashed(spark, sf_dir)))


# --- plans -----------------------------------------------------------------------------------------------------------------------

_QUOTA = [("初一", "男", "理科向"), ("初二", "女", "文社向"), ("高一", "男", "艺体向")]


@query(f"SELECT (i + 1)::BIGINT AS sid, ({_list(x[0] for x in _QUOTA)})[(i % 3 + 1)::INT] AS grade, ({_list(x[1] for x in _QUOTA)})[(i % 3 + 1)::INT] AS gender FROM (SELECT unnest(range((SELECT count(*) FROM supplier))) AS i)")
def quota_of_a_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's quota that is shorter than the run is cycled."""
    rows = [(i, (g, s, [c], None)) for i, (g, s, c) in enumerate(_QUOTA)]
    own = spark.createDataFrame(rows, "pos long, slot struct<`年级`:string,`性别`:string,`优势学科偏向`:array<string>,`目标学术水平`:string>")
    plan = quota.schedule(spark, _table(spark, sf_dir, "supplier").count(), quota=own)
    return plan.select("sid", F.col("slot.`年级`").alias("grade"), F.col("slot.`性别`").alias("gender"))


@query(f"SELECT ({_list(S.LEVELS)})[(i % 4 + 1)::INT] AS level, count(*)::BIGINT AS slots FROM (SELECT unnest(range((SELECT count(*) FROM supplier))) AS i) GROUP BY 1")
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = quota.round_robin_levels(spark, _table(spark, sf_dir, "supplier").count())
    return plan.groupBy("level").agg(F.count(F.lit(1)).alias("slots"))


@query("SELECT count(*)::BIGINT AS slots, count(DISTINCT i)::BIGINT AS sids, sum((i <= (SELECT count(*) FROM supplier))::INT)::BIGINT AS old FROM (SELECT unnest(range(1, (SELECT count(*) FROM customer) + 1)) AS i)")
def schedule_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A schedule that is extended keeps its slots."""
    n, m = _table(spark, sf_dir, "supplier").count(), _table(spark, sf_dir, "customer").count()
    old = stored(quota.schedule(spark, n, seed=1))
    new = quota.extend(old, spark, m, seed=2)
    kept = new.join(old.select("sid", F.col("slot").alias("_slot")), "sid", "left")
    return kept.agg(F.count(F.lit(1)).alias("slots"), F.count_distinct("sid").alias("sids"), F.sum((F.col("slot") == F.col("_slot")).cast("long")).alias("old"))


@query(f"""WITH {_RECORDS}, j AS (SELECT {_t('年级')} AS x, ({_list(S.GRADES)})[(key % 12 + 1)::INT] AS y FROM texts WHERE key % 2 = 0), q AS (SELECT y AS key, count(*)::DOUBLE / (SELECT count(*) FROM j) AS q FROM j GROUP BY 1),
c AS (SELECT x AS key, count(*) AS c FROM j GROUP BY 1), u AS (SELECT coalesce(c, 0) AS c, greatest(coalesce(q, 0), 1e-8) AS q FROM c FULL JOIN q USING (key)), p AS (SELECT (c + 1.0::DOUBLE) / (sum(c) OVER () + count(*) OVER ()) AS p, q FROM u)
SELECT sum(p * ln(p / q))::DOUBLE AS kl FROM p""")
def plan_kl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades of the records that have a slot against the grades of their slots."""
    plan = _table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("sid"), F.get(F.array(*map(F.lit, S.GRADES)), (F.col("c_custkey") % 12).cast("int")).alias("grade"))
    met = stored(_normal(spark, sf_dir).select("key", F.col("年级").alias("own")).join(plan, F.col("key") == F.col("sid")))
    total = met.count()
    prior = met.groupBy(F.col("grade").alias("key")).agg((F.count(F.lit(1)) / F.lit(total)).alias("q"))
    return metrics.kl_divergence(met.groupBy(F.col("own").alias("key")).agg(F.count(F.lit(1)).alias("count")), prior)


@query("SELECT c_custkey AS sid, CASE WHEN c_custkey % 3 = 0 THEN '初一' END AS grade FROM customer")
def slots_of_sids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sid with its slot, if it has one."""
    sids = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sid"))
    plan = sids.where("sid % 3 = 0").withColumn("slot", F.struct(F.lit("初一").alias("年级")))
    return quota.slots_of(sids, plan).select("sid", F.col("slot.`年级`").alias("grade"))


# --- near pairs and distances --------------------------------------------------------------------------------------------------------


@query(f"""WITH {_HASHES}, f AS (SELECT h >> 48 AS k, min(doc_id) AS first FROM hashed GROUP BY 1)
SELECT a.doc_id AS id_i, b.doc_id AS id_j, {_DISTANCE} AS distance FROM hashed a JOIN hashed b ON a.doc_id < b.doc_id AND (a.h >> 48) = (b.h >> 48) JOIN f ON f.k = (a.h >> 48) WHERE {_DISTANCE} <= 3 ORDER BY first, 1, 2 LIMIT 100""")
def first_near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.first_pairs(stored(_hashed(spark, sf_dir)), 100)


_ITEM_HASHES = _HASHES.replace("doc_id", "item_id").replace("documents", "benchmark")


@query(f"WITH {_ITEM_HASHES}, d AS (SELECT {_DISTANCE} AS d FROM hashed a JOIN hashed b ON a.item_id < b.item_id) SELECT count(*)::BIGINT AS pairs, avg(d)::DOUBLE AS mean, stddev_pop(d)::DOUBLE AS std, avg(d)::DOUBLE / 64 AS mean_normalized, stddev_pop(d)::DOUBLE / 64 AS std_normalized FROM d")
def hamming_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all pairs: the table has few enough rows."""
    return metrics.hamming_stats(stored(_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), simhash64(F.col("text")).alias("h"))))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'x' || event_type WHEN 1 THEN event_type || 'y' WHEN 2 THEN event_type WHEN 3 THEN event_type WHEN 4 THEN event_type ELSE '{"b":"' || event_type || '"}' END AS content FROM events""")
def response_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text in response bodies of six shapes."""
    t = F.col("event_type")
    shapes = [
        F.format_string('{"choices":[{"message":{"content":"x%s"}}]}', t), F.format_string('{"choices":[{"message":{"content":[{"type":"text","text":"%s"},"y"]}}]}', t), F.format_string('{"choices":[{"content":"%s"}]}', t),
        F.format_string('{"choices":[],"output_text":"%s"}', t), F.format_string('{"result":"%s","output":1}', t), F.format_string('{"b":"%s"}', t),
    ]
    body = F.get(F.array(*shapes), (F.col("event_id") % 6).cast("int"))
    return _table(spark, sf_dir, "events").select("event_id", J.response_content(body).alias("content"))
