"""Record rules as a registry of (code, severity, messages) over normalised records.

A rule gives an array of messages that is empty where the record passes. Profiles choose rules: ``full`` and ``chunk`` are the two
evaluators, ``online`` is the filter during generation. All rules are plain expressions and run in one projection.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane import schema as S
from corvane.functions import json_text as J
from corvane.functions import text as X

SYLLABLE = "[a-z]+[1-5]"
ONLINE_NAME = rf"(?d)^(?:{SYLLABLE}){{1,2}}_(?:{SYLLABLE}){{1,3}}$"


@dataclass(frozen=True)
class Rule:
    code: str
    severity: str
    messages: Column


def when(*cases: tuple[Column, str | Column]) -> Column:
    """The messages of the conditions that hold, in order."""
    found = [F.when(condition, message if isinstance(message, Column) else F.lit(message)) for condition, message in cases]
    return F.filter(F.array(*found), lambda m: m.isNotNull())


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def syllables(part: Column) -> Column:
    """Number of syllables of letters and tone digit if the part is nothing else; else 0."""
    return F.when(part.rlike(rf"(?d)\A(?:{SYLLABLE})+\z"), F.regexp_count(part, F.lit(SYLLABLE))).otherwise(0)


def name_ok_full(name: Column) -> Column:
    """Two parts or more, 2 to 4 syllables in all, 1 or 2 in the surname, 1 to 3 in the rest."""
    counts = F.transform(F.split(name, "_", -1), syllables)
    total, surname = F.aggregate(counts, F.lit(0), lambda a, n: a + n), F.get(counts, F.lit(0))
    return (F.size(counts) >= 2) & F.forall(counts, lambda n: n > 0) & total.between(2, 4) & surname.between(1, 2) & (total - surname).between(1, 3)


def name_ok_chunk(name: Column) -> Column:
    """Any number of single-syllable parts from two on; else 1 or 2 syllables in every part."""
    counts = F.transform(F.split(name, "_", -1), syllables)
    return (F.size(counts) >= 2) & F.forall(counts, lambda n: n.between(1, 2))


def name_ok_online(name: Column) -> Column:
    return name.rlike(ONLINE_NAME)


def required(fields: list[str], label: str) -> Column:
    """One message for each missing field, in the order of ``fields``."""
    # Bound, for the optimizer would else put the test of all fields into the test of each.
    found = lambda present: F.array(*(F.when(~F.get(present, F.lit(S.REQUIRED.index(k)))["v"], F.lit(label + k)) for k in fields))
    return F.filter(X.bound(F.col("present"), found), lambda m: m.isNotNull())


def academic() -> Column:
    good, weak = _col("擅长科目"), _col("薄弱科目")
    usable = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    return when(
        (~_col("学术水平").isin(S.LEVELS), "学术水平非四选一固定文案"),
        (~usable(good), "擅长科目为空或非数组"),
        (~usable(weak), "薄弱科目为空或非数组"),
        (F.coalesce(F.size(F.array_intersect(good, weak)) > 0, F.lit(False)), "擅长/薄弱科目集合相交"),
    )


def paragraphs() -> Column:
    cases = []
    for k in S.PARAGRAPHS:
        text = F.coalesce(F.col(f"paragraph_kinds.`{k}`").isin("missing", "string"), F.lit(False))
        cases.append((~(text & X.is_single_paragraph(_col(k))), f"{k} 非单段体裁"))
    return when(*cases)


def value_words() -> Column:
    v = _col("价值观")
    return when((~X.contains_any(v, S.VALUE_DIMENSIONS), "价值观未见七维显式名词（至少缺大部分）"), (~X.contains_any(v, S.LEVEL_WORDS), "价值观未见等级词"))


def creativity_words() -> Column:
    c = _col("创造力")
    return when(
        (~X.contains_any(c, S.CREATIVITY_DIMENSIONS), "创造力未见八维显式名词（至少缺大部分）"),
        (X.contains_any(c, ["可行性较低", "可行性低"]) & X.contains_any(c, ["提出方案高", "提出方案较高"]), "创造力一致性：可行性低但‘提出方案’高"),
        (~X.contains_any(c, ["雷达", "总结"]), "创造力未见雷达总结提示词"),
    )


def psychology_words() -> Column:
    p = _col("心理健康")
    return when(
        (~X.contains_any(p, S.PSYCHOLOGY_WORDS), "心理健康未见关键槽位关键词"),
        (X.contains_any(_col("价值观"), ["身心健康高", "身心健康较高"]) & F.contains(p, F.lit("重度")), "一致性：价值观身心健康高/较高 ↔ 心理出现重度术语"),
    )


def age_and_grade(ages: dict[str, tuple[int, int]]) -> Column:
    """A year outside a grade's usual ages is allowed; a grade without usual ages passes."""
    age, grade = F.col("年龄"), _col("年级")
    bounds = F.create_map(*[F.lit(x) for g, (low, high) in ages.items() for x in (g, F.struct(F.lit(low).alias("low"), F.lit(high).alias("high")))])
    own = F.element_at(bounds, grade)
    odd = F.coalesce((age < own["low"] - 1) | (age > own["high"] + 1), F.lit(False))
    shown = F.when(F.col("age_kind") == "boolean", F.initcap(age.cast("boolean").cast("string"))).otherwise(age.cast("string"))
    return when((age.isNull(), "年龄非整数或缺失"), (odd, F.concat(F.lit("年龄-年级非常模(年级:"), grade, F.lit(", 年龄:"), shown, F.lit(")"))))


def stage_and_age() -> Column:
    """Seven pairs of a stage word and the ages at which it is odd."""
    age = F.col("年龄")
    has = lambda k, w: F.coalesce(F.contains(_col(S.STAGE_FIELDS[k]), F.lit(w)), F.lit(False))
    return when(
        (has(0, "前运算") & (age >= 10), "发展阶段不一致：前运算阶段通常对应学前及低年级儿童"),
        (has(0, "具体运算") & ((age < 7) | (age > 15)), "发展阶段不一致：具体运算阶段通常对应约7–12岁儿童"),
        (has(0, "形式运算") & (age < 11), "发展阶段不一致：形式运算阶段通常对应11岁以上青少年"),
        (has(1, "身份与角色混淆") & (age < 11), "发展阶段不一致：身份与角色混淆多见于青春期阶段"),
        (has(1, "勤奋") & (age > 15), "发展阶段不一致：勤奋与自卑阶段多见于小学阶段儿童"),
        (has(2, "常规水平") & (age < 9), "发展阶段不一致：道德发展常规水平通常出现在9岁以上"),
        (has(2, "前习俗") & (age > 13), "发展阶段不一致：前习俗水平多见于儿童早期"),
    )


def paragraph_lengths(shortest: int = S.SHORTEST, longest: int = S.LONGEST) -> Column:
    cases = []
    for k in S.PARAGRAPHS:
        n = F.char_length(X.without_blanks(_col(k)))
        cases += [(n < shortest, F.concat(F.lit(f"{k} 段落过短("), n.cast("string"), F.lit(")"))), (n > longest, F.concat(F.lit(f"{k} 段落过长("), n.cast("string"), F.lit(")")))]
    return when(*cases)


def _similarities(a: Column, b: Column, c: Column) -> tuple[Column, Column, Column]:
    return X.jaccard(a, b), X.jaccard(a, c), X.jaccard(b, c)


def paragraph_similarities() -> dict[str, Column]:
    """Character-set similarity of the three paragraphs, pair by pair."""
    return dict(zip(("val_cre", "val_psy", "cre_psy"), _similarities(*(X.char_set(_col(k)) for k in S.PARAGRAPHS)), strict=True))


def template_like() -> Column:
    # The three sets are built once for the three pairs.
    most = X.bound(F.array(*(X.char_set(_col(k)) for k in S.PARAGRAPHS)), lambda sets: F.greatest(*_similarities(*(F.get(sets, F.lit(i)) for i in range(3)))))
    return when((most >= S.TEMPLATE_SIMILARITY, "价值观/创造力/心理健康文本高度相似，疑似模板化"))


def profile(name: str) -> list[Rule]:
    """The rules of the evaluator ``full`` or ``chunk``."""
    full = name == "full"
    agent = when((~(name_ok_full if full else name_ok_chunk)(_col("代理名")), "代理名不合规（小写拼音+声调；姓/名用下划线分隔；复姓/名可1–2音节连写或分节）"))
    rules = [
        Rule("required", "error", required(S.REQUIRED, "缺失或为空：")), Rule("academic", "error", academic()), Rule("agent_name", "error", agent),
        Rule("paragraphs", "error", paragraphs()), Rule("values", "warning", value_words()), Rule("creativity", "warning", creativity_words()),
        Rule("psychology", "warning", psychology_words()), Rule("age_grade", "warning", age_and_grade(S.GRADE_AGES if full else S.GRADE_AGES_CHUNK)),
    ]
    if full:
        rules += [Rule("stage_age", "warning", stage_and_age()), Rule("lengths", "warning", paragraph_lengths()), Rule("template", "warning", template_like())]
    return rules


def per_item(records: DataFrame, name: str = "full") -> DataFrame:
    """``records`` (normalised) with the arrays ``errors`` and ``warnings``."""
    rules = profile(name)
    of = lambda severity: F.concat(*(r.messages for r in rules if r.severity == severity))
    return records.withColumns({"errors": of("error"), "warnings": of("warning")})


def online_reasons() -> Column:
    """Reasons against a generated record; empty if it may be kept."""
    v, c, p, target = _col("价值观"), _col("创造力"), _col("心理健康"), F.col("target")
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ((S.LEVELS[1], 1), (S.LEVELS[2], 2), (S.LEVELS[3], 3)) for x in kv]), target), F.lit(0))
    levels = {d: X.dimension_level(c, d) for d in S.CREATIVITY_DIMENSIONS}
    low = sum((F.when(x.isin("中", "较低", "低"), 1).otherwise(0) for x in levels.values()), F.lit(0))
    words = "高|较高|中上|中(?!上)|较低|低|轻度|中度|重度|低风险"
    state = [X.dimension_level(p, k, words).isin("中", "较低", "低") for k in ("综合心理状况", "幸福指数")]
    risks = [X.dimension_level(p, k, words) for k in ("抑郁风险", "焦虑风险")]
    anchored = target.isin(S.LEVELS[2:])
    either = lambda x: F.coalesce(x, F.lit(False))
    anchor = F.coalesce(target, F.lit("无"))
    return F.concat(
        required(S.REQUIRED_ONLINE, "缺字段或为空："),
        when(
            (~_col("学术水平").isin(S.LEVELS), "学术水平非四选一固定文案"),
            (~name_ok_online(_col("代理名")), "代理名不合规（需拼音分节+声调数字；姓1-2节，名1-3节）"),
        ),
        paragraphs(),
        value_words(),
        when(
            ((rank > 0) & (X.lowish_count(v) < rank), F.concat(F.lit("价值观等级分布过高（锚="), anchor, F.lit("）：需要≥"), rank.cast("string"), F.lit("处“中/较低/低”"))),
            (~X.contains_any(c, S.CREATIVITY_DIMENSIONS), "创造力未见八维显式名词（至少缺大部分）"),
            (~X.contains_any(c, ["雷达", "总结"]), "创造力未见雷达总结提示词"),
            ((rank > 0) & (low < rank + 1), F.concat(F.lit("创造力八维整体偏高（锚="), anchor, F.lit("）：要求≥"), (rank + 1).cast("string"), F.lit("个维度为“中及以下”，当前="), low.cast("string"))),
            (levels["可行性"].isin("较低", "低") & levels["提出方案"].isin("高", "较高", "中上"), "创造力一致性：可行性低但‘提出方案’高"),
            (~X.contains_any(p, S.PSYCHOLOGY_WORDS[:-1]), "心理健康未见核心槽位关键词"),
            (either(anchored & ~(state[0] | state[1])), "心理健康与锚不符：综合心理状况/幸福指数至少1处需“中或较低/低”"),
            (either(anchored & F.contains(risks[0], F.lit("低")) & F.contains(risks[1], F.lit("低"))), "心理健康与锚不符：抑郁/焦虑风险不应双双为‘低/低风险’"),
        ),
    )


def truthy(value: Column) -> Column:
    """False if a value is missing, null, false, zero, or an empty string, list or object."""
    kind = J.kind_of(value)
    return (
        F.when(kind.isin("missing", "null"), False)
        .when(kind == "string", F.try_variant_get(value, "$", "string") != "")
        .when(kind.isin("array", "object"), ~F.to_json(value).isin("[]", "{}"))
        .when(kind == "boolean", F.try_variant_get(value, "$", "boolean"))
        .otherwise(F.coalesce(F.try_variant_get(value, "$", "double") != 0, F.lit(True)))
    )


def whole_number(value: Column) -> Column:
    """What reading a value as a whole number gives: numbers are cut, texts must hold digits only; else null."""
    kind, text = J.kind_of(value), F.trim(F.try_variant_get(value, "$", "string"))
    return (
        F.when(kind == "string", F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("long")))
        .when(kind == "boolean", F.try_variant_get(value, "$", "boolean").cast("long"))
        .when(kind.isin("integer", "other"), F.coalesce(F.try_variant_get(value, "$", "long"), F.try_variant_get(value, "$", "double").try_cast("long")))
    )


def baseline_reasons(paragraph_fields: tuple[str, ...] = ("人格", "价值观", "社交关系", "创造力", "心理健康")) -> Column:
    """Reasons of the single-prompt generator's validator, from ``record``: a value in each field that counts as true; of fields that are there,
    a strict level, an agent name, gender and grade from the lists, an age that reads as 6 to 18, subject lists that hold something and don't
    overlap, an object of the three stages, and paragraphs that are one."""
    at = lambda k: J.field_by_alias("record", k)
    there = lambda k: at(k).isNotNull()
    is_ = lambda k, kind: J.kind_of(at(k)) == kind
    strict = lambda k, values: is_(k, "string") & F.coalesce(F.try_variant_get(at(k), "$", "string").isin(values), F.lit(False))
    both = there("擅长科目") & there("薄弱科目")
    good, weak = (F.coalesce(J.strings(at(k)), F.array().cast("array<string>")) for k in ("擅长科目", "薄弱科目"))
    age = whole_number(at("年龄"))
    cases = [
        *((~truthy(at(k)), f"missing {k}") for k in S.REQUIRED),
        (there("学术水平") & ~strict("学术水平", S.LEVELS), "academic level"),
        (there("代理名") & ~name_ok_online(J.as_text(at("代理名"))), "agent name"),
        (there("性别") & ~strict("性别", S.GENDERS), "gender"),
        (there("年级") & ~strict("年级", S.GRADES), "grade"),
        (there("年龄") & age.isNull(), "age not whole"),
        (there("年龄") & F.coalesce(~age.between(6, 18), F.lit(False)), "age out of range"),
        (both & ((F.size(good) == 0) | (F.size(weak) == 0)), "subjects empty"),
        (both & (F.size(F.array_intersect(good, weak)) > 0), "subjects overlap"),
        (there("发展阶段") & ~is_("发展阶段", "object"), "stages not an object"),
        *((is_("发展阶段", "object") & J.field(at("发展阶段"), k).isNull(), f"stage {k}") for k in S.STAGE_FIELDS),
    ]
    for k in paragraph_fields:
        text = F.try_variant_get(at(k), "$", "string")
        blank = F.coalesce(~is_(k, "string") | (X.stripped(text) == ""), F.lit(True))
        listed = F.contains(text, F.lit("\n\n")) | text.rlike(r"(?Udm)^\s*[-•\d]+\.")
        cases += [(there(k) & blank, f"no text in {k}"), (there(k) & ~blank & listed, f"paragraph {k}")]
    return when(*cases)


def constraint(mode: str) -> Column:
    """Whether a record meets the constraint of a mode: ``age_15``, ``grade_chu2``, or none."""
    if mode == "age_15":
        age = J.field_by_alias("record", "年龄")
        return F.coalesce(J.kind_of(age).isin("integer", "other") & (F.try_variant_get(age, "$", "double") == 15), F.lit(False))
    if mode == "grade_chu2":
        grade = J.field_by_alias("record", "年级")
        return F.coalesce((J.kind_of(grade) == "string") & (F.try_variant_get(grade, "$", "string") == "初二"), F.lit(False))
    return F.lit(True)


def deep_issues() -> Column:
    """Issues that need no model: strict level, agent name, agreement with the target level."""
    level, target = _col("学术水平"), F.col("target")

    def issue(condition: Column, code: str, desc: Column, owner: str, field: str, hint: Column) -> Column:
        return F.when(condition, F.struct(F.lit(code).alias("code"), desc.alias("desc"), F.lit(owner).alias("owner"), F.array(F.lit(field)).alias("fields"), hint.alias("hint")))

    found = F.array(
        issue(~level.isin(S.LEVELS), "R14", F.lit("学术水平未严格匹配允许集合。"), "学业画像", "学术水平", F.lit("替换为四选一固定文案")),
        issue(~name_ok_online(_col("代理名")), "R6", F.lit("代理名不合规"), "学籍与发展阶段", "代理名", F.lit("zhang1_shuang3 / li1_huan4ying1 / ou3yang2_ming2hao3")),
        issue(F.coalesce((target != "") & (level != target), F.lit(False)), "R14-anchored", F.concat(F.lit("期望："), target, F.lit("，实际："), level), "学业画像", "学术水平", F.concat(F.lit("改为目标档位："), target)),
    )
    return F.filter(found, lambda x: x.isNotNull())
