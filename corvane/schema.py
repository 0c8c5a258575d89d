"""Names, vocabularies and bounds of the persona record."""

from __future__ import annotations

# Field names and their canonical order.
FIELDS = ["id", "姓名", "年龄", "性别", "年级", "发展阶段", "代理名", "擅长科目", "薄弱科目", "学术水平", "人格", "价值观", "社交关系", "创造力", "心理健康", "_采样约束"]
REQUIRED = ["id", "姓名", "年龄", "擅长科目", "薄弱科目", "年级", "人格", "社交关系", "学术水平", "性别", "发展阶段", "代理名", "价值观", "创造力", "心理健康"]
REQUIRED_ONLINE = ["姓名", "年龄", "性别", "年级", "人格", "擅长科目", "薄弱科目", "学术水平", "价值观", "创造力", "心理健康", "代理名", "发展阶段", "社交关系"]
STAGE_FIELDS = ["皮亚杰认知发展阶段", "埃里克森心理社会发展阶段", "科尔伯格道德发展阶段"]
PARAGRAPHS = ["价值观", "创造力", "心理健康"]
KEY_TEXT_FIELDS = ["年级", "性别", "人格", "价值观", "社交关系", "创造力", "心理健康"]

# Vocabularies.
GRADES = ["一年级", "二年级", "三年级", "四年级", "五年级", "六年级", "初一", "初二", "初三", "高一", "高二", "高三"]
GENDERS = ["男", "女"]
SUBJECT_CLUSTERS = ["理科向", "文社向", "艺体向", "外语生物向"]
CLUSTER_SUBJECTS = {"理科向": ["数学", "物理", "化学", "信息技术"], "文社向": ["语文", "历史", "政治", "地理"], "艺体向": ["美术", "音乐", "体育"], "外语生物向": ["英语", "生物"]}
LEVELS = ["高：成绩全校排名前10%", "中：成绩全校排名前10%至30%", "低：成绩全校排名前30%至50%", "差：成绩全校排名后50%"]
LEVEL_NUMBER = dict(zip(LEVELS, (3, 2, 1, 0), strict=True))
LEVEL_SHORT = dict(zip("高中低差", LEVELS, strict=True))
LEVEL_ALIAS = LEVEL_SHORT | {"high": LEVELS[0], "mid": LEVELS[1], "medium": LEVELS[1], "low": LEVELS[2], "poor": LEVELS[3]}
VALUE_DIMENSIONS = ["道德修养", "身心健康", "法治意识", "社会责任", "政治认同", "文化素养", "家庭观念"]
CREATIVITY_DIMENSIONS = ["流畅性", "新颖性", "灵活性", "可行性", "问题发现", "问题分析", "提出方案", "改善方案"]
PSYCHOLOGY_WORDS = ["综合心理状况", "幸福指数", "抑郁风险", "焦虑风险", "信息不足或未见显著症状", "背景", "应对", "支持", "家庭", "同伴", "老师", "转折"]
LEVEL_WORDS = ["高", "较高", "中", "中上", "较低", "低"]
POLARITY = {"高": 1.0, "较高": 0.8, "中上": 0.5, "中": 0.0, "较低": -0.5, "低": -1.0}
RISK_WORDS = {"低风险": -0.2, "轻度": -0.4, "中度": -0.7, "重度": -1.0, "高": -0.8}
PUNCTUATION = " ，。、“”‘’？！：；,.!? \t\r\n｜"
KEY_SEPARATOR = "｜"

# Usual ages of a grade, bounds and priors.
GRADE_AGES = {"一年级": (7, 8), "二年级": (8, 9), "三年级": (9, 10), "四年级": (10, 11), "五年级": (10, 11), "六年级": (11, 12), "初一": (12, 13), "初二": (13, 14), "初三": (14, 15), "高一": (15, 16), "高二": (16, 17), "高三": (17, 18)}
GRADE_AGES_CHUNK = {g: GRADE_AGES[g] for g in GRADES[4:]}
SHORTEST, LONGEST = 80, 800
TEMPLATE_SIMILARITY = 0.80
PRIOR_LEVEL = {x: 0.25 for x in LEVELS}
PRIOR_GENDER = {x: 0.5 for x in GENDERS}
PRIOR_GRADE = {x: 1 / 12 for x in GRADES}

# Other names under which fields come.
FIELD_ALIASES = {
    "name": "姓名", "age": "年龄", "grade": "年级", "gender": "性别", "development_stage": "发展阶段", "development": "发展阶段",
    "advantageSubjects": "擅长科目", "weakSubjects": "薄弱科目", "academicLevel": "学术水平", "student_id": "id", "persona": "人格",
    "morals": "价值观", "psychological": "心理健康", "socialRelationships": "社交关系", "agent_name": "代理名",
}
