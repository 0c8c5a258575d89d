"""Generation as bounded rounds of DataFrame steps around a pluggable text model.

A model is a picklable callable that gets a :class:`Call` and gives text, a response body, or a status with either; it runs inside
``mapInPandas``, and nothing else leaves the JVM. Five agents each own some fields and answer one after another, each seeing what the ones before
wrote. The fast validator lets a record pass or sends it to rounds of the deep one, after each of which the owners of its issues answer again
with the issues at hand. What fails the online rules is retried a bounded number of times and then becomes a failure row.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane import schema as S
from corvane.functions import json_text as J
from corvane.functions.simhash import simhash64
from corvane.functions.text import key_text, normalised_level
from corvane.operators import rules
from corvane.operators.dedup import gate
from corvane.operators.materialise import stored
from corvane.plans import pool
from corvane.sources.records import normalised
from corvane.streaming.limiter import with_backoff


@dataclass(frozen=True)
class Agent:
    name: str
    fields: tuple[str, ...]
    temperature: float
    max_tokens: int


# The agents, their fields, temperatures and token limits.
AGENTS = (
    Agent("学籍与发展阶段", ("姓名", "年龄", "性别", "年级", "发展阶段", "代理名"), 0.98, 700),
    Agent("学业画像", ("擅长科目", "薄弱科目", "学术水平"), 0.9, 600),
    Agent("人格与价值观", ("人格", "价值观"), 1.0, 900),
    Agent("社交与创造力", ("社交关系", "创造力"), 1.02, 1100),
    Agent("身心健康", ("心理健康",), 0.96, 1100),
)
VALIDATORS = {"fast": Agent("fast", (), 0.1, 450), "deep": Agent("deep", (), 0.2, 1100)}
SINGLE = Agent("single", tuple(k for k in S.REQUIRED if k != "id"), 1.0, 4096)
#: Constraints of the single prompt by mode.
MODES = {"age_15": "**硬性约束：年龄必须严格等于15岁**", "grade_chu2": "**硬性约束：年级必须严格等于初二**", "unconstrained": "无特殊约束，生成自然的学生画像"}


@dataclass(frozen=True)
class Call:
    """What a model is asked: by whom, about which facts, in answer to which issues, and how."""

    agent: str
    facts: dict
    seed: str
    temperature: float
    max_tokens: int
    mode: str = "propose"
    issues: list = field(default_factory=list)
    constraint: str = ""


#: Text or a response body, or (status, text or body, seconds to wait or None) for with_backoff; or a model for each provider's name.
Model = Callable[[Call], Any] | Mapping[str, Callable[[Call], Any]]
#: Columns that go with a record: the provider that answers its calls, and the faults of calls so far.
_WITH = ("provider", "faults")


def stub_model(call: Call) -> str:
    """A deterministic stand-in that needs no network: plausible fields from the slot and sid; validators find nothing."""
    if call.agent in VALIDATORS:
        return json.dumps({"issues": [], "final_ready": True})
    sid, slot = call.facts.get("id", 0), call.facts.get("_采样约束") or {}
    pick = lambda values, salt: values[int(hashlib.md5(f"{sid}:{salt}".encode()).hexdigest(), 16) % len(values)]
    grade = "初二" if call.constraint == MODES["grade_chu2"] else "初三" if call.constraint == MODES["age_15"] else slot.get("年级") or pick(S.GRADES, "g")
    age = 15 if call.constraint == MODES["age_15"] else S.GRADE_AGES[grade][0]
    cluster = (slot.get("优势学科偏向") or [pick(S.SUBJECT_CLUSTERS, "c")])[0]
    others = [s for c, own in S.CLUSTER_SUBJECTS.items() if c != cluster for s in own]
    level = slot.get("目标学术水平") or pick(S.LEVELS, "l")
    word = lambda salt: "".join(pick("天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏", f"{salt}{i}") for i in range(40))
    facts = {
        "姓名": pick("赵钱孙李周吴郑王", "n") + pick("明芳强丽伟静", "m"), "年龄": age, "性别": slot.get("性别") or pick(S.GENDERS, "s"), "年级": grade,
        "发展阶段": dict(zip(S.STAGE_FIELDS, ("具体运算阶段", "勤奋对自卑", "习俗水平"), strict=True)), "代理名": f"{pick(['zhao4', 'li3', 'wang2'], 'a')}_{pick(['ming2', 'fang1', 'wei3'], 'b')}",
        "擅长科目": S.CLUSTER_SUBJECTS.get(cluster, ["语文"])[:2], "薄弱科目": [pick(others, "w")], "学术水平": level, "人格": "认真 " + word("p"),
        "价值观": "道德修养中，身心健康中，法治意识较低，社会责任低，" + word("v") * 2, "社交关系": "与同伴相处融洽，" + word("r"),
        "创造力": "流畅性中，新颖性中，灵活性低，可行性中，问题发现较低，提出方案中，总结：" + word("c") * 2, "心理健康": "综合心理状况中，幸福指数中，抑郁风险轻度，焦虑风险轻度，背景：" + word("h") * 2,
    }
    fields = next(a.fields for a in (*AGENTS, SINGLE) if a.name == call.agent)
    return json.dumps({k: facts[k] for k in fields}, ensure_ascii=False)


def _reply(model: Model, call: Call) -> str:
    """A model's response as text; busy servers are asked again after growing pauses."""

    def once() -> tuple[int, Any, float | None]:
        got = model(call)
        return got if isinstance(got, tuple) else (200, got, None)

    got = with_backoff(once)
    return got if isinstance(got, str) else json.dumps(got, ensure_ascii=False)


def ask(rows: DataFrame, model: Model, agent: Agent, turn: int, to: str = "answer", revise: bool = False, constraint: str = "") -> DataFrame:
    """``rows`` (sid, facts as JSON, issues, ...) with the string ``to``: the text in the model's response to ``agent``.

    With ``revise`` only rows with an issue that the agent owns are asked, the others get null, and the model sees the issues. Of a call that
    fails the answer is empty, and what it raised is added to ``faults``. With models by name, rows are asked of their ``provider``. Seeds follow from the sid, the agent and ``turn``, so a task that runs again asks the same.
    """
    schema = rows.select("*", F.lit(None).cast("string").alias("_body")).schema

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            bodies, faults = [], [list(x) if x is not None else [] for x in part["faults"]]
            providers = part["provider"] if "provider" in part.columns else [None] * len(part)
            for n, (sid, facts, issues, provider) in enumerate(zip(part["sid"], part["facts"], part["issues"], providers, strict=True)):
                own = [{k: list(v) if k == "fields" and v is not None else v for k, v in x.items()} for x in (issues if issues is not None else [])]
                if revise and agent.name not in {x["owner"] for x in own}:
                    bodies.append(None)
                    continue
                seed = int(hashlib.md5(f"{sid}:{agent.name}:{turn}".encode()).hexdigest(), 16) % (9 * 10**16) + 10**16
                call = Call(agent.name, json.loads(facts), f"SEED-{seed}", agent.temperature, agent.max_tokens, "revise" if revise else "propose", own if revise else [], constraint)
                try:
                    bodies.append(_reply(model if callable(model) else model[provider], call))
                except Exception as e:  # noqa: BLE001  one call's fault is its record's, not the run's
                    bodies.append("")
                    faults[n].append(f"{agent.name}: {type(e).__name__}: {e}")
            yield part.assign(_body=bodies, faults=faults)

    asked = rows.mapInPandas(run, schema)
    return asked.withColumn(to, J.response_content(F.col("_body"))).drop("_body")


def merged(rows: DataFrame, agent: Agent, answer: str = "answer") -> DataFrame:
    """``rows`` with the object in ``answer`` laid over the facts, known fields only; answers without an object change nothing.

    Of the agent that owns the academic level, the level becomes a strict one, the slot's if there is one.
    """
    kept = rows.withColumns({"_new": J.repaired(F.col(answer)), "_old": F.try_parse_json("facts")})
    kept = kept.withColumn("_ok", F.coalesce(J.kind_of(F.col("_new")) == "object", F.lit(False)))
    parts = []
    for k in S.FIELDS:
        text = F.to_json(J.field("_old", k))
        if k not in ("id", "_采样约束"):
            new = J.field_by_alias("_new", k)
            shown = F.to_json(new)
            if k == "学术水平" and k in agent.fields:
                target = J.field(J.field("_old", "_采样约束"), "目标学术水平", "string")
                strict = normalised_level(F.when(J.kind_of(new) == "string", J.as_text(new)), target)
                shown = F.coalesce(F.to_json(strict.cast("variant")), shown)
            text = F.coalesce(F.when(F.col("_ok"), shown), text)
        parts.append(F.concat(F.lit(f'"{k}":'), text))
    facts = F.concat(F.lit("{"), F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull()), ","), F.lit("}"))
    return kept.withColumn("facts", facts).drop("_new", "_old", "_ok", answer)


_ISSUES = "array<struct<code:string,desc:string,owner:string,fields:array<string>,hint:string>>"


def _first(slots: DataFrame) -> DataFrame:
    facts = F.to_json(F.struct(F.col("sid").alias("id"), F.col("slot").alias("_采样约束")))
    return slots.select("sid", facts.alias("facts"), F.array().cast(_ISSUES).alias("issues"), F.array().cast("array<string>").alias("faults"), *(["provider"] if "provider" in slots.columns else []))


def _with(rows: DataFrame) -> list[str]:
    return [c for c in _WITH if c in rows.columns]


def _judged(rows: DataFrame, model: Model, name: str, turn: int) -> DataFrame:
    """(sid, facts, issues, ready) and what goes with them: a validator's issues and word; the deep one's with those that need no model.

    A validator whose answer holds no object has one issue of its own.
    """
    answer = ask(rows.select("sid", "facts", "issues", *_with(rows)), model, VALIDATORS[name], turn).withColumn("_v", J.repaired(F.col("answer")))
    told = J.field("_v", "issues")
    listed = F.coalesce(F.when(J.kind_of(told) == "array", F.from_json(F.to_json(told), _ISSUES)), F.array().cast(_ISSUES))
    lost = ("F_SYS", "按指令，仅返回含 issues 与 final_ready 的 JSON。") if name == "fast" else ("SYS", "重新完整给出。")
    none = F.array(F.struct(F.lit(lost[0]).alias("code"), F.lit("解析失败").alias("desc"), F.lit(AGENTS[0].name).alias("owner"), F.array(F.lit("姓名")).alias("fields"), F.lit(lost[1]).alias("hint"))).cast(_ISSUES)
    object_ = F.coalesce(J.kind_of(F.col("_v")) == "object", F.lit(False))
    record = normalised(answer.withColumn("record", F.parse_json("facts")))
    local = rules.deep_issues().cast(_ISSUES) if name == "deep" else F.array().cast(_ISSUES)
    issues = F.concat(F.when(object_, listed).otherwise(none), local)
    said = J.field("_v", "final_ready")
    ready = object_ & F.coalesce(F.try_variant_get(said, "$", "boolean"), F.size(listed) == 0 if name == "fast" else F.lit(False))
    return stored(record.select("sid", "facts", issues.alias("issues"), (ready & (F.size(issues) == 0)).alias("ready"), *_with(rows)))


def orchestrate(slots: DataFrame, model: Model = stub_model, max_rounds: int = 3, turn: int = 0) -> DataFrame:
    """(sid, facts, issues) and what goes with them: proposals for ``slots`` (sid, slot), revised for at most ``max_rounds`` rounds.

    Records that the fast validator passes leave at once. The others go through rounds: the deep validator and the local checks, then the owners of
    issues, who see them, one after another. Records leave when they have none, or after the last round with those it found; the online
    rules decide on them.
    """
    rows = _first(slots)
    for agent in AGENTS:
        rows = merged(ask(rows, model, agent, turn), agent)
    quick = _judged(rows, model, "fast", turn)
    out = quick.where("ready")
    open_ = quick.where("not ready")
    for k in range(1, max_rounds + 1):
        if open_.isEmpty():
            break
        deep = _judged(open_, model, "deep", turn * 100 + k)
        out = out.unionByName(deep.where("ready"))
        rows = deep.where("not ready").drop("ready")
        for agent in AGENTS:
            rows = merged(ask(rows, model, agent, turn * 100 + k, revise=True), agent)
        open_ = stored(rows.withColumn("ready", F.lit(False)))
    return out.unionByName(open_).drop("ready")


@dataclass
class Outcome:
    """Accepted records (sid, facts, h), and the rows that failed for good (sid, error, attempts)."""

    accepted: DataFrame
    failures: DataFrame


def _outcome(slots: DataFrame, kept: list[DataFrame], failed: list[DataFrame]) -> Outcome:
    spark = slots.sparkSession
    accepted = spark.createDataFrame([], "sid long, facts string, h long")
    failures = spark.createDataFrame([], "sid long, error string, attempts int")
    for x in kept:
        accepted = accepted.unionByName(x)
    for x in failed:
        failures = failures.unionByName(x)
    return Outcome(accepted, failures)


def generate(slots: DataFrame, model: Model = stub_model, accepted_before: DataFrame | None = None, attempts: int = 4, max_rounds: int = 3, threshold: int = 3, providers: DataFrame | None = None) -> Outcome:
    """Generate records for ``slots`` in at most ``attempts`` passes.

    With ``providers`` (``pool.FIELDS``), ``model`` holds a model for each name, and each pass allots its slots to them; a provider whose records fail comes later in the next pass.

    What passes the online rules meets the similarity gate with all hashes accepted before (h); a near record fails at once, any other
    failure is tried again until the attempts are used up.
    """
    spark = slots.sparkSession
    waiting, kept, failed = slots, [], []
    known = accepted_before.select("h") if accepted_before is not None else spark.createDataFrame([], "h long")
    for attempt in range(1, attempts + 1):
        if waiting.isEmpty():
            break
        made = orchestrate(pool.allot(waiting, providers) if providers is not None else waiting, model, max_rounds, attempt)
        record = normalised(made.withColumn("record", F.parse_json("facts"))).withColumn("reasons", rules.online_reasons())
        texts = [F.col(f"`{k}`") for k in S.KEY_TEXT_FIELDS]
        judged = stored(record.select("sid", "facts", "issues", "reasons", simhash64(key_text(texts)).alias("h"), *_with(made)))
        if providers is not None:
            providers = stored(pool.updated(providers, judged.select("provider", (F.size("reasons") == 0).alias("ok"))))
        good = judged.where(F.size("reasons") == 0)
        # Ids below 1 stand for what was accepted before, so that it comes first.
        before = known.distinct().select(F.lit(0).cast("long").alias("sid"), "h")
        verdict = gate(before.unionByName(good.select("sid", "h")), threshold, "sid", "h")
        passed = stored(good.join(verdict.where("accepted and sid > 0").select("sid"), "sid", "left_semi").select("sid", "facts", "h"))
        kept.append(passed)
        known = known.unionByName(passed.select("h"))
        near = good.join(passed.select("sid"), "sid", "left_anti").select("sid", F.lit("SimHash: near an accepted record").alias("error"))
        bad = judged.where(F.size("reasons") > 0).select("sid", F.concat_ws("; ", "reasons", F.transform("issues", lambda x: x["code"]), "faults").alias("error"))
        again, final = route_failures(near.unionByName(bad).withColumn("attempts", F.lit(attempt)), attempts)
        failed.append(final)
        waiting = stored(waiting.join(again.select("sid"), "sid", "left_semi"))
    return _outcome(slots, kept, failed)


def route_failures(failures: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Failures (sid, error, attempts) to try again, and those that are final: near duplicates and used-up attempts."""
    final = F.contains("error", F.lit("SimHash")) | (F.col("attempts") >= limit)
    return failures.where(~final), failures.where(final)


def used_names(accepted: DataFrame) -> DataFrame:
    """(姓名): the distinct names of accepted records."""
    return accepted.select(F.get_json_object("facts", "$.姓名").alias("姓名")).distinct()


def single_shot(slots: DataFrame, mode: str = "unconstrained", model: Model = stub_model, retries: int = 3) -> Outcome:
    """The control group: one prompt for all fields under the constraint of ``mode``, one seed over all tries, judged by the baseline rules and the
    constraint, without revision or gate. Ends as soon as no slot waits."""
    waiting, kept, failed = stored(_first(slots)), [], []
    for attempt in range(1, retries + 1):
        if waiting.isEmpty():
            break
        made = merged(ask(waiting, model, SINGLE, 0, constraint=MODES[mode]), Agent(SINGLE.name, (), SINGLE.temperature, SINGLE.max_tokens))
        record = normalised(made.withColumn("record", F.parse_json("facts")))
        ok = (F.size("reasons") == 0) & F.col("met")
        judged = stored(record.select("sid", "facts", "faults", rules.baseline_reasons().alias("reasons"), rules.constraint(mode).alias("met")).withColumn("ok", ok))
        kept.append(judged.where("ok").select("sid", "facts", F.lit(0).cast("long").alias("h")))
        if attempt == retries:
            why = F.concat_ws("; ", "reasons", F.when(~F.col("met"), F.lit(f"constraint {mode}")), "faults")
            failed.append(judged.where("not ok").select("sid", why.alias("error"), F.lit(attempt).alias("attempts")))
        waiting = stored(waiting.join(judged.where("not ok").select("sid"), "sid", "left_semi"))
    return _outcome(slots, kept, failed)
