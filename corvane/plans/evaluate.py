"""Evaluation of a run: one wide projection of features, then rules, duplicates, diversity, distributions and alignment."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane import schema as S
from corvane.functions import text as X
from corvane.functions.simhash import simhash64
from corvane.operators import dedup, metrics, rules
from corvane.operators.materialise import stored
from corvane.sources.records import normalised, numbered, read_records, read_run_records
from corvane.sources.sinks import save_report


@dataclass
class Evaluation:
    summary: dict
    items: DataFrame
    near: DataFrame
    suspicious: DataFrame
    buckets: DataFrame


def features(records: DataFrame, profile: str = "full", *kept: str) -> DataFrame:
    """Normalised records with rule messages, paragraph lengths, similarities, scores, hash and token count, and the columns ``kept`` of the records."""
    n = normalised(records)
    similar = rules.paragraph_similarities()
    return rules.per_item(n, profile).select(
        *kept, "row_idx", "id", *(F.col(f"`{k}`") for k in ("姓名", "年级", "性别", "学术水平", "擅长科目", "薄弱科目", *S.PARAGRAPHS, "社交关系")), "errors", "warnings",
        *(F.char_length(X.without_blanks(F.col(f"`{k}`"))).alias(f"len_{k}") for k in S.PARAGRAPHS), *(v.alias(k) for k, v in similar.items()),
        F.element_at(F.create_map(*[F.lit(x) for kv in S.LEVEL_NUMBER.items() for x in kv]), F.col("`学术水平`")).cast("double").alias("level_number"),
        X.polarity(F.col("`价值观`")).alias("value_score"), X.polarity(F.col("`创造力`")).alias("creativity_score"), X.psychology_polarity(F.col("`心理健康`")).alias("psychology_score"),
        simhash64(X.key_text([F.col(f"`{k}`") for k in S.KEY_TEXT_FIELDS])).alias("h"), F.char_length(X.without_blanks(F.to_json("record"))).alias("token_full_profile"),
    )


def evaluate(spark: SparkSession, directory: str, profile: str = "full", threshold: int = 3, top: int = 100, limit: int | None = 10_000, schedule: DataFrame | None = None) -> Evaluation:
    """All metrics of a run's records, the first ``limit`` in order (all without it)."""
    records = numbered(read_records(spark, directory, chunked=profile == "chunk"))
    if limit is not None:
        records = records.where(F.col("row_idx") < limit)
    f = stored(features(records, profile))
    rates = metrics.rates(f).first().asDict()
    near = stored(dedup.first_pairs(f, top, threshold, "row_idx", "h"))
    names = f.select(F.col("row_idx"), F.col("id"), F.col("`姓名`"))
    near_named = near.join(names.toDF("id_i", "record_i", "姓名_i"), "id_i").join(names.toDF("id_j", "record_j", "姓名_j"), "id_j").select(F.col("id_i").alias("i"), F.col("id_j").alias("j"), F.col("record_i").alias("id_i"), F.col("record_j").alias("id_j"), "姓名_i", "姓名_j")
    text = F.concat_ws("", *(F.col(f"`{k}`") for k in (*S.PARAGRAPHS, "社交关系")))
    tokens = X.char_tokens(F.concat_ws(" ", *(F.col(f"`{k}`") for k in S.PARAGRAPHS)))
    buckets = metrics.bucket_counts(f, "年级", "性别", "学术水平")
    summary = rates | {"near_duplicate_pairs": near.count()}
    summary |= {f"hamming_{k}": v for k, v in metrics.hamming_stats(f, id_col="row_idx").first().asDict().items()}
    joined = F.concat_ws(" ", *(F.col(f"`{k}`") for k in S.PARAGRAPHS))
    for n in (1, 2):
        part = metrics.distinct_n(f, tokens, n) if profile == "full" else metrics.distinct_n_corpus(f.withColumn("_text", joined), "_text", "row_idx", n)
        summary |= part.first().asDict()
    if profile == "full":
        summary |= metrics.self_bleu(f, tokens, "row_idx").first().asDict()
        for bucket, prior in (("学术水平", S.PRIOR_LEVEL), ("性别", S.PRIOR_GENDER), ("年级", S.PRIOR_GRADE)):
            q = spark.createDataFrame(list(prior.items()), "key string, q double")
            summary[f"kl_{bucket}"] = metrics.kl_divergence(buckets.where(F.col("bucket") == bucket), q).first()["kl"]
        for k in ("value_score", "creativity_score", "psychology_score"):
            summary[f"pearson_{k}"] = metrics.pearson(f.where("level_number is not null"), "level_number", k).first()["pearson"]
        for k in S.PARAGRAPHS:
            summary |= {f"len_{k}_{m}": v for m, v in metrics.length_stats(f, f"len_{k}", S.SHORTEST, S.LONGEST).first().asDict().items()}
        for k, subjects in (("strong", "擅长科目"), ("weak", "薄弱科目")):
            summary[f"{k}_mention_ratio"] = metrics.mention_ratio(f, F.col(f"`{subjects}`"), text).first()["ratio"]
        summary |= f.agg(*(F.coalesce(F.avg(k), F.lit(0.0)).alias(f"jaccard_{k}") for k in ("val_cre", "val_psy", "cre_psy")), F.sum("token_full_profile").alias("tokens"), F.avg("token_full_profile").alias("tokens_mean"), F.min("token_full_profile").alias("tokens_min"), F.max("token_full_profile").alias("tokens_max")).first().asDict()
        if schedule is not None:
            matched = metrics.plan_match(f, schedule, {"年级": "年级", "性别": "性别", "学术水平": "目标学术水平"})
            summary |= {f"plan_{r['attribute']}": r["rate"] for r in matched.collect()}
            for attribute, slot in (("年级", "年级"), ("性别", "性别"), ("学术水平", "目标学术水平")):
                met = f.join(schedule, f["id"] == schedule["sid"])
                total = met.count()
                q = met.groupBy(F.col(f"slot.`{slot}`").alias("key")).agg((F.count(F.lit(1)) / max(total, 1)).alias("q"))
                summary[f"plan_kl_{attribute}"] = metrics.kl_divergence(met.groupBy(F.col(f"`{attribute}`").alias("key")).agg(F.count(F.lit(1)).alias("count")), q).first()["kl"]
    score = metrics.quality_score(*(F.lit(float(summary[k] or 0)) for k in ("missing_rate", "age_rate", "paragraph_rate", "level_rate", "distinct_1", "distinct_2")))
    summary["score"] = spark.range(1).select(score.alias("s")).first()["s"]
    items = f.select("row_idx", "id", *(F.col(f"`{k}`") for k in ("姓名", "年级", "性别", "学术水平")), "errors", "warnings", "token_full_profile")
    return Evaluation(summary, items, near_named, metrics.suspicious(items, "row_idx", top), buckets)


def run_index(records: DataFrame, threshold: int = 3, top: int = 100) -> DataFrame:
    """The index of all runs in ``records`` (run_id, path, place, record): every measure of the chunk evaluator for each run, in as many jobs for many runs as for one.

    Rows are numbered once over all runs, whose paths keep their rows together; near pairs are sought by keys that hold the run, n-grams go on from record to record
    within a run alone, and everything else is grouped by run.
    """
    own = numbered(records, "place")
    f = stored(features(own, "chunk", "run_id"))
    joined = f.withColumn("_text", F.concat_ws(" ", *(F.col(f"`{k}`") for k in S.PARAGRAPHS)))
    index = metrics.rates(f, "run_id").join(dedup.pair_numbers(f, "run_id", threshold), "run_id", "left")
    for n in (1, 2):
        index = index.join(metrics.distinct_n_corpus(joined, "_text", "row_idx", n, "run_id"), "run_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    shares = [zero(F.col(k)) for k in ("missing_rate", "age_rate", "paragraph_rate", "level_rate", "distinct_1", "distinct_2")]
    return index.select(
        "run_id", F.col("n").alias("records"), "error_rate", "warning_rate", zero("distinct_1").alias("distinct_1"), zero("distinct_2").alias("distinct_2"),
        F.least(F.coalesce("pairs", F.lit(0)), F.lit(top)).cast("long").alias("near_duplicate_pairs"), metrics.quality_score(*shares).alias("score_overall_0_100"),
    )


def evaluate_runs(spark: SparkSession, root: str, reports: str | None = None, threshold: int = 3, top: int = 100) -> DataFrame:
    """The index of all runs below ``root`` that hold records. With ``reports``, each run's report set is written below it besides, which takes a run after
    the other."""
    index = run_index(read_run_records(spark, root), threshold, top)
    if reports:
        index = stored(index)
        for (run,) in index.select("run_id").orderBy("run_id").collect():
            e = evaluate(spark, f"{root}/{run}", "chunk", threshold, top, limit=None)
            save_report(f"{reports}/{run}", e.summary, e.items, e.near, e.suspicious, e.buckets)
    return index
