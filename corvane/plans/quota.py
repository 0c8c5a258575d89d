"""Quota schedules, chunk numbers, resuming, and the sizes of generation batches."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane import schema as S


def triplet(position: Column) -> dict[str, Column]:
    """Grade, gender and subject cluster of a position, cycling through all 96 with the grade slowest."""
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))
    p = F.pmod(position, F.lit(len(S.GRADES) * len(S.GENDERS) * len(S.SUBJECT_CLUSTERS)))
    clusters, genders = len(S.SUBJECT_CLUSTERS), len(S.GENDERS)
    return {
        "年级": pick(S.GRADES, F.floor(p / (clusters * genders))),
        "性别": pick(S.GENDERS, F.pmod(F.floor(p / clusters), F.lit(genders))),
        "优势学科偏向": pick(S.SUBJECT_CLUSTERS, F.pmod(p, F.lit(clusters))),
    }


def level_counts(n: int, mix: dict[str, float]) -> dict[str, int]:
    """How many of ``n`` slots each level gets: rounded shares (halves to even), the remainder one by one from the largest share
    down, never below 0; equal shares go in the order of the levels."""
    counts = {x: round(mix.get(x, 0.0) * n) for x in S.LEVELS}
    order = sorted(S.LEVELS, key=lambda x: (-mix.get(x, 0.0), S.LEVELS.index(x)))
    i = 0
    while (gap := n - sum(counts.values())) != 0:
        level = order[i % len(order)]
        if gap > 0 or counts[level] > 0:
            counts[level] += 1 if gap > 0 else -1
        i += 1
    return counts


def shuffled_place(n: int, position: Column, seed: int) -> Column:
    """A permutation of 0 to n - 1 that every row computes for itself: a few rounds of a keyed Feistel network on the smallest
    even number of bits that holds n, walked on until the value is below n."""
    half = max(1, (max(2, n) - 1).bit_length() + 1 >> 1)
    mask = F.lit((1 << half) - 1).cast("long")

    def once(x: Column) -> Column:
        left, right = F.shiftright(x, half), x.bitwiseAND(mask)
        for r in range(4):
            left, right = right, left.bitwiseXOR(F.xxhash64(right, F.lit(seed * 4 + r)).bitwiseAND(mask))
        return F.shiftleft(left, half).bitwiseOR(right)

    # At most three quarters of the values are out of range, so 128 steps leave one with a chance below 1e-15.
    steps = F.sequence(F.lit(1), F.lit(128))
    return F.aggregate(steps, once(position.cast("long")), lambda x, _: F.when(x < n, x).otherwise(once(x)))


def schedule(spark: SparkSession, n: int, mix: dict[str, float] | None = None, seed: int = 42, quota: DataFrame | None = None) -> DataFrame:
    """(sid, slot): ``n`` slots from a user's quota (pos, slot; cycled if it is shorter) or the 96 triplets, in shuffled order,
    with the levels of ``mix`` in an order shuffled apart from it."""
    counts = level_counts(n, mix or S.PRIOR_LEVEL)
    rows = spark.range(n).select(F.col("id"), shuffled_place(n, F.col("id"), seed).alias("_place"), shuffled_place(n, F.col("id"), seed + 1).alias("_level_place"))
    level, ends = F.lit(S.LEVELS[-1]), 0
    cases = []
    for x in S.LEVELS:
        ends += counts[x]
        cases.append((ends, x))
    for end, x in reversed(cases[:-1]):
        level = F.when(F.col("_level_place") < end, x).otherwise(level)
    if quota is None:
        parts = triplet(F.col("_place"))
        slot = F.struct(parts["年级"].alias("年级"), parts["性别"].alias("性别"), F.array(parts["优势学科偏向"]).alias("优势学科偏向"), level.alias("目标学术水平"))
        return rows.select((F.col("id") + 1).alias("sid"), slot.alias("slot"))
    size = quota.count()
    if not size:
        raise ValueError("the quota has no slots")
    joined = rows.withColumn("pos", F.pmod("id", F.lit(size))).join(quota, "pos")
    return joined.select((F.col("id") + 1).alias("sid"), F.col("slot").withField("`目标学术水平`", level).alias("slot"))


def round_robin_levels(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """(sid, level): the four levels in turn, shuffled."""
    place = F.pmod(shuffled_place(n, F.col("id"), seed), F.lit(len(S.LEVELS)))
    return spark.range(n).select((F.col("id") + 1).alias("sid"), F.element_at(F.array(*map(F.lit, S.LEVELS)), (place + 1).cast("int")).alias("level"))


def chunk_no(sid: Column, size: int) -> Column:
    return F.floor((sid - 1) / size) + 1


def pending(spark: SparkSession, n: int, completed: DataFrame) -> DataFrame:
    """(sid) from 1 to ``n`` that ``completed`` (sid) lacks."""
    return spark.range(1, n + 1).select(F.col("id").alias("sid")).join(completed.select("sid"), "sid", "left_anti")


def slots_of(sids: DataFrame, schedule: DataFrame) -> DataFrame:
    """``sids`` (sid) with their slot; null for those that the schedule lacks."""
    return sids.join(schedule.select("sid", "slot"), "sid", "left")


def next_batch(waiting: DataFrame, size: int) -> DataFrame:
    """The ``size`` smallest waiting sids: gaps are filled first."""
    return waiting.orderBy("sid").limit(size)


def extend(existing: DataFrame, spark: SparkSession, n: int, mix: dict[str, float] | None = None, seed: int = 42) -> DataFrame:
    """``existing`` (sid, slot) with new slots for the sids up to ``n`` that it lacks."""
    fresh = schedule(spark, n, mix, seed).join(existing.select("sid"), "sid", "left_anti")
    return existing.select("sid", "slot").unionByName(fresh)


def concurrency(qpm: float, latency: float = 1.0, violated: bool = False) -> int:
    """Calls in flight for a quota of calls a minute and a latency in seconds, fewer after a violation; at least 1."""
    return max(1, math.ceil(1.3 * qpm / 60 * min(max(latency, 0.2), 30) * (0.7 if violated else 1)))


def batch_size(per_step: int, in_flight: int) -> int:
    return max(per_step, 2 * in_flight)


def assert_same_run(meta: dict, total: int, chunk: int) -> None:
    """A run goes on only under the numbers it began with."""
    if meta and (meta.get("total_n"), meta.get("chunk_size")) != (total, chunk):
        raise ValueError(f"the run began with {meta.get('total_n')} records in chunks of {meta.get('chunk_size')}, not {total} in {chunk}")
