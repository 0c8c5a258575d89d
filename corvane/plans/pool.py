"""A pool of providers: their scores and capacities, and which of them takes which call of a batch.

A provider table has one row for each endpoint: (name, latency, success, used, calls, capacity). The best score comes first and takes as many calls as its
capacity allows, then the next one, and so on; what is left after the last goes round again. Calls are numbered over range partitions and
meet the provider of their place by an equi-join, so nothing of a batch passes through one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.sources.records import numbered
from corvane.streaming.limiter import provider_score

FIELDS = "name string, latency double, success double, used double, calls long, capacity long"


def concurrency_of(qpm: Column, latency: Column, violated: Column) -> Column:
    """:func:`corvane.plans.quota.concurrency` of a row: calls in flight for a quota of calls a minute."""
    held = F.least(F.greatest(latency, F.lit(0.2)), F.lit(30.0))
    return F.greatest(F.lit(1), F.ceil(1.3 * qpm / 60 * held * F.when(violated, 0.7).otherwise(1.0))).cast("long")


def ranked(providers: DataFrame) -> DataFrame:
    """(name, score, capacity, low, total): providers by score and then name, with the places that come before theirs. ``capacity`` is at least 1."""
    total = F.sum("calls").over(Window.partitionBy())
    scored = providers.select("name", provider_score(F.col("latency"), F.col("success"), F.col("used"), total, F.col("calls")).alias("score"), F.greatest(F.lit(1), F.col("capacity")).alias("capacity"))
    order = Window.orderBy("score", "name")
    low = F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return scored.select("name", "score", "capacity", low.alias("low"), F.sum("capacity").over(Window.partitionBy()).alias("total"))


def allot(calls: DataFrame, providers: DataFrame, sid: str = "sid") -> DataFrame:
    """``calls`` with the name of the ``provider`` that takes each, in the order of ``sid``, whose values are distinct."""
    if "provider" in calls.columns:
        calls = calls.drop("provider")
    places = ranked(providers)
    slots = places.select(F.col("name").alias("provider"), "total", F.explode(F.sequence(F.col("low"), F.col("low") + F.col("capacity") - 1)).alias("_slot"))
    # One row of one number, whatever the number of providers.
    total = places.agg(F.max("total").alias("_total"))
    placed = numbered(calls, sid, "_call").join(F.broadcast(total)).withColumn("_slot", F.pmod("_call", "_total"))
    return placed.join(slots.drop("total"), "_slot").select(*(F.col(f"`{c}`") for c in calls.columns), "provider")


def updated(providers: DataFrame, outcomes: DataFrame, weight: float = 0.2) -> DataFrame:
    """``providers`` after a batch: ``outcomes`` (provider, ok) moves the success of each by ``weight`` towards the batch's share, and its calls grow."""
    seen = outcomes.groupBy(F.col("provider").alias("name")).agg(F.avg(F.col("ok").cast("double")).alias("_share"), F.count(F.lit(1)).alias("_n"))
    kept = providers.join(seen, "name", "left")
    success = F.when(F.col("_share").isNull(), F.col("success")).otherwise(F.col("success") * (1 - weight) + F.col("_share") * weight)
    return kept.select("name", "latency", success.alias("success"), "used", (F.col("calls") + F.coalesce("_n", F.lit(0))).alias("calls"), "capacity")
