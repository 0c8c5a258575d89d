"""Sinks: idempotent chunked records, failures, schedules, reports, the index over runs, provider files."""

from __future__ import annotations

import json
import shutil
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane import schema as S
from corvane.functions import json_text as J
from corvane.functions.text import ascii_bar
from corvane.plans.quota import chunk_no


def canonical(record: Column | str = "record") -> Column:
    """The record as JSON with the known keys in their fixed order. Null and missing keys go; a stage that is no object becomes one with a
    remark; a subject that is no list becomes a list of one, a null one an empty list."""
    parts = []
    for k in S.FIELDS:
        v = J.field_by_alias(record, k)
        kind, text = J.kind_of(v), F.to_json(v)
        if k == "发展阶段":
            text = F.when(kind == "object", text).when(~kind.isin("null", "missing"), F.concat(F.lit('{"备注":'), F.to_json(J.as_text(v).cast("variant")), F.lit("}")))
        elif k in ("擅长科目", "薄弱科目"):
            text = F.when(kind == "array", text).when(kind == "null", "[]").when(kind != "missing", F.concat(F.lit("["), F.to_json(J.as_text(v).cast("variant")), F.lit("]")))
        else:
            text = F.when(~kind.isin("null", "missing"), text)
        parts.append(F.concat(F.lit(f'"{k}":'), text))
    return F.concat(F.lit("{"), F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull()), ","), F.lit("}"))


def append_records(records: DataFrame, completed: DataFrame, directory: str, chunk_size: int, keep_as_is: bool = False) -> DataFrame:
    """Append the records (sid, record) whose sid isn't in ``completed`` (sid), one of each sid, to the chunk of its number.

    Chunks are directories ``chunk=students_chunk_<n>.jsonl`` of part files, so that writers never share a file, and all are written by one job.
    Gives the sids written.
    """
    from corvane.operators.materialise import stored

    line = F.to_json("record") if keep_as_is else canonical("record")
    # Lines cost most, so they are made of the records that are left.
    fresh = records.select("sid", "record").join(completed.select("sid"), "sid", "left_anti").dropDuplicates(["sid"]).select("sid", line.alias("value"))
    fresh = stored(fresh.withColumn("chunk", F.format_string("students_chunk_%d.jsonl", chunk_no(F.col("sid"), chunk_size))))
    # As many writers as the session's shuffles have, for each opens a file for every chunk that it gets.
    writers = int(fresh.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fresh.repartition(writers, "chunk").select("chunk", "value").write.mode("append").partitionBy("chunk").text(directory)
    return fresh.select("sid")


def next_sid(completed: DataFrame, total: int) -> int | None:
    """The smallest sid from 1 to ``total`` that isn't completed."""
    from corvane.plans.quota import pending

    return pending(completed.sparkSession, total, completed).agg(F.min("sid")).first()[0]


def append_failures(failures: DataFrame, directory: str) -> None:
    """Append (sid, error, attempts) with the time of writing in epoch seconds."""
    failures.withColumn("ts", F.unix_timestamp().cast("double")).write.mode("append").json(f"{directory}/failures.jsonl")


def save_schedule(schedule: DataFrame, directory: str) -> None:
    schedule.select("sid", "slot").write.mode("overwrite").json(f"{directory}/schedule.jsonl")


def save_meta(spark, directory: str, total: int, chunk_size: int, **more) -> None:
    """One small record, written by Spark so that any store serves; ``read_meta`` reads it."""
    text = json.dumps({"total_n": total, "chunk_size": chunk_size} | more, ensure_ascii=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{directory}/meta.json")


def _save_lines(path: str, head: list[str], rows: DataFrame, order: list[str], tail: list[str]) -> None:
    """Text of ``head``, the lines in ``rows`` (line) in their order, and ``tail``. Written in order by Spark, so that no number of lines is too large."""
    spark = rows.sparkSession
    ends = [(k, i, x) for k, part in ((0, head), (2, tail)) for i, x in enumerate(part)]
    fixed = spark.createDataFrame(ends, "_k int, _i int, line string")
    own = rows.select(F.lit(1).alias("_k"), F.lit(0).alias("_i"), "line", F.struct(*order).alias("_o"))
    both = own.unionByName(fixed, allowMissingColumns=True)
    both.orderBy("_k", "_i", "_o").select("line").write.mode("overwrite").text(path)


def save_report(directory: str, summary: dict, items: DataFrame, near: DataFrame, suspicious: DataFrame, buckets: DataFrame) -> None:
    """The report set of one run, written by Spark: the summary, the items, near pairs, suspicious items, buckets, and a dashboard of all of the buckets."""
    spark = items.sparkSession
    items.write.mode("overwrite").json(f"{directory}/per_item.jsonl")
    near.write.mode("overwrite").json(f"{directory}/near_duplicates.json")
    suspicious.write.mode("overwrite").json(f"{directory}/suspicious_samples.json")
    buckets.write.mode("overwrite").option("header", True).csv(f"{directory}/buckets.csv")
    totals = buckets.groupBy("bucket").agg(F.greatest(F.sum("count"), F.lit(1)).alias("_total"))
    share = F.col("count") / F.col("_total")
    line = F.concat_ws(" ", "bucket", "key", ascii_bar(share, 30), F.col("count").cast("string"))
    lines = buckets.join(totals, "bucket").select(line.alias("line"), "bucket", (-F.col("count")).alias("_less"), "key")
    board = ["# Dashboard", "", *(f"- {k}: {round(v, 4) if isinstance(v, float) else v}" for k, v in summary.items()), "", "```"]
    _save_lines(f"{directory}/dashboard.md", board, lines, ["bucket", "_less", "key"], ["```"])
    spark.createDataFrame([(json.dumps(summary, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(f"{directory}/summary.json")


def save_index(runs: DataFrame, directory: str) -> None:
    """One row for each run, as CSV, JSON and an overview of all of them."""
    runs.write.mode("overwrite").option("header", True).csv(f"{directory}/_index.csv")
    runs.write.mode("overwrite").json(f"{directory}/_index.json")
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in runs.columns]
    lines = runs.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"), "run_id")
    head = ["# Runs", "", "| " + " | ".join(runs.columns) + " |", "|" + "-|" * len(runs.columns)]
    _save_lines(f"{directory}/overview.md", head, lines, ["run_id"], [])


def unhealthy(counts: DataFrame, threshold: int = 5) -> DataFrame:
    """Names with ``threshold`` failures or more."""
    return counts.where(F.col("failures") >= threshold).select("name")


def remove_providers(path: str, names: set[str], dry_run: bool = False) -> tuple[list[str], list[str]]:
    """Rewrite a provider list without ``names``, after a copy beside it; gives the names kept and removed."""
    from corvane.sources.records import load_providers

    found, _ = load_providers(path)
    kept = [p for p in found if p.name not in names]
    if not dry_run and len(kept) < len(found):
        shutil.copyfile(path, f"{path}.bak")
        Path(path).write_text(json.dumps([p.__dict__ for p in kept], ensure_ascii=False, indent=1), encoding="utf-8")
    return [p.name for p in kept], [p.name for p in found if p.name in names]


def is_safe_subpath(root: str, path: str) -> bool:
    """Whether ``path`` stays below ``root`` once links and dots are resolved."""
    base = Path(root).resolve()
    return base in (Path(root) / path).resolve().parents
