"""Record sources: JSON lines in one file or chunks, schedules, runs, progress, failures, provider lists."""

from __future__ import annotations

import functools
import json
import os
import re
from dataclasses import dataclass, field
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane import schema as S
from corvane.functions import json_text as J
from corvane.functions.text import stripped
from corvane.operators.materialise import stored
from corvane.sources.files import Files

#: Chunks are files, or directories of parts that the append sink writes.
MERGED, CHUNKS = "merged_students.jsonl", "*students_chunk_*.jsonl"
#: Bytes of the providers' names that are searched for in one pass over failures.
NAME_BYTES = 4 << 20
_RUN = r"([^/]+)/[^/]*students_chunk_\d+\.jsonl"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, place, line) of all non-blank lines; of a chunk that is a directory, the directory's path. ``place`` orders lines of all files as lexicographic paths do.

    Lines keep their order through their split's offset and their number within it; nothing is sorted here.
    """
    lines = spark.read.text(path)
    chunk = F.regexp_extract(F.col("_metadata.file_path"), r"^(.*students_chunk_\d+\.jsonl)/", 1)
    own = F.when(chunk != "", chunk).otherwise(F.col("_metadata.file_path"))
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return lines.select(own.alias("path"), place.alias("place"), F.col("value").alias("line")).where(stripped(F.col("line")) != "")


def parsed(lines: DataFrame) -> DataFrame:
    """``lines`` with the variant ``record``; malformed lines go."""
    return lines.withColumn("record", F.try_parse_json("line")).where("record is not null").drop("line")


def read_records(spark: SparkSession, directory: str, chunked: bool = False) -> DataFrame:
    """(path, place, record) of a run's objects. Valid JSON that is no object is left to :func:`read_quarantine`.

    Of a key that comes twice the last value counts, for which the session allows duplicate keys.
    """
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return parsed(read_lines(spark, f"{directory}/{CHUNKS if chunked else MERGED}")).where(J.kind_of(F.col("record")) == "object")


def read_quarantine(spark: SparkSession, directory: str, chunked: bool = False) -> DataFrame:
    """(path, line) of non-blank lines that aren't JSON objects."""
    lines = read_lines(spark, f"{directory}/{CHUNKS if chunked else MERGED}")
    return lines.where(~F.coalesce(J.kind_of(F.try_parse_json("line")) == "object", F.lit(False))).select("path", "line")


def line_counts(spark: SparkSession, directory: str) -> DataFrame:
    """(path, lines): non-blank lines of each chunk."""
    return read_lines(spark, f"{directory}/{CHUNKS}").groupBy("path").agg(F.count(F.lit(1)).alias("lines"))


def list_runs(spark: SparkSession, root: str) -> DataFrame:
    """(run_id) of the directories below ``root`` that hold chunks, by name; directories are listed, no file is opened."""
    files = Files(spark, root)
    runs = [(n,) for n in files.names() if any(re.search(r"students_chunk_\d+\.jsonl$", c) for c in files.names(n))]
    return spark.createDataFrame(runs, "run_id string").orderBy("run_id")


def read_run_records(spark: SparkSession, root: str) -> DataFrame:
    """(run_id, path, place, record) of all runs below ``root`` in one scan."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    rows = parsed(read_lines(spark, f"{root}/*/{CHUNKS}")).where(J.kind_of(F.col("record")) == "object")
    return rows.withColumn("run_id", F.regexp_extract("path", _RUN, 1))


_SLOT = "struct<`年级`:string,`性别`:string,`优势学科偏向`:array<string>,`目标学术水平`:string>"


def read_schedule(spark: SparkSession, path: str) -> DataFrame:
    """(sid, slot) of a schedule: elements ``{"sid", "slot"}``, or bare slots whose sid is their position from 1.

    Elements that are no objects, whose sid is no whole number or whose slot is no object go; the later of two equal sids
    stays; a missing or unreadable file gives no rows.
    """
    empty = spark.createDataFrame([], f"sid long, slot {_SLOT}")
    try:
        text = spark.read.text(path, wholetext=True)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return empty
        raise
    items = text.select(F.posexplode(F.try_variant_get(F.try_parse_json("value"), "$", "array<variant>")).alias("pos", "item"))
    sid, slot = J.field("item", "sid"), J.field("item", "slot")
    wrapped = sid.isNotNull() | slot.isNotNull()
    chosen = F.when(wrapped, slot).otherwise(F.col("item"))
    rows = items.where(J.kind_of(F.col("item")) == "object").select(
        "pos", F.when(wrapped, F.when(J.kind_of(sid) == "integer", F.try_variant_get(sid, "$", "long"))).otherwise(F.col("pos") + 1).cast("long").alias("sid"),
        F.when(J.kind_of(chosen) == "object", F.from_json(F.to_json(chosen), _SLOT)).alias("slot"),
    )
    return rows.where("sid is not null and slot is not null").groupBy("sid").agg(F.max_by("slot", "pos").alias("slot"))


def completed_ids(records: DataFrame) -> DataFrame:
    """(sid): the distinct positive whole ids of ``records``."""
    value = J.field("record", "id")
    sid = F.coalesce(F.try_variant_get(value, "$", "long"), F.try_variant_get(value, "$", "string").try_cast("long"))
    return records.select(sid.alias("sid")).where("sid > 0").distinct()


def chunk_number(path: str = "path"):
    return F.regexp_extract(path, r"students_chunk_(\d+)\.jsonl", 1).try_cast("long")


def last_chunk(spark: SparkSession, directory: str) -> str | None:
    """The path of the chunk of the largest number, from the directory's listing alone."""
    found = [(int(m.group(1)), n) for n in Files(spark, directory).names() if (m := re.search(r"students_chunk_(\d+)\.jsonl$", n))]
    return f"{directory}/{max(found)[1]}" if found else None


def read_last_chunk(spark: SparkSession, directory: str) -> DataFrame:
    """(path, place, record) of the last chunk's objects; nothing else is read."""
    path = last_chunk(spark, directory)
    if path is None:
        return read_records(spark, directory, chunked=True)
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return parsed(read_lines(spark, path)).where(J.kind_of(F.col("record")) == "object")


def progress(records: DataFrame) -> DataFrame:
    """(chunk_no, records) of the chunk of the largest number; one row, or none without chunks. Given :func:`read_last_chunk`, it reads that one alone."""
    counts = records.groupBy(chunk_number().alias("chunk_no")).agg(F.count(F.lit(1)).alias("records"))
    best = counts.agg(F.max(F.struct("chunk_no", "records")).alias("b")).where("b is not null")
    return best.select("b.chunk_no", "b.records")


def preview(records: DataFrame, n: int = 6) -> DataFrame:
    """The last ``n`` records in their order, of :func:`read_last_chunk` or of a whole run."""
    return records.orderBy(F.desc("place")).limit(n).orderBy("place")


def read_meta(spark: SparkSession, directory: str) -> dict:
    """The run's meta record; empty if there is none."""
    try:
        rows = spark.read.text(f"{directory}/meta.json", wholetext=True).collect()
        return json.loads(rows[0][0]) if rows else {}
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e) or isinstance(e, ValueError):
            return {}
        raise


@functools.lru_cache(2)
def _automaton(names: tuple[str, ...]):
    """Finds all names in one pass over a text; kept for a worker's next tasks."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for n, name in enumerate(names):
        found.add_word(name, n)
    found.make_automaton()
    return found


def rows_with_names(rows: DataFrame, names: list[str], text: str) -> DataFrame:
    """(name, rows): in how many rows' ``text`` each of the ``names`` stands; partial counts of a task, one row for each name that it found."""
    some = tuple(names)

    def run(batches):
        automaton, counts = _automaton(some), {}
        for batch in batches:
            for t in batch.column(0).to_pylist():
                for n in {n for _, n in automaton.iter(t)} if t else ():
                    counts[n] = counts.get(n, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([some[n] for n in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["name", "rows"])

    return rows.select(text).mapInArrow(run, "name string, rows long")


def failures_by_provider(failures: DataFrame, names: DataFrame, error: str = "error") -> DataFrame:
    """(name, failures): rows of ``failures`` whose text holds a provider's name in any case, most first; names without failures have 0.

    Texts are searched by an automaton of all names, so time grows with the texts and not with texts times names. Names are taken in blocks of ``NAME_BYTES``,
    each of which is one pass. An empty name is in every text; a null name or text in none.
    """
    rows = failures.select(F.lower(F.col(error)).alias("_text")).where("_text is not null")
    lowered = names.select(F.lower("name").alias("_name")).where("_name <> ''").distinct()
    parts = [rows.agg(F.lit("").alias("name"), F.count(F.lit(1)).alias("rows"))]
    block, size = [], 0
    for (name,) in lowered.toLocalIterator():
        block.append(name)
        size += len(name.encode())
        if size >= NAME_BYTES:
            parts.append(rows_with_names(rows, sorted(block), "_text"))
            block, size = [], 0
    if block:
        parts.append(rows_with_names(rows, sorted(block), "_text"))
    found = functools.reduce(DataFrame.unionByName, parts).groupBy(F.col("name").alias("_name")).agg(F.sum("rows").alias("failures"))
    own = names.select("name", F.lower("name").alias("_name"))
    return own.join(found, "_name", "left").select("name", F.coalesce("failures", F.lit(0)).cast("long").alias("failures")).orderBy(F.desc("failures"), "name")


@dataclass
class Provider:
    """One endpoint of a provider list."""

    name: str
    base_url: str
    api_key: str
    model: str
    qpm: float = 6
    capacity_max: float = 180
    headers: dict = field(default_factory=dict)
    extra_headers: dict = field(default_factory=dict)


_INVISIBLE = str.maketrans({"﻿": None, "​": None, " ": " "})


def parse_provider(line: str) -> Provider:
    """One provider from a JSON object or ``name|base_url|api_key|model|key=value...``."""
    line = line.translate(_INVISIBLE).strip()
    if line.startswith("{"):
        return _provider(json.loads(line))
    head = [p.strip() for p in line.split("|")]
    if len(head) < 4:
        raise ValueError(f"a provider needs name, URL, key and model: {line[:40]!r}")
    pairs = dict(p.split("=", 1) for p in head[4:] if "=" in p)
    return _provider(dict(zip(("name", "base_url", "api_key", "model"), head, strict=False)) | {k.strip(): v.strip() for k, v in pairs.items()})


def _provider(found: dict) -> Provider:
    if missing := [k for k in ("name", "base_url", "api_key", "model") if not found.get(k)]:
        raise ValueError(f"a provider lacks {', '.join(missing)}")
    known = {k: found[k] for k in Provider.__dataclass_fields__ if k in found}
    for k in ("qpm", "capacity_max"):
        if k in known:
            known[k] = float(known[k])
    return Provider(**known)


def load_providers(path: str | os.PathLike) -> tuple[list[Provider], list[str]]:
    """Providers and the messages of entries that could not be read; fails only if none could.

    The file is a JSON array, or lines of :func:`parse_provider`'s forms with ``#`` comments.
    """
    text = Path(path).read_text(encoding="utf-8").translate(_INVISIBLE)
    entries: list = [x for x in (line.strip() for line in text.splitlines()) if x and not x.startswith("#")]
    if text.lstrip().startswith("["):
        try:
            entries = json.loads(text)
        except ValueError:
            pass
    found, errors = [], []
    for i, entry in enumerate(entries):
        try:
            found.append(_provider(entry) if isinstance(entry, dict) else parse_provider(entry))
        except (ValueError, TypeError) as e:
            errors.append(f"entry {i + 1}: {e}")
    if not found:
        raise ValueError("no provider could be read: " + "; ".join(errors))
    return found, errors


def providers_frame(spark: SparkSession, providers: list[Provider]) -> DataFrame:
    kind = T.StructType.fromDDL("name string, base_url string, model string, qpm double, capacity_max double")
    return spark.createDataFrame([(p.name, p.base_url, p.model, float(p.qpm), float(p.capacity_max)) for p in providers], kind)


def numbered(records: DataFrame, order: str = "place", name: str = "row_idx") -> DataFrame:
    """``records`` with their rank from 0 in ``order``, by counts of range partitions instead of one sort in one task.

    Rows are range-partitioned by the order, stored with their partition's number, and ranked there; a partition's first
    rank is the number of rows before it.
    """
    dealt = records.repartitionByRange(F.col(order)).withColumn("_part", F.spark_partition_id())
    own = stored(dealt).withColumn("_own", F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1)
    sizes = own.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    # One row for each partition of the exchange.
    return own.join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + F.col("_own")).cast("long")).drop("_part", "_own", "_before")


def normalised(records: DataFrame) -> DataFrame:
    """``records`` with one column for each field: texts as :func:`as_text`, ``age`` with its kind, subject lists, stage texts."""
    text = {k: J.as_text(J.field_by_alias("record", k)).alias(k) for k in ("姓名", "性别", "年级", "代理名", "学术水平", "价值观", "社交关系", "创造力", "心理健康")}
    age = J.field_by_alias("record", "年龄")
    persona = J.field_by_alias("record", "人格")
    stage = J.field_by_alias("record", "发展阶段")
    good, weak = J.field_by_alias("record", "擅长科目"), J.field_by_alias("record", "薄弱科目")
    ident = J.field_by_alias("record", "id")
    return records.select(
        "*", *text.values(), J.kind_of(age).alias("age_kind"),
        F.when(J.kind_of(age).isin("integer", "boolean"), F.coalesce(F.try_variant_get(age, "$", "long"), F.try_variant_get(age, "$", "boolean").cast("long"))).alias("年龄"),
        F.coalesce(F.array_join(J.strings(persona), " "), J.as_text(persona)).alias("人格"),
        J.strings(good).alias("擅长科目"), J.strings(weak).alias("薄弱科目"),
        *(F.when(J.kind_of(stage) == "object", J.as_text(J.field(stage, k))).alias(k) for k in S.STAGE_FIELDS),
        F.when(J.kind_of(ident) == "integer", F.try_variant_get(ident, "$", "long")).alias("id"),
        F.array(*(F.struct(F.lit(k).alias("k"), J.non_empty(J.field_by_alias("record", k)).alias("v")) for k in S.REQUIRED)).alias("present"),
        F.struct(*(J.kind_of(J.field_by_alias("record", k)).alias(k) for k in S.PARAGRAPHS)).alias("paragraph_kinds"),
        J.field(J.field("record", "_采样约束"), "目标学术水平", "string").alias("target"),
    )
