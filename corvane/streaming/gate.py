"""Streams of records: the similarity gate and the sink that writes every record once, both by keyed state."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from corvane.functions.text import hamming
from corvane.operators.dedup import block_keys, gate
from corvane.sources.files import Files
from corvane.streaming.state import keyed_state, write_batch

#: Groups that the state's keys are dealt to. It is part of a stream's state: a stream goes on with the number it began with.
SHARDS = 64


def near_known(batch: DataFrame, known: DataFrame, threshold: int) -> DataFrame:
    """(sid) of the batch's rows (sid, h) near a known hash (h), found by equal keys of two blocks."""
    keyed = lambda df: df.select("*", F.explode(block_keys(F.col("h"), threshold)).alias("_k"))
    a, b = keyed(batch.select("sid", "h")).alias("a"), keyed(known.select("h").distinct()).alias("b")
    on = (F.col("a._k") == F.col("b._k")) & (hamming(F.col("a.h"), F.col("b.h")) <= threshold)
    return a.join(b, on, "left_semi").select("sid").distinct()


class GateProcessor(StatefulProcessor):
    """Accepted hashes under each of their keys, and written ids, of one shard. Notices of what was accepted come in first; then rows (``notice``
    false) that meet one come out as (sid, h). A call reads the keys of its own rows alone."""

    def __init__(self, threshold: int, sid: str):
        self.threshold, self.names = threshold, [sid, "h"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("accepted", "key string", "hashes array<long>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        some = pd.concat(list(rows))
        held: dict[str, set[int]] = {}

        def at(k: str) -> set[int]:
            if k not in held:
                value = self.known.getValue((k,))
                held[k] = set(value[0]) if value is not None else set()
            return held[k]

        told = some[some["notice"]]
        for k, h in zip(told["key"].tolist(), told["h"].tolist(), strict=True):
            at(k).add(int(h))
        for k in set(told["key"].tolist()):
            self.known.updateValue((k,), (sorted(held[k]),))
        asked = some[~some["notice"]]
        met = []
        for k, h, by_id in zip(asked["key"].tolist(), asked["h"].tolist(), asked["by_id"].tolist(), strict=True):
            others = at(k)
            met.append(bool(others) and (by_id or any((int(h) ^ o).bit_count() <= self.threshold for o in ((x if (x ^ int(h)) >= 0 else x & 0xFFFFFFFFFFFFFFFF) for x in others))))
        yield asked.loc[np.array(met, bool), ["sid", "hash"]].set_axis(self.names, axis=1) if met else pd.DataFrame({n: [] for n in self.names})

    def close(self) -> None:
        pass


def _met(rows: DataFrame, notices: DataFrame, threshold: int) -> DataFrame:
    """(sid, h) of stream rows that meet what the notices have told so far."""

    def keyed(df: DataFrame, notice: bool) -> DataFrame:
        by_hash = F.transform(F.coalesce(block_keys(F.col("h"), threshold), F.array()), lambda k: F.struct(k.cast("string").alias("key"), F.lit(False).alias("by_id")))
        by_id = F.array(F.struct(F.concat(F.lit("id "), F.coalesce(F.col("sid").cast("string"), F.lit("null"))).alias("key"), F.lit(True).alias("by_id")))
        out = df.select("sid", F.col("h").alias("hash"), F.explode(F.concat(F.when(F.col("h").isNull(), F.array().cast("array<struct<key:string,by_id:boolean>>")).otherwise(by_hash), by_id)).alias("x"))
        return out.select(F.pmod(F.xxhash64("x.key"), F.lit(SHARDS)).alias("shard"), F.lit(notice).alias("notice"), "x.by_id", "x.key", "sid", "hash", F.coalesce("hash", F.lit(0)).alias("h"))

    shards = keyed(rows, False).unionByName(keyed(notices, True)).groupBy("shard")
    kind = T.StructType([rows.schema["sid"], T.StructField("h", T.LongType())])
    return shards.transformWithStateInPandas(GateProcessor(threshold, "sid"), kind, "Append", "None")


def gated_writer(stream: DataFrame, table_path: str, checkpoint: str, threshold: int = 3) -> DataStreamWriter:
    """Writes (sid, h, ...) rows that are new by sid and near nothing written before or earlier in their batch (in the order of sids).

    What a batch accepts is also written as notices to ``<table_path>_notices``, which the same stream reads: the next batch puts them into the state, where
    its own rows are looked up by their keys. A batch's work so depends on its own rows and on what the one before accepted. A trigger that fixes
    its input when it starts, such as ``availableNow``, gets its notices with the next start; until then batches are compared with what this run has
    written. Rows of one sid count as the one of the smallest hash, a null hash is near nothing. Batches are written by :func:`write_batch`.
    """
    spark = stream.sparkSession
    keyed_state(spark)
    files, told = Files(spark, f"{table_path}_notices"), f"{table_path}_notices/rows"
    files.make("rows")
    files.make("upto")
    kind = T.StructType([stream.schema["sid"], T.StructField("h", T.LongType()), T.StructField("told_in", T.LongType())])
    notices = spark.readStream.schema(kind).option("recursiveFileLookup", "true").parquet(told)
    none = lambda t: F.lit(None).cast(t)
    payload = F.struct(*(F.col(f"`{c}`") for c in stream.columns))
    parts = [
        stream.select(F.lit("row").alias("kind"), "sid", "h", none("long").alias("told_in"), payload.alias("row")),
        _met(stream.select("sid", "h"), notices, threshold).select(F.lit("met").alias("kind"), "sid", "h", none("long").alias("told_in"), none(stream.schema).alias("row")),
        notices.select(F.lit("told").alias("kind"), none(stream.schema["sid"].dataType).alias("sid"), none("long").alias("h"), "told_in", none(stream.schema).alias("row")),
    ]

    def write(batch: DataFrame, batch_id: int) -> None:
        own = batch.sparkSession
        batch.persist()
        try:
            latest = batch.where("kind = 'told'").agg(F.max("told_in")).first()[0]
            upto = max([int(n) for n in files.names("upto")] + ([latest] if latest is not None else []), default=-1)
            if latest is not None:
                files.make(f"upto/{upto}")
            rows = batch.where("kind = 'row'")
            if rows.isEmpty():
                return
            first = Window.partitionBy("sid").orderBy("h")
            fresh = rows.select("row.*").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
            met = batch.where("kind = 'met'").select(F.col("sid").alias("_sid"), F.col("h").alias("_h"))
            fresh = fresh.join(met, F.col("sid").eqNullSafe(F.col("_sid")) & F.col("h").eqNullSafe(F.col("_h")), "left_anti")
            # What the state hasn't been told of yet.
            since = [b for b in range(upto + 1, batch_id) if files.exists(f"rows/{b}")]
            if since:
                known = own.read.schema(kind).parquet(*(f"{told}/{b}" for b in since))
                fresh = fresh.join(known.select("sid"), "sid", "left_anti")
                fresh = fresh.join(near_known(fresh, known, threshold), "sid", "left_anti")
            accepted = gate(fresh, threshold, "sid", "h").where("accepted").select(F.col("sid").alias("_sid"))
            write_batch(fresh.join(accepted, F.col("sid").eqNullSafe(F.col("_sid")), "left_semi"), table_path, batch_id)
            told_now = own.read.parquet(f"{table_path}/batch={batch_id}").select("sid", "h", F.lit(batch_id).cast("long").alias("told_in"))
            told_now.write.mode("overwrite").parquet(f"{told}/{batch_id}")
        finally:
            batch.unpersist()

    return parts[0].unionByName(parts[1]).unionByName(parts[2]).writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint)


def once_writer(stream: DataFrame, table_path: str, checkpoint: str, sid: str = "sid", time: str = "ts", delay: str = "10 minutes") -> DataStreamWriter:
    """Writes each sid once: its first row within ``delay`` of event time. Sids are kept in the state store until the watermark has passed them by ``delay``; rows behind the watermark of the
    batch before are dropped, which happens before sids are forgotten, so none is written again. Batches are written by :func:`write_batch` and replace themselves
    when they are run again, so nothing compares with what was written before."""
    keyed_state(stream.sparkSession)
    on_time = stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([sid])
    return on_time.writeStream.foreachBatch(lambda batch, n: write_batch(batch, table_path, n)).outputMode("append").option("checkpointLocation", checkpoint)
