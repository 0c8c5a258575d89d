"""What streams of several modules share: the state store and committed batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.sources.files import Files

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_state(spark: SparkSession) -> None:
    """Streams that begin after this keep their state in RocksDB, which keyed state needs; the setting stays with the session."""
    spark.conf.set(_PROVIDER, ROCKS)


def write_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    """Write a batch so that it counts as a whole or not at all: its directory first, then the mark that it is complete. A batch that is run again
    takes its mark away first and replaces the directory."""
    files = Files(rows.sparkSession, path)
    files.delete(f"_committed/{batch_id}")
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    files.make(f"_committed/{batch_id}")


def committed(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of complete batches with their number as ``batch``; None if there is no batch."""
    done = Files(spark, path).names("_committed")
    return spark.read.option("basePath", path).parquet(*(f"{path}/batch={b}" for b in done)) if done else None
