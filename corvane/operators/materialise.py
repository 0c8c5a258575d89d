"""Materialising in the shared folder that the session names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Only a local session without that setting, as in tests on one machine, gets
    one of its own; on a cluster, whose machines don't see each other's folders, that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="corvane-"))
    return context._jsc.sc().getCheckpointDir().get()


def new_folder(spark: SparkSession) -> str:
    """A path of its own in the shared folder, which :func:`clear` deletes."""
    path = f"{shared_folder(spark)}/corvane-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def stored(df: DataFrame, file_rows: int = 0) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, which cuts its lineage and prunes columns; ``file_rows`` bounds the rows of a file."""
    spark = df.sparkSession
    path = new_folder(spark)
    (df.write.option("maxRecordsPerFile", file_rows) if file_rows else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Delete all that :func:`stored` has written in this process, and the other folders of :func:`new_folder`, once results that depend on it are written; gives the number of tables."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    n = len(_written)
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)
    return n
