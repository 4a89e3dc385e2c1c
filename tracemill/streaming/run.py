"""Streams over everything that is there, ended when it is read."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder under the cluster's spark.checkpoint.dir; only on a local master, where that is unset, a temporary one. It goes when the driver ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tracemill-")
    path = f"{base.rstrip('/')}/tracemill-{uuid.uuid4().hex}"
    atexit.register(_delete_at_end, spark, path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a table or folder, if it is there."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _delete_at_end(spark: SparkSession, path: str) -> None:
    try:
        delete(spark, path)
    except Exception:  # the session has ended already
        pass


def written(df: DataFrame, path: str) -> DataFrame:
    """df as a table at path, computed once and read back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def source(spark: SparkSession, path: str, files: int = 4) -> DataFrame:
    """A table as a stream of its files, some at a time; path is a folder or a single file."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", target.getName()).parquet(target.getParent().toString())


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """The rows of a stream after all input there is: those appended, or those of its last complete result.

    Each batch of an append has a folder named by its number, so a batch that is tried again replaces itself.
    """
    spark, folder = stream.sparkSession, scratch(stream.sparkSession)

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/__batch={number if mode == 'append' else 0}")

    query = stream.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows").select(*stream.columns)
