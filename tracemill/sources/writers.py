"""Sinks: split directories, JSON lines, single documents, appended results, bundles and printed reports."""

from __future__ import annotations

import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def splits(df: DataFrame, path: str) -> None:
    """One directory by split; an existing path is an error."""
    df.write.mode("errorifexists").partitionBy("split").parquet(path)


def json_lines(df: DataFrame, path: str, single: bool = False) -> None:
    """JSON lines with null fields left out; single: in one file, for results that one task can hold."""
    (df.coalesce(1) if single else df).write.mode("errorifexists").json(path)


def document(df: DataFrame, path: str) -> None:
    """A small result as one JSON file. Written beside its place and moved there in one step, so readers see the old file or the new."""
    spark, beside = df.sparkSession, f"{path}.{uuid.uuid4().hex}"
    df.coalesce(1).write.json(beside)
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    files = fs.FileContext.getFileContext(fs.Path(beside).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    part = files.util().globStatus(fs.Path(f"{beside}/part-*"))[0].getPath()
    replacing = spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 1)
    replacing[0] = getattr(fs, "Options$Rename").OVERWRITE
    files.rename(part, fs.Path(path), replacing)
    files.delete(fs.Path(beside), True)


def append(df: DataFrame, path: str) -> None:
    """Finished rows added to those that are there."""
    df.write.mode("append").json(path)


def bundles(files: DataFrame, path: str, required: list[str], shards: int = 1) -> DataFrame:
    """ZIP archives of files (name, content) in the folder path, one by shard: archive, n_files.

    Files go to shards by a hash of their names and each into its archive as it comes, so a task holds one file at a
    time. A required name that is missing is an error, before anything is written. Archives are named by shard and task
    attempt; those of attempts that don't count are deleted when all are there. path must be shared and open to pyarrow.
    """
    from pyarrow import fs
    from pyspark import TaskContext

    names = files.select("name").where(F.col("name").isin(required)).distinct()
    if missing := sorted(set(required) - {r["name"] for r in names.collect()}):
        raise FileNotFoundError(f"not in the bundle: {missing}")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, count = TaskContext.get(), 0
        where, base = fs.FileSystem.from_uri(path)
        where.create_dir(base, recursive=True)
        name = f"bundle-{task.partitionId():05d}-{task.taskAttemptId()}.zip"
        with where.open_output_stream(f"{base}/{name}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for part in parts:
                for file, content in zip(part["name"], part["content"], strict=True):
                    z.writestr(zipfile.ZipInfo(file), content, zipfile.ZIP_DEFLATED)
                    count += 1
        yield pd.DataFrame([(name, count)], columns=["archive", "n_files"])

    dealt = files.select("name", F.col("content").cast("binary").alias("content")).repartition(shards, "name").sortWithinPartitions("name")
    made = files.sparkSession.createDataFrame(dealt.mapInPandas(run, "archive string, n_files long").collect(), "archive string, n_files long")  # one row a shard
    where, base = fs.FileSystem.from_uri(path)
    kept = {r["archive"] for r in made.collect()}
    for info in where.get_file_info(fs.FileSelector(base, allow_not_found=True)):
        if info.base_name.startswith("bundle-") and info.base_name not in kept:
            where.delete_file(info.path)
    return made


def report(df: DataFrame, rows: int = 50) -> None:
    """A small result printed as a table."""
    df.show(rows, truncate=False)
