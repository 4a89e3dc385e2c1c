"""Sources: split directories, id lists, JSON lines and documents, archives, device samples, HTTP completions."""

from __future__ import annotations

import zipfile
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.types import _parse_datatype_string as ddl

from .. import schemas


def dealt(df: DataFrame) -> DataFrame:
    """df dealt out to all slots if its scan has fewer pieces than the cluster has slots, for much work on each row.

    A scan with more pieces comes back as it is, without a shuffle. A file of one row group counts as the pieces
    that its bytes make, so select the columns first: they are what the shuffle moves.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df


def splits(spark: SparkSession, path: str, schema: str = schemas.RECORDS, expected: tuple[str, ...] | None = None) -> DataFrame:
    """All splits of a directory partitioned by split. With expected, other or missing names are an error."""
    df = spark.read.schema(schema).parquet(path)
    if expected is not None:
        found = {r["split"] for r in df.select("split").distinct().collect()}
        if found != set(expected):
            raise ValueError(f"splits {sorted(found)}, expected {sorted(expected)}")
    return df


def one_split(spark: SparkSession, path: str, name: str, schema: str = schemas.RECORDS) -> DataFrame:
    """One split; the filter prunes the other directories before the scan."""
    return splits(spark, path, schema).where(F.col("split") == name)


def sparse_json(value: Column) -> Column:
    """A struct as JSON text without its null fields; nulls in lists stay."""
    return F.to_json(value, {"ignoreNullFields": "true"})


def id_list(spark: SparkSession, path: str, unique: bool = True) -> DataFrame:
    """ids of a text file, trimmed, without blank lines; with unique, a repeated id is an error, else it is dropped."""
    ids = spark.read.text(path).select(F.trim("value").alias("id")).where("id <> ''")
    if not unique:
        return ids.distinct()
    counted = ids.groupBy("id").agg(F.count("*").alias("n"))
    bad = F.raise_error(F.concat(F.lit("repeated id "), F.col("id"))).cast("boolean")
    return counted.where(F.when(F.col("n") > 1, bad).otherwise(True)).select("id")


def _with_order(df: DataFrame) -> DataFrame:
    """Rows numbered as they stand: by file, by block of the file and by place in it."""
    return df.select("*", F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).alias("__at"))


def predictions(spark: SparkSession, path: str, schema: str = schemas.PREDICTIONS, key: str = "id") -> DataFrame:
    """JSON lines by id, blank lines skipped, the later of repeated ids."""
    rows = _with_order(spark.read.schema(schema).option("mode", "FAILFAST").json(path))
    names = [c for c in rows.columns if c not in (key, "__at")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*names), "__at").alias("r")).select(key, "r.*")


def checkpoint(spark: SparkSession, path: str, targets: DataFrame, schema: str = schemas.PREDICTIONS, key: str = "id") -> DataFrame:
    """JSON lines of an interrupted run: malformed lines ignored, only target ids kept, the later of repeated ids."""
    tolerant = f"{schema}, _corrupt string"
    rows = spark.read.schema(tolerant).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    rows = _with_order(rows).where("_corrupt is null").drop("_corrupt").join(targets.select(key), key, "left_semi")
    names = [c for c in rows.columns if c not in (key, "__at")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*names), "__at").alias("r")).select(key, "r.*")


def resumable(rows: DataFrame, signature: str, current: str) -> DataFrame:
    """rows if all carry the current signature, else none."""
    gate = rows.agg(F.coalesce(F.bool_and(F.col(signature).eqNullSafe(F.lit(current))), F.lit(False)).alias("__ok"))
    return rows.crossJoin(F.broadcast(gate)).where("__ok").drop("__ok")


def document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A single JSON document as one row."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def opened(path: str):
    """A file of any file system that pyarrow opens, for reads at any place."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = f"file://{path.removeprefix('file:')}"
    where, name = fs.FileSystem.from_uri(path)
    return where.open_input_file(name)


def zip_directory(spark: SparkSession, path: str, suffix: str = ".json") -> DataFrame:
    """archive, member, method, crc, offset, packed, size of the members of ZIP archives whose names end in suffix, from the archives' directories alone."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name in part["path"]:
                with opened(name) as file, zipfile.ZipFile(file) as z:
                    found = [(name, m.filename, m.compress_type, m.CRC, m.header_offset, m.compress_size, m.file_size) for m in z.infolist() if m.filename.endswith(suffix)]
                yield pd.DataFrame(found, columns=["archive", "member", "method", "crc", "offset", "packed", "size"])

    # Contents aren't selected, so the scan lists the files only.
    files = spark.read.format("binaryFile").load(path).select("path")
    return files.mapInPandas(run, "archive string, member string, method int, crc long, offset long, packed long, size long")


def zip_members(spark: SparkSession, path: str, suffix: str = ".json", wide: int | None = None) -> DataFrame:
    """archive, member, content of the members of the ZIP archives at a path.

    Members are read by their offsets, neighbours of an archive together, `wide` ranges of them (as many as shuffle
    partitions unless given) each in a task of its own, so a task holds one member at a time and never an archive. A
    member that is neither stored nor deflated, or whose checksum differs, is an error.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for archive, own in part.groupby("archive", sort=False):
                with opened(archive) as file:
                    for m in own.itertuples():
                        file.seek(m.offset)
                        head = file.read(30)
                        file.seek(m.offset + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little"))
                        data = file.read(m.packed)
                        if m.method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
                            raise ValueError(f"{archive}: {m.member} is packed by method {m.method}")
                        data = zlib.decompress(data, -15) if m.method == zipfile.ZIP_DEFLATED else data
                        if zlib.crc32(data) != m.crc:
                            raise ValueError(f"{archive}: {m.member} has another checksum")
                        yield pd.DataFrame([(archive, m.member, data.decode("utf-8"))], columns=["archive", "member", "content"])

    wide = wide or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = zip_directory(spark, path, suffix).repartitionByRange(wide, "archive", "offset").sortWithinPartitions("archive", "offset")
    return ranges.mapInPandas(run, "archive string, member string, content string")


def device_sample(line: Column, timestamp: Column) -> Column:
    """A telemetry struct from a device's `used, total, free, utilization, power` line; parts that are no numbers are null."""
    part = F.transform(F.split(line, ","), lambda x: F.trim(x).try_cast("double"))
    names = ("memory_used_mib", "memory_total_mib", "memory_free_mib", "gpu_utilization_percent", "power_draw_watts")
    return F.struct(timestamp.alias("timestamp_utc"), *(F.get(part, F.lit(i)).alias(n) for i, n in enumerate(names)))


def completions(prompts: DataFrame, complete: Callable[[str], str], column: str = "prompt", into: str = "completion") -> DataFrame:
    """prompts with what a completion service returns for each; a failed request gives null.

    complete runs on the executors and is called once for each row of a batch; an HTTP client goes here.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for text in part[column]:
                try:
                    out.append(complete(text))
                except OSError:
                    out.append(None)
            yield part.assign(**{into: out})

    return prompts.mapInPandas(run, StructType([*prompts.schema, StructField(into, StringType())]))


def schema_of(text: str) -> StructType:
    return ddl(text)
