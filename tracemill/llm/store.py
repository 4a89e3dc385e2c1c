"""Shared folders for intermediate tables, and connected components over a table of edges."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What the rows that come to the driver at once may have together: 8 MB of whole numbers.
SLICE = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share.

    It lies in the folder that the cluster names in spark.checkpoint.dir. Only on a local master, where that may be
    unset as in tests, a temporary folder takes its place; on a cluster an unset folder is an error, since executors
    would write to disks of their own. The folder goes when the driver ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tracemill-")
        spark.sparkContext.setCheckpointDir(base)
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


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """df as a table in folder: computed once, its lineage cut, safe from the loss of executors."""
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def slices(df: DataFrame, place: str, size: Column, most: int, each: int = SLICE) -> Iterator[pa.Table]:
    """A written table's rows, the first in the order of place (a long that tells rows apart) whose sizes come to `most` together, in that order.

    They come to the driver in slices of sizes of about `each` together, one at a time. The sizes of all rows come first, so their number must be bounded.
    """
    sizes = df.select(place, size.cast("long").alias("size")).toArrow().sort_by(place)
    places, ends = sizes.column(place).to_numpy(), np.cumsum(sizes.column("size").to_numpy())
    if not len(ends):
        yield df.limit(0).toArrow()
        return
    last = places[max(0, int(np.searchsorted(ends, most, "right")) - 1)]
    # The last place of each slice; rows of one place stay together.
    tops = np.unique(places[np.flatnonzero(np.diff(ends // each, append=ends[-1] // each + 1))])
    before = None
    for top in [*(int(x) for x in tops if x < last), int(last)]:
        within = F.col(place) <= top
        rows = df.where(within if before is None else within & (F.col(place) > before)).toArrow()
        yield rows.take(pa.array(np.argsort(rows.column(place).to_numpy(), kind="stable")))
        before = top


def bounded(df: DataFrame, place: str, size: Column, most: int) -> tuple[pa.Table, list[int]]:
    """The rows of slices() as one table, and their order."""
    rows = pa.concat_tables(slices(df, place, size, most))
    return rows, list(range(rows.num_rows))


def freed(spark: SparkSession, folder: str, *names: str) -> None:
    """Deletes tables of a folder that nothing reads any more."""
    for name in names:
        delete(spark, f"{folder}/{name}")


def components(edges: DataFrame, folder: str, name: str = "components") -> DataFrame:
    """Connected components of an undirected graph by repeated contraction.

    edges: columns a, b (long), read twice. Returns (id, component_id), one row per vertex of an edge, where
    component_id is the smallest id of its component, as a table called `name`. Loops and repeated edges change
    nothing; no edges give no rows; an edge with a null end is left out.

    In each round every vertex moves to that vertex among itself and its neighbours which has most neighbours and,
    of several, comes first in an order drawn anew by hashing: stars shrink at once, paths by a constant factor.
    Only the contracted edges go on to the next round, each round a written table; the moves are composed at the end.
    """
    spark = edges.sparkSession
    edges = edges.where("a is not null and b is not null")
    pair = F.struct(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    live = written(edges.select(pair.alias("e")).select("e.*").where("a <> b").distinct(), folder, f"{name}-edges0")
    moves, step = [], 0
    while live.count():
        step += 1
        both = live.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("to")), F.struct(F.col("b").alias("x"), F.col("a").alias("to")))).alias("e")).select("e.*")
        rank = lambda v: F.struct("d", F.xxhash64(F.lit(step), v).alias("o"), F.col(v).alias("v"))  # noqa: B023, E731
        degree = both.groupBy("x").agg(F.count("*").alias("d"))
        best = both.join(degree.withColumnRenamed("x", "to"), "to").groupBy("x").agg(F.max(rank("to")).alias("m"))
        moved = best.join(degree, "x").select("x", F.greatest("m", rank("x"))["v"].alias("y"))
        moves.append(written(moved, folder, f"{name}-moves{step}"))
        nxt = live.join(moves[-1].toDF("a", "ya"), "a").join(moves[-1].toDF("b", "yb"), "b").where("ya <> yb")
        live = written(nxt.select(F.least("ya", "yb").alias("a"), F.greatest("ya", "yb").alias("b")).distinct(), folder, f"{name}-edges{step}")
        freed(spark, folder, f"{name}-edges{step - 1}")
    alone = edges.where("a = b").select(F.col("a").alias("id"), F.col("a").alias("at")).distinct()
    if not moves:
        placed = alone
    else:
        placed = moves[-1].toDF("id", "at")
        for moved in reversed(moves[:-1]):
            placed = moved.toDF("id", "y").join(placed.toDF("y", "z"), "y", "left").select("id", F.coalesce("z", "y").alias("at"))
        placed = placed.unionByName(alone.join(placed.select("id"), "id", "left_anti"))
    first = placed.groupBy("at").agg(F.min("id").alias("component_id"))
    out = written(placed.join(first, "at").select("id", "component_id"), folder, name)
    freed(spark, folder, f"{name}-edges{step}", *(f"{name}-moves{k}" for k in range(1, step + 1)))
    return out
