"""Work that rows with equal inputs share."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming import run
from .names import free


def once(df: DataFrame, inputs: Sequence[str], work: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """df with the columns that work adds to its inputs, worked out once for all rows whose inputs are equal.

    work gets the distinct inputs and returns them with the columns that depend on nothing else, in any number of rows for
    each: a row of df comes as often as work returned its inputs. The inputs are plain values (no arrays or maps), nulls are
    values too, and -0.0 is 0.0. What work returns is a written table in folder, which must be shared; a small one is
    broadcast by its size, a large one is joined by a shuffle. No name that work adds may be one of df's.
    """
    spark = df.sparkSession
    slots = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    told = run.written(work(df.select(*inputs).distinct().repartition(slots)), folder)
    keys = {c: free(df, f"same {c}") for c in inputs}
    added = [c for c in told.columns if c not in keys]
    if taken := sorted({c.lower() for c in added} & {c.lower() for c in df.columns}):
        raise ValueError(f"columns that are there already: {taken}")
    told = told.select(*(F.col(c).alias(k) for c, k in keys.items()), *added)
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(k)) for c, k in keys.items()))
    return df.join(told, same).select(*df.columns, *added)
