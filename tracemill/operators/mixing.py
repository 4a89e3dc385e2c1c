"""Joins that replace, filter and compare rows, and checks over sets of ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import free


def lookup(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """df with its rows of a table of unique keys; a key that the table lacks is an error."""
    found = free(df.join(table, key), "found")
    joined = df.join(table.withColumn(found, F.lit(True)), key, "left")
    checked = F.when(F.col(found).isNull(), F.raise_error(F.concat(F.lit("no row for "), F.col(key).cast("string"))).cast("boolean")).otherwise(True)
    return joined.withColumn(found, checked).where(F.col(found)).drop(found)


def replace_rows(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """base with whole rows replaced by those of new with the same key; a null of a replacement replaces too."""
    names = [c for c in base.columns if c != key]
    row = free(base, "new row")
    held = new.select(key, F.struct(*names).alias(row))
    joined = base.join(held, key, "left")
    pick = lambda c: F.when(F.col(row).isNotNull(), F.col(row)[c]).otherwise(F.col(c)).alias(c)
    return joined.select(key, *(pick(c) for c in names))


def merge_right_wins(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """All rows of right, and those of left whose key right lacks."""
    return left.join(right.select(key), key, "left_anti").unionByName(right)


def only(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def without(df: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return df.join(seen.select(key), key, "left_anti")


def union_all(*parts: DataFrame) -> DataFrame:
    """All rows; a column that a part lacks is null there."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side only, with side left or right, repeats counted; empty if both hold the same rows."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def partition_check(universe: DataFrame, parts: Sequence[DataFrame], key: str) -> DataFrame:
    """One row: ids in more than one part, ids of no part, and ids outside the universe."""
    tagged = universe.select(key, F.lit(-1).alias("part"))
    for i, p in enumerate(parts):
        tagged = tagged.unionByName(p.select(key, F.lit(i).alias("part")))
    by_id = tagged.groupBy(key).agg(F.count_if(F.col("part") == -1).alias("u"), F.count_if(F.col("part") >= 0).alias("p"))
    return by_id.agg(
        F.count_if(F.col("p") > 1).alias("overlapping"), F.count_if((F.col("u") > 0) & (F.col("p") == 0)).alias("missing"),
        F.count_if((F.col("u") == 0) & (F.col("p") > 0)).alias("foreign"),
    )


def subset_check(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: ids of a only, of b only and of both, and whether a is a strict subset of b."""
    tagged = a.select(key, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(key, F.lit(0).alias("a"), F.lit(1).alias("b")))
    by_id = tagged.groupBy(key).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return by_id.agg(
        F.count_if(F.col("b") == 0).alias("only_a"), F.count_if(F.col("a") == 0).alias("only_b"), F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("common")
    ).withColumn("strict_subset", (F.col("only_a") == 0) & (F.col("only_b") > 0))


def zip_strict(a: Column, b: Column) -> Column:
    """Pairs of two lists by position; lists of different lengths are an error."""
    return F.when(F.size(a) == F.size(b), F.transform(a, lambda x, i: F.struct(x.alias("a"), F.get(b, i).alias("b")))).otherwise(
        F.raise_error(F.lit("lists of different lengths"))
    )


def zip_short(a: Column, b: Column) -> Column:
    """Pairs of two lists by position up to the end of the shorter."""
    return F.transform(F.slice(a, F.lit(1), F.least(F.size(a), F.size(b))), lambda x, i: F.struct(x.alias("a"), F.get(b, i).alias("b")))


def arms(pool: DataFrame, base: DataFrame, key: str, percents: Sequence[int]) -> DataFrame:
    """Every arm of a mixture from one pool of replacements: pool has min_percent, the first arm it belongs to."""
    spark = base.sparkSession
    dimension = F.broadcast(spark.createDataFrame([(int(p),) for p in percents], "percent int"))
    names, row = [c for c in base.columns if c != key], free(base, "new row")
    chosen = pool.join(dimension, F.col("min_percent") <= F.col("percent")).select("percent", key, F.struct(*names).alias(row))
    every = base.crossJoin(dimension).join(chosen, ["percent", key], "left")
    pick = lambda c: F.when(F.col(row).isNotNull(), F.col(row)[c]).otherwise(F.col(c)).alias(c)
    return every.select("percent", key, *(pick(c) for c in names), F.col(row).isNotNull().alias("replaced"))
