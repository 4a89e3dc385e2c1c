"""Quotas and deterministic stratified, nested and ordered draws.

A shuffle is the order of SHA-256 over seed and id, the same on any number of partitions.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import places
from .names import free


def shuffle_key(id_: Column, seed: str | int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), id_.cast("string")), 256)


def quotas(sizes: DataFrame, name: str, size: str, target: int | float, fraction: bool = False, tie_by_size: bool = True) -> DataFrame:
    """Largest-remainder shares of a target: name, size, quota.

    sizes: one row for each name, few. target: rows, or with fraction a share of the total that is rounded half
    to even. Every name has the floor of its exact share; what is left goes one each to the largest remainders,
    ties to the larger size (unless tie_by_size is False) and then to the later name. A total of 0 gives 0 each.
    """
    all_ = Window.partitionBy(F.lit(0))
    total = F.sum(size).over(all_)
    goal = F.bround(total * F.lit(float(target))) if fraction else F.lit(int(target))
    # Exact in whole numbers: floor and remainder of size * target by total.
    product = F.col(size).cast("decimal(38,0)") * F.col("goal").cast("decimal(38,0)").cast("bigint")
    base = sizes.select(name, size, total.alias("total"), goal.cast("bigint").alias("goal"))
    checked = base.withColumn("goal", F.when((F.col("goal") < 0) | (F.col("goal") > F.col("total")), F.raise_error(F.lit("target outside 0..total")).cast("bigint")).otherwise(F.col("goal")))
    down = checked.withColumn("floor", F.when(F.col("total") > 0, F.floor((product / F.col("total")))).otherwise(0).cast("bigint")).withColumn(
        "left", (product - F.col("floor").cast("decimal(38,0)") * F.col("total").cast("decimal(20,0)"))
    )
    order = [F.desc("left"), *([F.desc(size)] if tie_by_size else []), F.desc(name)]
    spare = F.col("goal") - F.sum("floor").over(all_)
    return down.select(name, size, (F.col("floor") + F.when(F.row_number().over(all_.orderBy(*order)) <= spare, 1).otherwise(0)).cast("bigint").alias("quota"))


def sizes_of(df: DataFrame, stratum: str) -> DataFrame:
    return df.groupBy(stratum).agg(F.count("*").alias("size"))


def ranked(df: DataFrame, stratum: str, id_: str, seed: str | int, name: str = "draw", size: str | None = None) -> DataFrame:
    """df with the 1-based place of each row in its stratum's shuffle, ties by id, and with size the stratum's number of rows."""
    key = free(df, "shuffle")
    rows = df.withColumn(key, shuffle_key(F.col(id_), seed))
    # The first three hex digits of a hash are its cell.
    one = {name: F.lit(1).cast("long")}
    placed = places.running(rows, [stratum], [key, id_], one, cell=F.substring(key, 1, 3)).drop(key)
    return placed.withColumnRenamed(f"{name}_all", size) if size else placed.drop(f"{name}_all")


def stratified(df: DataFrame, stratum: str, id_: str, target: int | float, seed: str | int, fraction: bool = False, tie_by_size: bool = True) -> DataFrame:
    """A sample of the target size without replacement with largest-remainder shares of the strata."""
    share = quotas(sizes_of(df, stratum), stratum, "size", target, fraction, tie_by_size).select(stratum, "quota")
    return ranked(df, stratum, id_, seed).join(share, stratum).where("draw <= quota").select(*df.columns)


def split(df: DataFrame, stratum: str, id_: str, train: float, evaluation: float, seed: str | int) -> DataFrame:
    """df with split in train, eval, test: train shares of the sizes, eval shares of what remains, test the rest."""
    sizes = sizes_of(df, stratum)
    first = quotas(sizes, stratum, "size", train, fraction=True)
    total = sizes.agg(F.sum("size").alias("n"))
    rest = first.select(stratum, (F.col("size") - F.col("quota")).alias("size"), F.col("quota").alias("n_train"))
    goal = total.select(F.bround(F.col("n") * F.lit(float(evaluation))).cast("bigint").alias("n")).first()["n"] or 0
    second = quotas(rest.select(stratum, "size"), stratum, "size", goal).select(stratum, F.col("quota").alias("n_eval"))
    share = rest.select(stratum, "n_train").join(second, stratum)
    place = ranked(df, stratum, id_, seed).join(share, stratum)
    name = F.when(F.col("draw") <= F.col("n_train"), "train").when(F.col("draw") <= F.col("n_train") + F.col("n_eval"), "eval").otherwise("test")
    return place.select(*df.columns, name.alias("split"))


def nested(df: DataFrame, stratum: str, id_: str, targets: Sequence[int], seed: str | int) -> DataFrame:
    """Rows of the largest sample with arm, the smallest target whose sample holds them.

    One shuffle is cut at growing quotas, so each sample holds the smaller ones. That needs quotas that never
    fall from one target to the next in any stratum, which is an error here if they do.
    """
    targets = sorted(targets)
    sizes, share = sizes_of(df, stratum), None
    for t in targets:
        one = quotas(sizes, stratum, "size", t).select(stratum, F.col("quota").alias(f"q{t}"))
        share = one if share is None else share.join(one, stratum)
    falls = F.lit(False)
    for a, b in zip(targets, targets[1:]):
        falls = falls | (F.col(f"q{a}") > F.col(f"q{b}"))
    share = share.withColumn("__bad", F.when(falls, F.raise_error(F.lit("quotas fall")).cast("int")))
    arm = F.coalesce(F.col("__bad"), *(F.when(F.col("draw") <= F.col(f"q{t}"), t) for t in targets))
    return ranked(df, stratum, id_, seed).join(share, stratum).withColumn("arm", arm).where("arm is not null").select(*df.columns, "arm")


def disjoint(df: DataFrame, stratum: str, id_: str, draws: Sequence[tuple[str, int, str | None]], seed: str | int) -> DataFrame:
    """id and domain of draws one after another, each (domain, size, stratum it must come from or None) from what is left."""
    left, out = df.select(id_, stratum), None
    for domain, size, only in draws:
        pool = left.where(F.col(stratum) == only) if only else left
        got = stratified(pool, stratum, id_, size, f"{seed}:{domain}").select(id_, F.lit(domain).alias("domain"))
        out = got if out is None else out.unionByName(got)
        left = left.join(got.select(id_), id_, "left_anti")
    return out


def top_with_fill(df: DataFrame, stratum: str, pos: str, wanted: dict[str, int], total: int) -> DataFrame:
    """The first rows of each named stratum in order of pos, filled up to a total with the first unused rows. pos is unique.

    A top-k of each named stratum and one of the whole, each of at most `total` rows, so no stratum is sorted as one.
    """
    first = df.orderBy(pos).limit(total)
    if not wanted:
        return first
    chosen = reduce(DataFrame.unionByName, (df.where(F.col(stratum) == k).orderBy(pos).limit(n) for k, n in wanted.items()))
    late = free(df, "late")
    fill = first.join(chosen.select(pos), pos, "left_anti").withColumn(late, F.lit(1))
    return chosen.withColumn(late, F.lit(0)).unionByName(fill).orderBy(late, pos).limit(total).select(*df.columns)


def simple_sample(df: DataFrame, id_: str, size: int, seed: str | int) -> DataFrame:
    """A seeded simple random sample."""
    return df.orderBy(shuffle_key(F.col(id_), seed), id_).limit(size)


def batches(df: DataFrame, length: str, pos: str, size: int, by: Sequence[str] = ()) -> DataFrame:
    """df with batch: rows of like lengths together, `size` at a time, in order of length and then pos."""
    place = free(df, "place")
    rows = places.running(df, by, [length, pos], {place: F.lit(1).cast("long")})
    return rows.select(*df.columns, F.floor((F.col(place) - 1) / size).cast("long").alias("batch"))


def numbered(df: DataFrame, order: Sequence[str], by: Sequence[str] = (), width: int = 6, prefix: str = "") -> DataFrame:
    """df with number (from 0 in the order given) and label, zero-padded."""
    place = free(df, "place")
    rows = places.running(df, by, order, {place: F.lit(1).cast("long")})
    label = F.concat(F.lit(prefix), F.lpad(F.col("number").cast("string"), width, "0"))
    return rows.select(*df.columns, (F.col(place) - 1).alias("number")).withColumn("label", label)


def last_wins(df: DataFrame, key: Sequence[str], pos: str) -> DataFrame:
    """The last row of each key by pos."""
    names = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*names), F.col(pos)).alias("__r")).select(*key, *(F.col(f"__r.{c}").alias(c) for c in names))


def first_wins(df: DataFrame, key: Sequence[str], pos: str) -> DataFrame:
    """The first row of each key by pos."""
    names = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*names), F.col(pos)).alias("__r")).select(*key, *(F.col(f"__r.{c}").alias(c) for c in names))
