"""Places and running sums in the order of a group's rows, spread over tasks however many rows a group has.

Rows are put into cells along their order. The sums of the cells, few, give what lies before each; a window within
a cell gives the rest. So no task holds more than a cell of a group.

Cells end at splitters, quantiles of a random sample of the rows by all columns of the order. Each cell holds about as
many rows as any other, whatever the values are: heaped values get more cells, and rows of one value are split by the
columns that follow in the order.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import ceil, isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .names import free

#: Rows of a cell, cells at most, and rows of the sample.
ROWS, MOST, SAMPLE = 1_000_000, 1024, 16_384


def splitters(df: DataFrame, order: Sequence[str | Column], rows: int | None = None) -> list[tuple]:
    """What the cells but the last end at, in order: one less than the cells that hold about `rows` rows (ROWS unless given) of df each.

    One pass over the columns of the order. The sample is the SAMPLE rows of smallest random numbers, the largest of
    which tells how many rows there are. Few rows make one cell, which has no splitters.
    """
    names = [f"o{i}" for i in range(len(order))]
    keys = df.select(*((F.col(c) if isinstance(c, str) else c).alias(n) for c, n in zip(order, names, strict=True)), F.rand(1).alias("r"))
    sample = keys.orderBy("r").limit(SAMPLE).orderBy(*names).collect()
    number = len(sample) if len(sample) < SAMPLE else SAMPLE / max(max(s["r"] for s in sample), 1e-300)
    cells = min(MOST, ceil(number / (rows or ROWS)), len(sample))
    return [tuple(sample[k * len(sample) // cells])[:-1] for k in range(1, cells)]


def cell_of(order: Sequence[str | Column], types: Sequence, ends: list[tuple]) -> Column:
    """The number of splitters that are not above a row's order, found among every so many of them first."""
    key = F.struct(*((F.col(c) if isinstance(c, str) else c).alias(f"o{i}") for i, c in enumerate(order)))
    lit = lambda row: F.struct(*(F.lit(v).cast(t).alias(f"o{i}") for i, (v, t) in enumerate(zip(row, types, strict=True))))
    step = isqrt(len(ends)) + 1
    groups = [ends[k : k + step] for k in range(0, len(ends), step)]
    passed = lambda x: F.size(F.filter(x, lambda s: s <= key))
    coarse = passed(F.array(*(lit(g[-1]) for g in groups)))  # groups whose last splitter is passed are passed whole
    fine = passed(F.get(F.array(*(F.array(*map(lit, g)) for g in groups)), coarse))
    return coarse * step + F.when(coarse < len(groups), fine).otherwise(0)


def running(
    df: DataFrame, by: Sequence[str], order: Sequence[str | Column], amounts: dict[str, Column], cell: Column | None = None, only: Column | None = None, sample_of: DataFrame | None = None,
) -> DataFrame:
    """df with, for each amount, its sum up to and with the row (name) and over the group (name_all).

    Groups that are null are groups; without by, all rows are one. An amount that is null adds nothing. Orders with
    ties give any of the tied rows first, so order should end in a key, which also splits rows of equal values. cell:
    cells that are known without a sample, as those of a hash; they mustn't fall along order. sample_of: a table with
    the columns of the order that is cheaper to sample. With only, a condition on a cell's name_before, name_sum and
    name_all, rows of cells that it rules out may be left out unsorted. Columns of df keep their values, whatever their names.
    """
    own = {n: free(df, f"amount {n}") for n in amounts}
    groups, at = [free(df, f"group {i}") for i in range(len(by))], free(df, "cell")
    rows = df.select("*", *(F.coalesce(a, F.lit(0)).alias(own[n]) for n, a in amounts.items()))
    if cell is None:
        keys = (df if sample_of is None else sample_of).select(*((F.col(c) if isinstance(c, str) else c).alias(f"o{i}") for i, c in enumerate(order)))
        ends = splitters(keys, keys.columns)
        cell = cell_of(order, [f.dataType for f in keys.schema], ends) if ends else None
    if cell is None:
        whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
        upto = whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return rows.select(*df.columns, *(F.sum(own[n]).over(upto).alias(n) for n in amounts), *(F.sum(own[n]).over(whole).alias(f"{n}_all") for n in amounts))
    rows = rows.withColumn(at, cell)
    cells = rows.groupBy(*(F.col(b).alias(g) for b, g in zip(by, groups, strict=True)), F.col(at).alias("at")).agg(*(F.sum(own[n]).alias(f"{n}_sum") for n in amounts))
    group = Window.partitionBy(*groups) if by else Window.partitionBy(F.lit(0))
    before = group.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(
        *groups, "at", *(f"{n}_sum" for n in amounts), *(F.coalesce(F.sum(f"{n}_sum").over(before), F.lit(0)).alias(f"{n}_before") for n in amounts),
        *(F.sum(f"{n}_sum").over(group).alias(f"{n}_all") for n in amounts))
    if only is not None:
        cells = cells.where(only)
    # Names of df's own are told apart from those of the cells by a struct around the latter.
    held = free(df, "sums")
    cells = cells.select(*groups, F.col("at").alias(f"{at}_at"), F.struct(*(c for n in amounts for c in (f"{n}_before", f"{n}_all"))).alias(held))
    same = reduce(lambda a, b: a & b, (F.col(b).eqNullSafe(F.col(g)) for b, g in zip(by, groups, strict=True)), F.col(at).eqNullSafe(F.col(f"{at}_at")))
    within = Window.partitionBy(*by, at).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = [(F.col(held)[f"{n}_before"] + F.sum(own[n]).over(within)).alias(n) for n in amounts]
    return rows.join(cells, same).select(*df.columns, *sums, *(F.col(held)[f"{n}_all"].alias(f"{n}_all") for n in amounts))


def at_ranks(df: DataFrame, value: str, by: Sequence[str], ranks: dict[str, Column]) -> DataFrame:
    """By group, the values at ranks (from 0, of __n_all rows in order of value), a column for each, and __n_all. Nulls don't count.

    A group without values is absent. From counts by value, so a value that many rows have costs no more than others;
    only the cells that hold a rank are sorted.
    """
    known = df.where(F.col(value).isNotNull())
    counts = known.groupBy(*by, value).agg(F.count("*").alias("__c"))
    within = lambda r: (F.col("__n_before") <= r) & (F.col("__n_before") + F.col("__n_sum") > r)
    some = reduce(lambda a, b: a | b, map(within, ranks.values()))
    places = running(counts, by, [value], {"__n": F.col("__c")}, only=some, sample_of=known)
    held = lambda r: (F.col("__n") > r) & (F.col("__n") - F.col("__c") <= r)
    found = places.groupBy(*by).agg(F.max("__n_all").alias("__n_all"), *(F.max(F.when(held(r), F.col(value))).alias(n) for n, r in ranks.items()))
    return found.where("__n_all is not null")
