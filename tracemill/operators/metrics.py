"""Rates, histograms, percentiles and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import places


def rate(metric: Column, digits: int = 4) -> Column:
    """Mean of a boolean or 0/1 column, rounded; null without rows."""
    return F.round(F.avg(metric.cast("double")), digits)


def rates(df: DataFrame, metrics: Sequence[str], by: Sequence[str] = (), required: bool = False) -> DataFrame:
    """Count and rounded mean of each metric by group. required: an input without rows is an error where there is no by."""
    n = F.count("*")
    if required and not by:
        n = F.when(n == 0, F.raise_error(F.lit("no rows to average")).cast("bigint")).otherwise(n)
    return df.groupBy(*by).agg(n.alias("n"), *(rate(F.col(m)).alias(m) for m in metrics))


def rates_overall_and_by(df: DataFrame, metrics: Sequence[str], by: str) -> DataFrame:
    """Rates by group and, with a null group and is_total 1, overall, in one pass. Groups without rows are absent."""
    return df.groupingSets([[by], []], by).agg(
        F.grouping(by).cast("int").alias("is_total"), F.count("*").alias("n"), *(rate(F.col(m)).alias(m) for m in metrics)
    )


def bucket(error: Column, name: str = "none") -> Column:
    """The error, or a name where it is null or empty."""
    return F.coalesce(F.nullif(error, F.lit("")), F.lit(name))


def histogram(df: DataFrame, value: Column, name: str = "bucket", pos: str | None = None) -> DataFrame:
    """Rows by value, few, with the rank by count, ties by value or, with pos, by first appearance in its order."""
    first = F.min(pos) if pos else F.first(F.lit(0))
    counted = df.groupBy(value.alias(name)).agg(F.count("*").alias("n"), first.alias("__first"))
    return counted.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "__first", name))).drop("__first")


def counts_over(df: DataFrame, column: str, domain: Sequence, by: Sequence[str] = ()) -> DataFrame:
    """How often each value of a fixed domain occurs, zeros kept, a column for each."""
    return df.groupBy(*by).agg(*(F.count_if(F.col(column) == v).alias(f"n_{v}") for v in domain))


def nearest_rank_by(df: DataFrame, value: str, fraction: float, by: Sequence[str] = (), name: str = "value") -> DataFrame:
    """The value at the rank nearest to the fraction, ranks that lie half-way going to the even one, for groups of any size.

    From counts by value and their running sum, not from a list of all rows.
    """
    last = F.col("__n_all") - 1
    return places.at_ranks(df, value, by, {name: F.least(last, F.bround(last * F.lit(fraction)).cast("long"))}).select(*by, name)


def percentile_by(df: DataFrame, value: str, fraction: float, by: Sequence[str] = (), name: str = "value") -> DataFrame:
    """The percentile interpolated between the two nearest ranks, for groups of any size; groups without values are absent."""
    at = (F.col("__n_all") - 1) * F.lit(fraction)
    both = places.at_ranks(df, value, by, {"__low": F.floor(at), "__high": F.ceil(at)})
    low, high = F.col("__low").cast("double"), F.col("__high").cast("double")
    return both.select(*by, (low + (high - low) * (at - F.floor(at))).alias(name))


def upper_median_by(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Least, middle (the upper of two) and greatest value of a group."""
    n = F.col("__n_all")
    return places.at_ranks(df, value, by, {"low": F.lit(0), "median": F.floor(n / 2), "high": n - 1}).drop("__n_all")


def token_usage(df: DataFrame, counts: str, by: Sequence[str] = ()) -> DataFrame:
    """Total tokens, mean by row and mean by turn over the flattened lists of counts."""
    summed = F.aggregate(F.coalesce(counts, F.array().cast("array<bigint>")), F.lit(0).cast("long"), lambda s, x: s + x)
    turns = F.greatest(F.size(counts), F.lit(0))
    return df.groupBy(*by).agg(
        F.sum(summed).alias("total_tokens"), F.round(F.avg(summed), 3).alias("mean_per_row"),
        F.round(F.sum(summed) / F.nullif(F.sum(turns), F.lit(0)), 3).alias("mean_per_turn"),
    )


def telemetry_summary(df: DataFrame, used: str, free: str, total: str, utilization: str, power: str) -> DataFrame:
    """One row over all samples of a device."""
    p95 = percentile_by(df, utilization, 0.95, name="p95")
    rest = df.agg(
        F.count("*").alias("samples"), F.max(total).alias("total_max"), F.max(used).alias("used_max"), F.min(free).alias("free_min"),
        F.round(F.avg(utilization), 4).alias("utilization_mean"), F.max(utilization).alias("utilization_max"), F.round(F.avg(power), 4).alias("power_mean"),
        F.max(power).alias("power_max"),
    )
    return rest.join(p95, F.lit(True), "left").select(
        "samples", "total_max", "used_max", "free_min", "utilization_mean", F.round("p95", 4).alias("utilization_p95"), "utilization_max", "power_mean", "power_max")


def mean_of_rounded_means(df: DataFrame, metrics: Sequence[str], outer: Sequence[str], inner: Sequence[str]) -> DataFrame:
    """Mean over the inner groups (seeds) of their rounded means; rows aren't pooled."""
    first = df.groupBy(*outer, *inner).agg(*(rate(F.col(m)).alias(m) for m in metrics))
    return first.groupBy(*outer).agg(F.count("*").alias("n_groups"), *(F.round(F.avg(m), 4).alias(m) for m in metrics))


def log_summary(df: DataFrame, entries: str, pos: str) -> DataFrame:
    """Least, greatest and last value of each name over a log of maps; names a row lacks don't count."""
    each = df.select(pos, F.explode(entries).alias("name", "value"))
    return each.groupBy("name").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.max_by("value", pos).alias("last"))


def non_finite(df: DataFrame, entries: str, pos: str) -> DataFrame:
    """The log values that are NaN or infinite."""
    return df.select(pos, F.explode(entries).alias("name", "value")).where(F.isnan("value") | (F.abs("value") == float("inf")))


def running_rate(df: DataFrame, metric: str, pos: str, every: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """The mean of all rows so far after each `every` rows, and after the last."""
    value = F.col(metric).cast("double")
    sums = {"seen": F.lit(1).cast("long"), "__sum": value, "__of": F.when(value.isNotNull(), 1).cast("long")}
    rows = places.running(df.select(*by, pos, metric), by, [pos], sums)
    rate = F.round(F.col("__sum") / F.nullif(F.col("__of"), F.lit(0)), 4).alias("rate")
    return rows.where((F.col("seen") % every == 0) | (F.col("seen") == F.col("seen_all"))).select(*by, "seen", rate)


def throughput(amount: Column, time: Column, digits: int = 1) -> Column:
    """Sum of amounts by sum of time; 0 where the time isn't above 0."""
    return F.when(F.sum(time) > 0, F.round(F.sum(amount) / F.sum(time), digits)).otherwise(0.0)


def floored_max(value: Column, floor: int) -> Column:
    """The greatest value, the floor at least, also without rows."""
    return F.greatest(F.lit(floor), F.max(value))


def composition(df: DataFrame, rows: str, columns: str, domain: Sequence[str]) -> DataFrame:
    """Counts by row and column value, zeros kept."""
    return df.groupBy(rows).pivot(columns, list(domain)).count().na.fill(0)
