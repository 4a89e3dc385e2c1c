"""Comparisons of variants, arms and policies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def paired(df: DataFrame, id_: str, variant: str, passed: str, first: str, others: Sequence[str]) -> DataFrame:
    """A row for each id of the first variant with passed_<variant> for all, null where a variant lacks the id."""
    wide = df.groupBy(id_).agg(*(F.bool_or(F.when(F.col(variant) == v, F.col(passed))).alias(f"passed_{v}") for v in (first, *others)))
    return wide.where(F.col(f"passed_{first}").isNotNull())


def paired_counts(pairs: DataFrame, first: str, other: str) -> DataFrame:
    """One row: ids that pass in both, in one only and in neither."""
    a, b = F.col(f"passed_{first}"), F.coalesce(F.col(f"passed_{other}"), F.lit(False))
    return pairs.agg(F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("lost"), F.count_if(~a & b).alias("gained"), F.count_if(~a & ~b).alias("neither"))


def against_baseline(df: DataFrame, arm: str, baseline: str, metrics: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """df with <metric>_delta and <metric>_ratio to the baseline arm's row (of the same group); null without one."""
    base = df.where(F.col(arm) == baseline).select(*by, *(F.col(m).alias(f"__{m}") for m in metrics))
    joined = df.join(F.broadcast(base), list(by), "left") if by else df.crossJoin(F.broadcast(base))
    return joined.select(
        *df.columns, *(F.round(F.col(m) - F.col(f"__{m}"), 6).alias(f"{m}_delta") for m in metrics),
        *(F.round(F.col(m) / F.nullif(F.col(f"__{m}"), F.lit(0)), 6).alias(f"{m}_ratio") for m in metrics),
    )


def constrained_pick(df: DataFrame, cap: str, success: str, exhausted: str, slack: float, most: float) -> DataFrame:
    """The smallest cap whose success lies within slack of the best and whose exhaustion is below most."""
    near = df.withColumn("__best", F.max(success).over(Window.partitionBy(F.lit(0)))).where((F.col(success) >= F.col("__best") - slack) & (F.col(exhausted) < most))
    return near.agg(F.min(cap).alias(cap))


def dose_response(df: DataFrame, percent: str, metric: str, by: Sequence[str]) -> DataFrame:
    """df with the gain of each step of the dose and the gain for every 10 points of it."""
    own = Window.partitionBy(*by).orderBy(percent)
    gain = F.col(metric) - F.lag(metric).over(own)
    return df.withColumn("gain", F.round(gain, 6)).withColumn("gain_per_10", F.round(gain * 10 / (F.col(percent) - F.lag(percent).over(own)), 6))


def best_by(df: DataFrame, group: Sequence[str], name: str, metric: str) -> DataFrame:
    """The name with the highest metric of each group, the first of equals."""
    best = F.min(F.struct((-F.col(metric)).alias("m"), F.col(name).alias("name"))).alias("b")
    return df.groupBy(*group).agg(best).select(*group, F.col("b.name").alias("best"), (-F.col("b.m")).alias(metric))


def incomplete_runs(df: DataFrame, run: str, id_: str, expected: int) -> DataFrame:
    """Runs without exactly the expected number of rows and of different ids; must be empty."""
    counted = df.groupBy(run).agg(F.count("*").alias("n"), F.countDistinct(id_).alias("n_ids"))
    return counted.where((F.col("n") != expected) | (F.col("n_ids") != expected))


def failure_kind(success: Column, calls: Column, expected: Column) -> Column:
    """success, or whether a failure stopped early, went on too long or took a wrong order."""
    return F.when(success, "success").when(calls < expected, "premature_stop").when(calls > expected, "overcall").otherwise("wrong_order")


def changed(before: DataFrame, after: DataFrame, id_: str, value: str) -> DataFrame:
    """Ids whose value differs between two scorers, nulls told apart from values."""
    joined = before.select(id_, F.col(value).alias("before")).join(after.select(id_, F.col(value).alias("after")), id_)
    return joined.where(~F.col("before").eqNullSafe(F.col("after")))
