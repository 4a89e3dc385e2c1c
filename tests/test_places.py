import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.operators import metrics, places, rollouts, sampling
from tracemill.sources import readers


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    return [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, 0.0, 1.5, -2.0, rng.random() * 100]), i, rng.choice([0, 1, None])) for i in range(2000)]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "g string, v double, i long, ok int").repartition(7)


@pytest.fixture(params=[10**6, 40, 1])
def cells(request, monkeypatch):
    """Rows in one cell, in some tens of cells, and in as many as there may be."""
    monkeypatch.setattr(places, "ROWS", request.param)
    return request.param


@pytest.mark.parametrize("by", [[], ["g"]])
def test_running(df, rows, by, cells):
    got = {r.i: (r.n, r.s, r.n_all) for r in places.running(df, by, ["i"], {"n": F.lit(1), "s": F.col("ok")}).collect()}
    seen = {}
    for g, _, i, ok in rows:
        key = g if by else 0
        n, s = seen.get(key, (0, 0))
        seen[key] = n + 1, s + (ok or 0)
        assert got[i][:2] == seen[key]
    assert all(got[i][2] == seen[g if by else 0][0] for g, _, i, _ in rows)


def test_columns_keep_their_values_whatever_their_names(spark, cells):
    names = ["cell", "group 0", "amount n", "n_before", "n_all_", "sums", "cell_at", "o0", "r", "at"]
    df = spark.createDataFrame([(i, i % 3, *(f"{c} {i}" for c in names)) for i in range(200)], f"i long, g int, {', '.join(f'`{c}` string' for c in names)}")
    got = places.running(df, ["g"], ["i"], {"n": F.lit(1)})
    assert got.columns == [*df.columns, "n", "n_all"]
    assert all(r["n"] == r.i // 3 + 1 and all(r[c] == f"{c} {r.i}" for c in names) for r in got.collect())


@pytest.mark.parametrize("order", [["v", "i"], ["s", "i"], ["ts", "i"], ["g", "i"], ["f", "i"]])
def test_cells_are_even_and_in_order(spark, order):
    """Heaped values, outliers, one value of most rows, nulls and NaN: cells of like numbers of rows that never fall along the order."""
    rng = random.Random(1)
    value = lambda i: rng.choice([None, 1e12, -1e12, *[7.0] * 12, *[rng.random() * 1e-6] * 6])
    df = spark.createDataFrame([(i, value(i), rng.choice(["a", "b", *["same"] * 9, None])) for i in range(8000)], "i long, v double, s string").select(
        "*", F.timestamp_seconds(F.col("i") % 5).alias("ts"), F.lit(1).alias("g"), F.when(F.col("i") % 3 == 0, float("nan")).otherwise(F.col("v")).alias("f"))
    ends = places.splitters(df, order, 200)
    assert 30 <= len(ends) <= 40
    kinds = [df.schema[c].dataType for c in order]
    rows = df.withColumn("cell", places.cell_of(order, kinds, ends)).orderBy(*order).collect()
    seen = [r.cell for r in rows]
    counts = [seen.count(c) for c in set(seen)]
    assert seen == sorted(seen) and len(counts) >= len(ends) and max(counts) <= 260
    assert places.splitters(df.limit(0), order) == [] and places.splitters(df, order) == []


def test_a_large_table_is_sampled(spark, monkeypatch):
    monkeypatch.setattr(places, "SAMPLE", 500)
    ends = places.splitters(spark.range(100_000).repartition(5), ["id"], 1000)
    assert 80 <= len(ends) <= 125 and ends == sorted(ends)
    steps = np.diff([0, *(e[0] for e in ends), 100_000])
    assert steps.max() < 4000


def test_percentiles(df, rows, cells):
    for r in metrics.percentile_by(df, "v", 0.95, ["g"], "p").collect():
        assert abs(r.p - np.percentile([v for g, v, *_ in rows if g == r.g and v is not None], 95)) < 1e-9
    for r in metrics.upper_median_by(df, "v", ["g"]).collect():
        own = sorted(v for g, v, *_ in rows if g == r.g and v is not None)
        assert (r.low, r.median, r.high) == (own[0], own[len(own) // 2], own[-1])
    assert metrics.percentile_by(df.limit(0), "v", 0.5).collect() == [] and metrics.percentile_by(df.limit(0), "v", 0.5, ["g"]).collect() == []


def test_numbers_and_batches(df, rows, cells):
    got = {r.i: (r.number, r.label) for r in sampling.numbered(df, ["i"], prefix="r").collect()}
    assert got == {i: (i, f"r{i:06}") for *_, i, _ in rows}
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0.0, r[2]))
    assert {r.i: r.batch for r in sampling.batches(df, "v", "i", 16).collect()} == {r[2]: k // 16 for k, r in enumerate(order)}
    assert sampling.numbered(df.limit(0), ["i"]).columns == [*df.columns, "number", "label"] and sampling.batches(df.limit(0), "v", "i", 16).count() == 0
    strings = {r.i: r.number for r in sampling.numbered(df.select("i", F.sha2(F.col("i").cast("string"), 256).alias("k")), ["k"]).collect()}
    assert sorted(strings.values()) == list(range(2000))


def test_errors_on_empty_input_and_odd_groups(df):
    with pytest.raises(Exception, match="no rows to average"):
        metrics.rates(df.limit(0), ["ok"], required=True).collect()
    assert metrics.rates(df, ["ok"], required=True).first().n == 2000
    with pytest.raises(Exception, match="a group of"):
        rollouts.contrast(df.withColumn("s", F.col("ok") == 1), ["g"], "s", "v", members=8).collect()
    with pytest.raises(Exception, match="a group of"):
        rollouts.contrast(df.limit(3).withColumn("s", F.col("ok") == 1), [], "s", "v", members=2).collect()


def test_first_rows_with_fill(spark):
    rows = [(i, "ab"[i % 2] if i % 5 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "pos int, s string")

    def want(quota, total):
        chosen = [r for k, n in quota.items() for r in [x for x in rows if x[1] == k][:n]]
        return sorted((sorted(chosen) + [r for r in rows if r not in chosen])[:total])

    for quota, total in (({"a": 2, "b": 3}, 12), ({"a": 3, "c": 2}, 4), ({}, 3), ({"b": 9}, 5), ({"a": 1}, 100), ({"a": 1}, 0)):
        assert sorted(map(tuple, sampling.top_with_fill(df, "s", "pos", quota, total).collect())) == want(quota, total), (quota, total)
    assert sampling.top_with_fill(df.limit(0), "s", "pos", {"a": 2}, 3).count() == 0


def test_rows_are_dealt_only_where_pieces_are_few(spark):
    slots = spark.sparkContext.defaultParallelism
    few, many = spark.range(0, 100, 1, 1), spark.range(0, 100, 1, slots + 3)
    assert readers.dealt(few).rdd.getNumPartitions() == slots and readers.dealt(many) is many
    assert sorted(r.id for r in readers.dealt(few).collect()) == list(range(100))
