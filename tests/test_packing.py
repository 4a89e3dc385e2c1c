"""Packing against the plain algorithm row by row."""

import random
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tracemill.operators import packing, places


def bins_row_by_row(lengths, capacity):
    """Number of bins of best fit decreasing."""
    spaces, bins = [], 0
    for n in sorted((x for x in lengths if 0 < x <= capacity), reverse=True):
        k = bisect_left(spaces, n)
        space = spaces.pop(k) if k < len(spaces) else capacity
        bins += space == capacity
        if space > n:
            insort(spaces, space - n)
    return bins + sum(x > capacity for x in lengths) + any(x <= 0 for x in lengths)


def laid(plan):
    bins = defaultdict(list)
    for length, first, last, at, each in plan:
        for k in range(last - first):
            bins[at + k // each].append(length)
    return bins


@pytest.mark.parametrize("seed", range(40))
def test_plan(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 7, 30, 100])
    lengths = [rng.choice([0, 1, rng.randint(1, capacity), rng.randint(1, max(1, capacity // 3)), capacity + 3]) for _ in range(rng.choice([0, 1, 5, 300]))]
    bins = laid(packing.plan(Counter(lengths), capacity))
    assert sorted(x for b in bins.values() for x in b) == sorted(lengths)
    assert all(sum(b) <= capacity or len(b) == 1 for b in bins.values()) and sorted(bins) == list(range(len(bins)))
    best = bins_row_by_row(lengths, capacity)
    assert len(bins) <= best + max(2, best // 50)
    inner = [sum(b) for b in bins.values() if 0 < sum(b) <= capacity]
    assert not inner or len(inner) <= 11 * -(-sum(inner) // capacity) / 9 * 1.7 + 1


def test_plan_of_many_rows_is_short():
    plan = packing.plan({n: 10**9 + n for n in range(1, 513)}, 1024)
    assert len(plan) < 5000 and sum(last - first for _, first, last, *_ in plan) == sum(10**9 + n for n in range(1, 513))


@pytest.mark.parametrize("rows_of_a_cell", [10**6, 25])
def test_packed(spark, monkeypatch, rows_of_a_cell):
    monkeypatch.setattr(places, "ROWS", rows_of_a_cell)
    rng = random.Random(1)
    rows = [(i, rng.choice([None, 0, 3, 3, 3, 10, rng.randint(1, 50), 80]), "x") for i in range(400)]
    df = spark.createDataFrame(rows, "id long, n int, bin_length string").repartition(5)
    got = packing.packed(df, "n", "id", 64).collect()
    assert sorted((r.id, r.n, r.bin_length) for r in got) == sorted(rows)
    bins = defaultdict(list)
    for r in got:
        bins[r.bin].append(r.n or 0)
    assert all(sum(b) <= 64 or len(b) == 1 for b in bins.values()) and sorted(bins) == list(range(len(bins)))
    assert len(bins) <= bins_row_by_row([n or 0 for _, n, _ in rows], 64) + 2
    assert packing.packed(df.limit(0), "n", "id", 64).count() == 0
    assert packing.packed(df, "n", "id", 64).groupBy("bin").agg(F.sum("n").alias("s")).agg(F.max("s")).first()[0] == 80
