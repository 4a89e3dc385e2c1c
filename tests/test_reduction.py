"""Scores over the shared graph against the fold over each trajectory."""

import random

from pyspark.sql import functions as F

from tracemill.functions import trace
from tracemill.operators import reduction
from tracemill.streaming import run

SCHEMA = f"id long, expression string, calls array<{trace.CALL}>, stated double, expected int, answer double"


def trajectories(seed, n):
    """Random walks over expressions of up to nine operations, right, in another order, swapped, cut, doubled or with odd calls."""
    rng, out = random.Random(seed), []
    texts = []
    for _ in range(8):
        count = rng.randint(1, 9)
        values, ops = [rng.choice([2, 3, 3, 4]) for _ in range(count + 1)], [rng.choice("+-**") for _ in range(count)]
        texts.append((values, ops, "".join(str(values[0]) if i == 0 else (f"*{v}" if ops[i - 1] == "*" else f" {ops[i - 1]} {v}") for i, v in enumerate(values))))
    for i in range(n):
        values, ops, text = rng.choice(texts)
        v, o, calls = list(map(float, values)), list(ops), []
        while o:
            k = rng.choice([j for j, x in enumerate(o) if x == "*"] or [0])
            a, b = v[k], v[k + 1]
            calls.append((o[k], b, a) if o[k] != "-" and rng.random() < 0.3 else (o[k], a, b))
            v[k : k + 2], o[k : k + 1] = [a * b if o[k] == "*" else a + b if o[k] == "+" else a - b], []
        answer, spoil = v[0], rng.random()
        if spoil < 0.15:
            calls = calls[:-1]
        elif spoil < 0.3:
            calls.insert(rng.randrange(len(calls) + 1), rng.choice([("+", 2.0, 3.0), ("*", 3.0, 4.0), ("-", -9.0, 1.0), (None, 1.0, 2.0), ("+", None, 2.0)]))
        elif spoil < 0.4:
            calls.append(("+", answer, 0.0))
        elif spoil < 0.5:
            rng.shuffle(calls)
        out.append((i, text, calls if spoil < 0.97 else None, rng.choice([answer, answer, answer + 1, None]), len(ops), answer))
    return [*out, (n, "", [], 1.0, 0, 1.0), (n + 1, None, [("+", 1.0, 2.0)], 1.0, 1, 3.0), (n + 2, "5", [("+", 5.0, 1.0)], 5.0, 0, 5.0)]


def test_scores(spark, tmp_path):
    df = spark.createDataFrame(trajectories(2, 400), SCHEMA)
    folded = df.select("id", trace.score(F.col("expression"), F.col("calls"), F.col("stated"), F.col("expected"), F.col("answer")).alias("score"))
    want, got = ({r.id: r.score for r in x.collect()} for x in (folded, reduction.scored(df, "id", str(tmp_path))))
    assert got == want and len({s.first_illegal_reason for s in got.values()}) >= 5
    assert reduction.scored(df.limit(0), "id", str(tmp_path / "none")).count() == 0


def test_one_graph_for_many(spark, tmp_path):
    """Copies of the trajectories add no edges."""
    df = spark.createDataFrame(trajectories(3, 60), SCHEMA)
    many = df.select((F.col("id") * 50).alias("id"), *df.columns[1:]).select("id", F.explode(F.sequence(F.lit(0), F.lit(49))).alias("k"), *df.columns[1:]).withColumn("id", F.col("id") + F.col("k")).drop("k")
    edges = []
    for name, rows in (("one", df), ("many", many)):
        assert reduction.scored(rows, "id", f"{tmp_path}/{name}").count() == rows.count()
        edges.append([run.written(spark.read.parquet(f"{tmp_path}/{name}/edges-{k}"), f"{tmp_path}/again").count() for k in range(3)])
    assert edges[0] == edges[1] and sum(edges[0]) > 0
