"""The agent loop as a stream and in rounds, against a plain loop over the turns of each id."""

import random

import pytest
from pyspark.sql import functions as F

from tracemill.functions import parsing
from tracemill.operators import rollouts
from tracemill.streaming import turns

SCHEMA = "id string, turn int, text string, exhausted boolean"
CALL = '<tool_call>{"name": "calculator", "arguments": {"op": "+", "a": 1, "b": 2}}</tool_call>'
TEXTS = [(CALL, False), (CALL, True), (CALL, False), ("hm", True), ("hm", False), ("The answer is 4", False), ("<tool_call>{", False)]


def loop(told, budget):
    """n_calls, answer, error, turns_used, done of one id."""
    calls = 0
    for k, (text, exhausted) in enumerate(told):
        if exhausted and "</tool_call>" not in text:
            return calls, None, "thinking_budget_exhausted", k + 1, True
        if text == "<tool_call>{":
            return calls, None, "unclosed_tool_call", k + 1, True
        if text != CALL:
            return (calls, 4.0, None, k + 1, True) if "answer" in text else (calls, None, "missing_final_answer", k + 1, True)
        if calls >= budget:
            return calls, None, "max_tool_calls_exceeded", k + 1, True
        calls += 1
    return calls, None, "agent_loop_exhausted", len(told), False


def ids(seed, n=40):
    rng = random.Random(seed)
    return {f"i{k}": [rng.choice(TEXTS) for _ in range(rng.randint(1, 7))] for k in range(n)}


@pytest.mark.parametrize("per_batch", [1, 2, 9])
def test_stream(spark, tmp_path, per_batch):
    """Turns that come in any number of batches, a batch that is run again, and a restart with more input."""
    told, source, folder = ids(per_batch), str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(i, k, *t) for i, said in told.items() for k, t in enumerate(said)]
    put = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: turns.play(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source), 2, folder, after=9).awaitTermination()
    for k in range(0, 8, per_batch):
        if some := [r for r in rows if k <= r[1] < k + per_batch]:
            put(some)
            if k % 2 == 0:
                stream()
    stream()
    stream()
    want = {i: loop(said, 2) for i, said in told.items()}
    got = [tuple(r) for r in turns.played(spark, folder).collect()]
    assert sorted(got) == sorted((i, *w[:4]) for i, w in want.items() if w[4])


def test_state_ends_with_the_id(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    stream = lambda: turns.play(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source), 6, folder, after=1, idle=2).awaitTermination()
    for k, rows in enumerate([[("a", 0, "The answer is 4", False), ("b", 0, CALL, False), ("c", 0, CALL, False)], [("c", 1, CALL, False)], [("d", 0, CALL, False)], [("d", 1, CALL, False)], [("c", 2, "The answer is 4", False)]]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream()
        held = {r.id for r in spark.read.schema(turns.STATE).parquet(f"{folder}/state/__batch={k}").collect()}
        assert held == [{"a", "b", "c"}, {"a", "b", "c"}, {"b", "c", "d"}, {"c", "d"}, {"c", "d"}][k]
    assert sorted((r.id, r.n_calls, r.answer) for r in turns.played(spark, folder).collect()) == [("a", 0, 4.0), ("c", 0, 4.0)]  # c was idle for too long and began anew


def test_rounds(spark, tmp_path):
    told = ids(7) | {"none": []}
    rows = [(i, k, *t) for i, said in told.items() for k, t in enumerate(said)]
    recorded = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("turn", "place")
    prompts = spark.createDataFrame([(i, k % 5) for k, i in enumerate(told)], "id string, length int")
    sizes = []

    def respond(active, number):
        counted = active.groupBy("batch").agg(F.count("*").alias("n"), F.min("length").alias("low"), F.max("length").alias("high")).orderBy("batch").collect()
        sizes.append(sum(r.n for r in counted))
        assert all(r.n == 4 for r in counted[:-1]) and all(a.high <= b.low for a, b in zip(counted, counted[1:]))
        return active.join(recorded.where(F.col("place") == number), "id")

    got = {r.id: (r.n_calls, r.answer, r.error, r.turns_used) for r in rollouts.rounds(prompts, respond, 2, 4, str(tmp_path)).collect()}
    assert got == {i: loop(said[:3], 2)[:4] for i, said in told.items()}
    assert sizes[0] == len(told) and sizes == sorted(sizes, reverse=True) and len(sizes) <= 3
    assert rollouts.rounds(prompts.limit(0), respond, 2, 4, str(tmp_path / "none")).count() == 0


def test_play_takes_a_budget_by_row(spark):
    df = spark.createDataFrame([(b, [(CALL, False)] * 3) for b in range(4)], "b int, t array<struct<text: string, exhausted: boolean>>")
    got = df.select("b", parsing.play(F.col("t"), F.col("b"))["error"].alias("e")).collect()
    assert {r.b: r.e for r in got} == {0: "max_tool_calls_exceeded", 1: "max_tool_calls_exceeded", 2: "max_tool_calls_exceeded", 3: "agent_loop_exhausted"}
