"""Queries that run as streams over the driver's tables until all input is read."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import rollouts
from ..streaming import run, turns
from .registry import query, table

C = F.col


@query("""SELECT date_trunc('hour', ts) AS start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS "end", count(*) AS samples, max(value) AS used_max, min(value) AS free_min,
  round(avg(value), 6) AS utilization_mean, max(value) AS power_max FROM events GROUP BY ALL""")
def stream_telemetry(spark, d):
    """T4: windows of event time over a stream of device samples."""
    rows = run.source(spark, f"{d}/events.parquet").select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp_utc"), C("value").alias("memory_used_mib"), C("value").alias("memory_free_mib"),
        C("value").alias("gpu_utilization_percent"), C("value").alias("power_draw_watts"))
    return run.drained(turns.telemetry_windows(rows, window="1 hour"), "complete").withColumn("utilization_mean", F.round("utilization_mean", 6))


def _said(rows):
    """Each text of conversations as a turn: by its length it ends with an answer, an unclosed call or a call, or ran out of tokens."""
    text, n = F.coalesce("text", F.lit("")), F.length(F.coalesce("text", F.lit("")))
    call = F.concat(F.lit(' <tool_call>{"name": "calculator", "arguments": {"op": "+", "a": '), n.cast("string"), F.lit(', "b": '), C("turn").cast("string"), F.lit("}}</tool_call>"))
    tail = F.when(n % 5 == 0, F.concat(F.lit(" The answer is "), n.cast("string"), F.lit("."))).when(n % 5 == 1, " <tool_call>").otherwise(call)
    return rows.select(C("conv_id").cast("string").alias("id"), "turn", F.concat(text, tail).alias("text"), (n % 7 == 0).alias("exhausted"))


_TOLD = """WITH t AS (SELECT conv_id, coalesce(length(text), 0) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations),
e AS (SELECT *, CASE WHEN n % 5 > 1 THEN CASE WHEN i >= {budget} THEN 'max_tool_calls_exceeded' END WHEN n % 7 = 0 THEN 'thinking_budget_exhausted' WHEN n % 5 = 1 THEN 'unclosed_tool_call' ELSE '' END AS ended FROM t),
f AS (SELECT conv_id, min(i) FILTER (WHERE ended IS NOT NULL) AS i, count(*) AS turns FROM e GROUP BY 1)"""


@query(f"""{_TOLD.format(budget=2)} SELECT conv_id::VARCHAR AS id, i::BIGINT AS n_calls, CASE WHEN ended = '' THEN n END::DOUBLE AS answer, nullif(ended, '') AS error, (i + 1)::BIGINT AS turns_used
FROM f JOIN e USING (conv_id, i)""")
def stream_turns(spark, d):
    """The agent loop as a stream over the texts of conversations, its state a table of columns that ends with the id."""
    folder = run.scratch(spark)
    turns.play(_said(run.source(spark, f"{d}/conversations.parquet")), 2, folder).awaitTermination()
    return turns.played(spark, folder)


@query(f"""{_TOLD.format(budget=3)}, x AS (SELECT f.*, e.ended, e.n FROM f LEFT JOIN e USING (conv_id, i))
SELECT conv_id::VARCHAR AS id, coalesce(i, least(turns, 4))::BIGINT AS n_calls, CASE WHEN ended = '' THEN n END::DOUBLE AS answer, CASE WHEN i IS NULL THEN 'agent_loop_exhausted' ELSE nullif(ended, '') END AS error,
  coalesce(i + 1, least(turns, 4))::BIGINT AS turns_used FROM x""")
def turn_rounds(spark, d):
    """Rounds over the conversations that are still active, batched anew by length each time, each answered from its recorded turns."""
    told = table(spark, d, "conversations")
    order = Window.partitionBy("conv_id").orderBy("turn")
    recorded = _said(told).join(told.select(C("conv_id").cast("string").alias("id"), "turn", (F.row_number().over(order) - 1).alias("place")), ["id", "turn"])
    prompts = told.groupBy(C("conv_id").cast("string").alias("id")).agg(F.coalesce(F.min_by(F.length("text"), "turn"), F.lit(0)).alias("length"))
    respond = lambda active, number: active.join(recorded.where(C("place") == number), "id").select("id", "text", "exhausted")
    return rollouts.rounds(prompts, respond, 3, 16, run.scratch(spark)).drop("length")
