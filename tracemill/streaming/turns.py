"""Structured Streaming over turns, predictions and telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import parsing, trace
from . import run

#: What is known of an id between turns: calls and turns so far, how it ended, and the batch of its last turn.
STATE = "id string, n_calls long, turns_used long, answer double, error string, done boolean, at long, new boolean"
RESULT = ["id", "n_calls", "answer", "error", "turns_used"]


def advanced(state: DataFrame, turns: DataFrame, budget: int, number: int = 0, dialect: str = "standard") -> DataFrame:
    """The state of every id after more turns (id, turn, text, exhausted): STATE, where new marks ids that these turns ended.

    Turns of one id are played in their order, as a fold over columns. Turns after the end of an id change nothing.
    """
    turn = F.struct("turn", "text", "exhausted")
    told = turns.groupBy(F.col("id").cast("string").alias("id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    both = state.drop("new").join(told, "id", "full_outer")
    open_ = F.col("turns").isNotNull() & ~F.coalesce("done", F.lit(False))
    before = F.coalesce("n_calls", F.lit(0))
    played = parsing.play(F.when(open_, F.col("turns")), (F.lit(budget) - before).cast("int"), dialect)
    rows = both.withColumn("played", played)
    p, ended = F.col("played"), F.col("played").isNotNull() & F.coalesce(F.col("played")["done"], F.lit(False))
    return rows.select(
        "id", (before + F.coalesce(F.size(p["calls"]), F.lit(0))).cast("long").alias("n_calls"), (F.coalesce("turns_used", F.lit(0)) + F.coalesce(p["turns_used"], F.lit(0))).cast("long").alias("turns_used"),
        F.when(ended, p["answer"]).otherwise(F.col("answer")).alias("answer"), F.when(ended, p["error"]).otherwise(F.col("error")).alias("error"),
        (ended | F.coalesce("done", F.lit(False))).alias("done"), F.when(F.col("turns").isNotNull(), number).otherwise(F.col("at")).cast("long").alias("at"), ended.alias("new"),
    )


def play(turns: DataFrame, budget: int, folder: str, after: int = 1, idle: int | None = None, dialect: str = "standard") -> StreamingQuery:
    """The agent loop as a stream, started: each batch's ended ids are rows of folder/rows, the state is a table of folder/state.

    turns: id, turn, text, exhausted; turns of one id come in order of batches. folder must be shared. The state of an
    id that ended goes when no turn came for it in `after` batches, that of one that didn't end after `idle` batches
    (None: never); a turn that comes later begins anew. A batch that is tried again reads the state before it and
    replaces what it wrote, so each end is told once; a query started again on the folder goes on where it stopped.
    """
    spark = turns.sparkSession
    place = lambda kind, number: f"{folder}/{kind}/__batch={number}"

    def save(batch: DataFrame, number: int) -> None:
        before = spark.createDataFrame([], STATE)
        if number:
            known = spark.read.schema(STATE).parquet(place("state", number - 1))
            gone = F.when(F.col("done"), F.col("at") < number - after).otherwise(F.lit(False) if idle is None else F.col("at") < number - idle)
            before = known.where(~gone)
        advanced(before, batch, budget, number, dialect).write.mode("overwrite").parquet(place("state", number))
        spark.read.schema(STATE).parquet(place("state", number)).where("new").select(*RESULT).write.mode("overwrite").parquet(place("rows", number))
        run.delete(spark, place("state", number - 2))

    return turns.writeStream.foreachBatch(save).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def played(spark: SparkSession, folder: str) -> DataFrame:
    """The ids that have ended so far."""
    return spark.read.schema(STATE).parquet(f"{folder}/rows").select(*RESULT)


def scored(predictions: DataFrame) -> DataFrame:
    """A stream of predictions with their score, stateless."""
    p = F.col
    return predictions.withColumn("score", trace.score(p("expression"), p("model_calls"), p("predicted_answer"), F.size("expected_calls"), p("final_answer")))


def append_new(stream: DataFrame, path: str, checkpoint: str, key: str = "id"):
    """Writes rows whose key isn't in path yet, so a restarted run goes on where it stopped. Returns the running query."""

    def save(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
            batch = batch.join(spark.read.parquet(path).select(key), key, "left_anti")
        batch.dropDuplicates([key]).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def telemetry_windows(samples: DataFrame, late: str = "10 seconds", window: str = "1 minute") -> DataFrame:
    """Summaries of device samples by window of event time; failed polls (null numbers) count as samples only."""
    at = samples.withColumn("ts", F.to_timestamp("timestamp_utc")).withWatermark("ts", late)
    return at.groupBy(F.window("ts", window)).agg(
        F.count("*").alias("samples"), F.max("memory_used_mib").alias("used_max"), F.min("memory_free_mib").alias("free_min"),
        F.avg("gpu_utilization_percent").alias("utilization_mean"), F.max("power_draw_watts").alias("power_max"),
    ).select("window.start", "window.end", "samples", "used_max", "free_min", "utilization_mean", "power_max")
