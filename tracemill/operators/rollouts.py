"""Groups of sampled completions: contrast within groups, outcome and reward rates."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import number_text
from ..streaming import run, turns
from . import sampling
from .metrics import rate

OUTCOMES = ("valid_correct", "valid_incorrect", "invalid_correct", "invalid_incorrect", "no_answer")
FLAGS = ("all_success", "all_failure", "mixed", "zero_reward_std")


def contrast(df: DataFrame, group: Sequence[str], success: str, reward: str, members: int | None = None) -> DataFrame:
    """By group whether all members succeed, all fail or they differ, and whether their rewards are all equal.

    members: a group of more than one row and of another size is an error.
    """
    n = F.count("*")
    if members is not None:
        n = F.when((n > 1) & (n != members), F.raise_error(F.concat(F.lit("a group of "), n.cast("string"))).cast("bigint")).otherwise(n)
    flags = df.groupBy(*group).agg(
        n.alias("members"), F.bool_and(success).alias("all_success"), (~F.bool_or(success)).alias("all_failure"),
        (F.max(reward) == F.min(reward)).alias("zero_reward_std"),
    )
    return flags.withColumn("mixed", ~F.col("all_success") & ~F.col("all_failure"))


def contrast_rates(groups: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rates of the flags over groups."""
    return groups.groupBy(*by).agg(F.count("*").alias("n_groups"), *(rate(F.col(f)).alias(f) for f in FLAGS))


def wrong_sized(groups: DataFrame, members: int) -> DataFrame:
    """Groups without exactly so many members; must be empty."""
    return groups.where(F.col("members") != members)


def outcome_rates(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The share of each of the five outcomes, zeros kept."""
    return df.groupBy(*by).agg(*(rate(F.col("outcome") == o).alias(o) for o in OUTCOMES))


def reward_metrics(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Shares of rows: success, no answer, invalid traces and what they earn, truncation, and numbers of calls."""
    invalid = ~F.col("valid_trajectory")
    return df.groupBy(*by).agg(
        rate(F.col("outcome") == "valid_correct").alias("task_success"), rate(F.col("outcome") == "no_answer").alias("no_answer"),
        rate(invalid).alias("invalid_trace"), rate(invalid & F.col("answer_correct")).alias("correct_but_invalid"),
        rate(invalid & (F.col("reward") >= 0)).alias("nonnegative_invalid"), rate(F.col("truncated")).alias("truncated"),
        rate(F.col("tool_call_count") < F.col("expected_tool_call_count")).alias("under_call"),
        rate(F.col("tool_call_count") == F.col("expected_tool_call_count")).alias("exact_call"),
        rate(F.col("tool_call_count") > F.col("expected_tool_call_count")).alias("over_call"),
    )


def _wide(text: Column, width: int, right: bool = False) -> Column:
    """text with blanks up to a width; longer texts stay whole."""
    blanks = F.repeat(F.lit(" "), F.greatest(F.lit(width) - F.length(text), F.lit(0)))
    return F.concat(blanks, text) if right else F.concat(text, blanks)


def case_line(tier: Column, expected_calls: Column, expression: Column, answer: Column, stated: Column, correct: Column, valid: Column, calls: Column) -> Column:
    """One trajectory as a line of a report. An answer that wasn't stated is None; a truth value that is null counts as false."""
    word = lambda c, yes, no: F.when(c, yes).otherwise(no)
    # Labels, widths and order of the fields.
    return F.concat(
        F.lit("["), _wide(tier, 6, right=True), F.lit("] ops="), expected_calls.cast("string"), F.lit("  "), _wide(expression, 30),
        F.lit("  expected="), _wide(number_text(answer), 8), F.lit("  got="), _wide(F.coalesce(number_text(stated), F.lit("None")), 8),
        F.lit("  ans="), _wide(word(correct, "correct", "wrong"), 7), F.lit("  trace="), _wide(word(valid, "valid", "invalid"), 7),
        F.lit("  calls="), calls.cast("string"), F.lit("/"), expected_calls.cast("string"))


def rounds(prompts: DataFrame, respond: Callable[[DataFrame, int], DataFrame], budget: int, size: int, folder: str, dialect: str = "standard") -> DataFrame:
    """The agent loop over rows that are still active, round by round, until none is or the budget's turns are over.

    prompts: id (string), length (of the prompt). In each round respond gets the active rows with id, length, n_calls
    and batch, `size` rows of like length each, and the round's number from 0, and returns id, text, exhausted (a row
    without a response has none more to give). A turn's text adds to the length. budget + 1 rounds at most; each is a
    written table in folder, which must be shared. Returns id, n_calls, answer, error, turns_used, length; what didn't
    end has the error agent_loop_exhausted. An empty table has no rounds.
    """
    spark = prompts.sparkSession
    begin = prompts.select(
        F.col("id").cast("string").alias("id"), F.lit(0).cast("long").alias("n_calls"), F.lit(0).cast("long").alias("turns_used"), F.lit(None).cast("double").alias("answer"),
        F.lit(None).cast("string").alias("error"), F.lit(False).alias("done"), F.lit(0).cast("long").alias("at"), F.lit(False).alias("new"), F.col("length").cast("long").alias("length"))
    active, out = run.written(begin, f"{folder}/round-start"), []
    for number in range(budget + 1):
        if not active.head(1):
            break
        batched = sampling.batches(active.select("id", "length", "n_calls"), "length", "id", size)
        said = run.written(respond(batched, number).select(F.col("id").cast("string").alias("id"), F.lit(number).alias("turn"), "text", "exhausted"), f"{folder}/said-{number}")
        lengths = said.groupBy("id").agg(F.sum(F.length("text")).alias("more"))
        after = turns.advanced(active.drop("length"), said, budget, number, dialect).join(active.select("id", "length"), "id").join(lengths, "id", "left")
        # Without a response there is no further round for a row.
        over = F.col("done") | F.col("more").isNull()
        state = run.written(after.withColumn("over", over).withColumn("length", F.col("length") + F.coalesce("more", F.lit(0))).drop("more"), f"{folder}/round-{number}")
        out.append(state.where("over").drop("over"))
        active = state.where("not over").drop("over")
    out.append(active)
    every = out[0]
    for part in out[1:]:
        every = every.unionByName(part)
    return every.select("id", "n_calls", "answer", F.when(F.col("done"), F.col("error")).otherwise("agent_loop_exhausted").alias("error"), "turns_used", "length")


def replayed(df: DataFrame, id_: str, versions: dict[str, Column], fields: Sequence[str]) -> DataFrame:
    """Rows of the stored predictions whose outcome differs between two versions of a scorer: id, field, before, after (strings).

    versions: two scores by name, each a struct with the fields, the older first. Both are worked out in one pass over the
    predictions and compared field by field, nulls told apart from values.
    """
    (_, old), (_, new) = versions.items()
    scored = df.select(id_, old.alias("old"), new.alias("new"))
    pair = lambda f: F.struct(F.lit(f).alias("field"), F.col("old")[f].cast("string").alias("before"), F.col("new")[f].cast("string").alias("after"))
    each = scored.select(id_, F.explode(F.array(*map(pair, fields))).alias("c")).select(id_, "c.*")
    return each.where(~F.col("before").eqNullSafe(F.col("after")))
