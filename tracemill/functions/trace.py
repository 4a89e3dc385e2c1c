"""Scoring of call sequences against every order in which an expression can be reduced, without a UDF.

The fold over the calls carries all states that the calls so far can have led to. An expression's tokens are numbers in
even places and operators in odd ones; a state is struct<n, o> of the two, n null where an even place holds no number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expressions import calculate, tokens

STATE = "struct<n: array<double>, o: array<string>>"
CALL = "struct<op: string, a: double, b: double>"


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def start_state(pieces: Column) -> Column:
    """The state of an expression's tokens."""
    numbers = F.transform(F.filter(pieces, lambda x, i: i % 2 == 0), lambda x: x.try_cast("double"))
    return F.struct(numbers.alias("n"), F.filter(pieces, lambda x, i: i % 2 == 1).alias("o")).cast(STATE)


def _next(states: Column, call: Column, stuck: Column) -> Column:
    """The states that a call can lead to; none if it is illegal in all. stuck: a product sign in an even place, which never goes."""
    op, a, b = call["op"], call["a"], call["b"]
    nowhere = F.array().cast("array<int>")

    def of(s: Column) -> Column:
        def matches(i: Column) -> Column:
            left, right = F.get(s["n"], i), F.get(s["n"], i + 1)
            return F.coalesce((F.get(s["o"], i) == op) & (((left == a) & (right == b)) | ((op != "-") & (left == b) & (right == a))), F.lit(False))

        products = F.when(F.size(s["o"]) > 0, F.filter(F.sequence(F.lit(0), F.size(s["o"]) - 1), matches)).otherwise(nowhere)
        first = F.when(~stuck & ~F.array_contains(s["o"], "*") & matches(F.lit(0)), F.array(F.lit(0))).otherwise(nowhere)
        after = lambda i: F.struct(
            F.concat(F.slice(s["n"], F.lit(1), i), F.array(calculate(op, a, b)), F.slice(s["n"], i + 3, F.size(s["n"]))).alias("n"),
            F.concat(F.slice(s["o"], F.lit(1), i), F.slice(s["o"], i + 2, F.size(s["o"]))).alias("o"),
        )
        return F.transform(F.when(op == "*", products).when(op.isin("+", "-"), first).otherwise(nowhere), after)

    moved = F.flatten(F.transform(states, of))
    return bind(moved, lambda m: F.when(F.size(m) > 1, F.array_distinct(m)).otherwise(m))


def _why(call: Column, states: Column, known: Column, stuck: Column) -> Column:
    """The class of an illegal call, the first that holds."""
    a, b = call["a"], call["b"]
    held = lambda s, x: F.size(F.filter(s["n"], lambda n: n == x))
    branch = F.exists(states, lambda s: F.when(a == b, held(s, a) >= 2).otherwise((held(s, a) >= 1) & (held(s, b) >= 1)))
    # The names of the classes.
    return (
        F.when(F.exists(states, lambda s: F.size(s["n"]) + F.size(s["o"]) == 1), "post_completion_call")
        .when(call["op"].isin("+", "-") & (stuck | F.exists(states, lambda s: F.array_contains(s["o"], "*"))), "precedence_violation")
        .when(branch, "branch_mismatch")
        .when(F.array_contains(known, a) & F.array_contains(known, b), "reused_operand")
        .otherwise("ungrounded_operand")
    )


def given(text: Column, calls: Column, stated: Column, expected_calls: Column, answer: Column) -> Column:
    """What a trajectory is judged by: start state, calls, answers, and whether a product sign stands where a number should."""
    held = F.coalesce(calls, F.array()).cast(f"array<{CALL}>")
    return bind(tokens(text), lambda p: F.struct(
        start_state(p).alias("start"), (F.size(F.filter(p, lambda x, i: (i % 2 == 0) & (x == "*"))) > 0).alias("stuck"), held.alias("calls"), stated.alias("stated"),
        expected_calls.alias("expected"), answer.alias("answer"),
    ))


def judged(x: Column, end: Column) -> Column:
    """The score of a trajectory (given) whose legal calls, `legal` of them, lead to the states of end; bad: the next one is illegal in all."""
    done = F.transform(F.slice(x["calls"], F.lit(1), end["legal"]), lambda c: calculate(c["op"], c["a"], c["b"]))
    reason = F.when(end["bad"], _why(F.get(x["calls"], end["legal"]), end["states"], F.concat(F.filter(x["start"]["n"], lambda n: n.isNotNull()), done), x["stuck"]))
    reduced = ~end["bad"] & F.coalesce(F.exists(end["states"], lambda s: (F.size(s["n"]) == 1) & (F.size(s["o"]) == 0) & (F.get(s["n"], F.lit(0)) == x["answer"])), F.lit(False))
    return bind(F.struct(reason.alias("reason"), reduced.alias("reduced")), lambda r: _result(x, end, r))


def _result(x: Column, end: Column, r: Column) -> Column:
    n, legal = F.size(x["calls"]), ~end["bad"]
    right_count = n == x["expected"]
    valid, correct = r["reduced"] & F.coalesce(right_count, F.lit(False)), F.coalesce(x["stated"] == x["answer"], F.lit(False))
    # The names of the outcomes and the fields.
    outcome = (
        F.when(x["stated"].isNull(), "no_answer").when(valid & correct, "valid_correct").when(~valid & ~correct, "invalid_incorrect")
        .when(valid, "valid_incorrect").otherwise("invalid_correct")
    )
    reward = F.when(x["stated"].isNull(), -0.1).when(valid & correct, 2.0).when(~valid & ~correct, -1.0).otherwise(0.0)
    return F.struct(
        reward.alias("reward"), outcome.alias("outcome"), legal.alias("all_calls_legal"), end["legal"].alias("legal_call_count"),
        r["reduced"].alias("fully_reduced"), right_count.alias("call_count_correct"), F.greatest(F.lit(0), n - x["expected"]).alias("overcall_count"),
        F.when(end["bad"], end["legal"] + 1).alias("first_illegal_call_index"), r["reason"].alias("first_illegal_reason"),
        F.when(r["reason"] == "post_completion_call", n - end["legal"]).otherwise(0).alias("post_completion_call_count"),
        valid.alias("valid_trajectory"), correct.alias("answer_correct"),
    )


def next_states(states: Column, call: Column, stuck: Column) -> Column:
    """The states that a call can lead to from any of the given ones; none if it is illegal in all."""
    return _next(states, call, stuck)


def score(text: Column, calls: Column, stated: Column, expected_calls: Column, answer: Column) -> Column:
    """struct of reward, outcome, legality, counts and the first illegal call of a trajectory.

    calls: array<struct<op, a, b>>, null for none; stated: the answer given, null if there was none. Reward is
    -0.1 without an answer, 2 for a valid and right trajectory, -1 if both are wrong, else 0.
    """

    def folded(x: Column) -> Column:
        begin = F.struct(F.array(x["start"]).alias("states"), F.lit(0).alias("legal"), F.lit(False).alias("bad"))

        def step(acc: Column, call: Column) -> Column:
            good = lambda new: F.struct(new.alias("states"), (acc["legal"] + 1).alias("legal"), F.lit(False).alias("bad"))
            wrong = F.struct(acc["states"].alias("states"), acc["legal"].alias("legal"), F.lit(True).alias("bad"))
            return F.when(acc["bad"], acc).otherwise(bind(_next(acc["states"], call, x["stuck"]), lambda new: F.when(F.size(new) > 0, good(new)).otherwise(wrong)))

        return bind(F.aggregate(x["calls"], begin, step), lambda end: judged(x, end))

    return bind(given(text, calls, stated, expected_calls, answer), folded)


def planned_score(plan: Column, calls: Column, stated: Column, answer: Column) -> Column:
    """The outcome where only the planned calls in their planned order count as a valid trajectory: struct with the fields of score that it has.

    plan and calls: array<struct<op, a, b>>, null for none. The first call that isn't the planned one, or is beyond the plan, is the first wrong one.
    """
    as_calls = lambda c: F.coalesce(c, F.array()).cast(f"array<{CALL}>")
    given = F.struct(as_calls(plan).alias("plan"), as_calls(calls).alias("calls"), stated.alias("stated"), answer.alias("answer"))

    def judged(x: Column) -> Column:
        same = F.transform(x["calls"], lambda c, i: c.eqNullSafe(F.get(x["plan"], i)))
        return bind(F.array_position(same, False).cast("int"), lambda at: told(x, at))

    def told(x: Column, at: Column) -> Column:
        valid, correct = (at == 0) & (F.size(x["calls"]) == F.size(x["plan"])), F.coalesce(x["stated"] == x["answer"], F.lit(False))
        outcome = (
            F.when(x["stated"].isNull(), "no_answer").when(valid & correct, "valid_correct").when(~valid & ~correct, "invalid_incorrect")
            .when(valid, "valid_incorrect").otherwise("invalid_correct")
        )
        reward = F.when(x["stated"].isNull(), -0.1).when(valid & correct, 2.0).when(~valid & ~correct, -1.0).otherwise(0.0)
        return F.struct(
            reward.alias("reward"), outcome.alias("outcome"), F.when(at > 0, at - 1).otherwise(F.size(x["calls"])).alias("legal_call_count"), F.when(at > 0, at).alias("first_illegal_call_index"),
            valid.alias("valid_trajectory"), correct.alias("answer_correct"),
        )

    return bind(given, judged)


def semantic_trace(text: Column, calls: Column, answer: Column, expected_calls: Column) -> Column:
    """struct<valid, complete>: at least one call and all legal; fully reduced to the answer."""
    some = F.size(F.coalesce(calls, F.array().cast(f"array<{CALL}>"))) > 0
    return bind(score(text, calls, answer, expected_calls, answer), lambda s: F.struct((some & s["all_calls_legal"]).alias("valid"), s["fully_reduced"].alias("complete")))


def progress(legal: Column, expected: Column) -> Column:
    """The legal calls' share of the expected ones, 1 at most."""
    return F.least(legal, expected) / expected


def shaped_reward(s: Column, expected: Column, *, max_bonus: float = 0, per_call_bonus: float = 0, strict: bool = False, binary: bool = False, strict_valid: float = 2.0) -> Column:
    """struct<reward, adjustment> for one of the modes, or the terminal reward as it is when none is set.

    max_bonus: that much for full progress; per_call_bonus: for each legal call up to the expected ones; strict:
    penalties by class and overcalls, capped at -0.5; binary: 2 for valid and right, else 0.
    """
    if sum(map(bool, (max_bonus, per_call_bonus, strict, binary))) > 1:
        raise ValueError("the modes exclude one another")
    if strict and strict_valid < 2:
        raise ValueError("a valid and right trajectory must earn at least 2 in strict mode")
    if binary:
        reward = F.when(s["valid_trajectory"] & s["answer_correct"], 2.0).otherwise(0.0)
    elif strict:
        penalty = F.when(s["first_illegal_reason"] == "post_completion_call", 0.75).when(s["first_illegal_reason"].isNotNull(), 0.5).otherwise(0.0)
        wrong = F.lit(-1.0) + 0.2 * progress(s["legal_call_count"], expected) - penalty - 0.25 * s["overcall_count"]
        reward = (
            F.when(s["outcome"] == "no_answer", -1.2).when(s["valid_trajectory"], F.when(s["answer_correct"], float(strict_valid)).otherwise(-0.5))
            .otherwise(F.least(F.lit(-0.5), wrong))
        )
    else:
        bonus = per_call_bonus * F.least(s["legal_call_count"], expected) if per_call_bonus else max_bonus * progress(s["legal_call_count"], expected)
        reward = s["reward"] + F.when(s["outcome"] == "no_answer", 0.0).otherwise(bonus)
    return F.struct(reward.alias("reward"), (reward - s["reward"]).alias("adjustment"))
