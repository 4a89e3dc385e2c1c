"""Expressions, traces and parsers on problems made from line items."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import expressions as X
from ..functions import hashing, parsing, trace, transcripts
from ..operators import checks, containment, generate, metrics, packing, reduction, rollouts, shared
from ..sources import readers
from ..streaming import run
from .registry import query, table

C = F.col
_N = "SELECT l_orderkey, l_linenumber, l_quantity::BIGINT AS q, l_partkey % 19 + 2 AS p, l_suppkey % 17 + 2 AS s, l_orderkey % 8 AS k FROM lineitem"
_KEYS, _INPUTS = ["l_orderkey", "l_linenumber"], ["q", "p", "s", "k"]


def _numbers():
    return [C("l_quantity").alias("q"), (C("l_partkey") % 19 + 2).cast("double").alias("p"), (C("l_suppkey") % 17 + 2).cast("double").alias("s")]


def _expression():
    return X.expression(F.array("q", "p", "s"), F.array(F.lit("+"), F.lit("*")))


def _lines(spark, d):
    """Keys and numbers of line items."""
    return table(spark, d, "lineitem").select(*_KEYS, *_numbers(), (C("l_orderkey") % 8).alias("k"))


def _problems(spark, d):
    """q + p*s with its parts."""
    lines = readers.dealt(table(spark, d, "lineitem").select(*_KEYS, "l_quantity", "l_partkey", "l_suppkey"))
    return lines.select(*_KEYS, *_numbers(), (C("l_orderkey") % 8).alias("k")).withColumn("e", _expression())


@query(f"""SELECT l_orderkey, l_linenumber, q || ' + ' || p || '*' || s AS expression, ((q + p) * s)::DOUBLE AS naive, (q + p * s)::DOUBLE AS answer,
  2 AS num_terms, 2 AS max_factors, 'easy' AS tier, s > 1 AND q <> 0 AS useful FROM ({_N})""")
def naive_vs_precedence(spark, d):
    """Text, value with and without precedence, structure, tier and use of expressions."""
    e = C("e")
    text = X.render(e)
    return _problems(spark, d).withColumn("text", text).withColumn("trace", X.precedence_trace(e)).select(
        *_KEYS, C("text").alias("expression"), X.left_to_right(e).alias("naive"), C("trace")["answer"].alias("answer"),
        X.structure(e)["num_terms"].alias("num_terms"), X.structure_of_text(C("text"))["max_factors"].alias("max_factors"),
        X.tier(F.size(e["operators"])).alias("tier"), X.is_useful(e, trace=C("trace")).alias("useful"))


@query(f"SELECT l_orderkey, l_linenumber, q || '|+|' || p || '|*|' || s AS tokens, '-' || q || '|+|' || p || '.5' AS signed FROM ({_N})")
def tokenize_eval(spark, d):
    """Numbers and operators of a text."""
    signed = F.concat(F.lit("-"), X.number_text(C("q")), F.lit(" + "), X.number_text(C("p")), F.lit(".5"))
    return _problems(spark, d).select(*_KEYS, F.array_join(X.tokens(X.render(C("e"))), "|").alias("tokens"), F.array_join(X.tokens(signed), "|").alias("signed"))


def _once(spark, d, work, inputs=_INPUTS):
    """The keys of line items with what work makes of their problems; equal problems, as most line items have, are worked on once."""
    made = lambda rows: work(rows.withColumn("e", _expression()) if "s" in inputs else rows)
    lines = _lines(spark, d)
    told = shared.once(lines, inputs, made, f"{run.scratch(spark)}/told")
    return told.select(*_KEYS, *(c for c in told.columns if c not in lines.columns))


def _trajectories(problems):
    """Problems with calls and a stated answer that are right or spoiled by key."""
    q, p, s, k = C("q"), C("p"), C("s"), C("k")
    call = lambda op, a, b: F.struct(F.lit(op).alias("op"), a.alias("a"), b.alias("b"))
    good, answer = [call("*", p, s), call("+", q, p * s)], q + p * s
    calls = (
        F.when(k.isin(0, 1, 2), F.array(*good)).when(k == 3, F.array(call("*", s, p), call("+", p * s, q))).when(k == 4, F.array(*good, call("+", answer, F.lit(0.0))))
        .when(k == 5, F.array(call("+", q, p), good[0])).when(k == 6, F.array(good[0])).otherwise(F.array(good[0], call("+", F.lit(-5.0), F.lit(-7.0))))
    )
    stated = F.when(k == 1, answer + 1).when(k == 2, None).otherwise(answer)
    return problems.select("*", X.render(C("e")).alias("expression"), calls.alias("calls"), stated.alias("stated"), answer.alias("answer"),
        X.precedence_trace(C("e"))["steps"].alias("plan"))


_SCORE = """CASE k WHEN 1 THEN 'valid_incorrect' WHEN 2 THEN 'no_answer' WHEN 0 THEN 'valid_correct' WHEN 3 THEN 'valid_correct' ELSE 'invalid_correct' END AS outcome,
  CASE k WHEN 4 THEN 'post_completion_call' WHEN 5 THEN 'precedence_violation' WHEN 7 THEN 'ungrounded_operand' END AS reason,
  CASE k WHEN 5 THEN 0 WHEN 6 THEN 1 WHEN 7 THEN 1 ELSE 2 END AS legal"""


def _scored(problems):
    return _trajectories(problems).withColumn("score", trace.score(C("expression"), C("calls"), C("stated"), F.lit(2), C("answer")))


@query(f"""SELECT l_orderkey, l_linenumber, {_SCORE}, CASE k WHEN 4 THEN 3 WHEN 5 THEN 1 WHEN 7 THEN 2 END AS first_illegal, (k = 4)::INTEGER AS overcalls,
  CASE WHEN k = 2 THEN -0.1 WHEN k IN (0, 3) THEN 2.0 ELSE 0.0 END AS reward FROM ({_N})""")
def score_trace(spark, d):
    """Legality of call sequences, class of the first illegal call, outcome and reward."""
    s = C("score")
    return _once(spark, d, lambda problems: _scored(problems).select(
        *_INPUTS, s["outcome"].alias("outcome"), s["first_illegal_reason"].alias("reason"), s["legal_call_count"].alias("legal"),
        s["first_illegal_call_index"].alias("first_illegal"), s["overcall_count"].alias("overcalls"), s["reward"].alias("reward")))


@query(f"""SELECT l_orderkey * 10 + l_linenumber AS id, {_SCORE}, CASE k WHEN 4 THEN 3 WHEN 5 THEN 1 WHEN 7 THEN 2 END AS first_illegal FROM ({_N})""")
def score_graph(spark, d):
    """The same scores from a graph of reductions that all trajectories on an expression share."""
    s = C("score")

    def walked(problems):
        # The rows that agree in all inputs are one trajectory of the graph.
        rows = _trajectories(problems).select(F.struct(*_INPUTS).alias("id"), "expression", "calls", "stated", F.lit(2).alias("expected"), "answer")
        return reduction.scored(rows, "id", run.scratch(spark)).select(
            *(C("id")[c].alias(c) for c in _INPUTS), s["outcome"].alias("outcome"), s["first_illegal_reason"].alias("reason"), s["legal_call_count"].alias("legal"),
            s["first_illegal_call_index"].alias("first_illegal"))

    return _once(spark, d, walked).select((C("l_orderkey") * 10 + C("l_linenumber")).alias("id"), "outcome", "reason", "legal", "first_illegal")


@query(f"SELECT l_orderkey, l_linenumber, k NOT IN (4, 5, 7) AS valid, k IN (0, 1, 2, 3) AS complete FROM ({_N})")
def semantic_trace(spark, d):
    """Whether calls are legal, and whether they reduce the expression to its answer."""
    t = trace.semantic_trace(C("expression"), C("calls"), C("answer"), F.lit(2))
    return _once(spark, d, lambda problems: _trajectories(problems).select(*_INPUTS, t["valid"].alias("valid"), t["complete"].alias("complete")))


@query(f"""WITH b AS (SELECT l_orderkey, l_linenumber, k, {_SCORE}, CASE WHEN k = 2 THEN -0.1 WHEN k IN (0, 3) THEN 2.0 ELSE 0.0 END AS r FROM ({_N}))
SELECT l_orderkey, l_linenumber, round(CASE WHEN k = 2 THEN r ELSE r + 0.1 * least(legal, 2) / 2.0 END, 6) AS normalized, round(CASE WHEN k = 2 THEN r ELSE r + 0.5 * least(legal, 2) END, 6) AS per_call,
  round(CASE WHEN k = 2 THEN -1.2 WHEN k IN (0, 3) THEN 2.0 WHEN k = 1 THEN -0.5 ELSE least(-0.5, -1 + 0.2 * least(legal, 2) / 2.0 - CASE WHEN k = 4 THEN 0.75 WHEN k = 6 THEN 0 ELSE 0.5 END - 0.25 * (k = 4)::INTEGER) END, 6) AS strict,
  CASE WHEN k IN (0, 3) THEN 2.0 ELSE 0.0 END AS "binary" FROM b""")
def reward_modes(spark, d):
    """The four ways of shaping a reward."""
    shaped = lambda **mode: F.round(trace.shaped_reward(C("score"), F.lit(2), **mode)["reward"], 6)
    return _once(spark, d, lambda problems: _scored(problems).select(
        *_INPUTS, shaped(max_bonus=0.1).alias("normalized"), shaped(per_call_bonus=0.5).alias("per_call"), shaped(strict=True).alias("strict"), shaped(binary=True).alias("binary")))


@query(f"SELECT outcome, coalesce(reason, 'none') AS reason, count(*) AS n FROM (SELECT {_SCORE} FROM ({_N})) GROUP BY ALL")
def failure_classes(spark, d):
    """Counts of outcomes and classes of failures."""
    s = C("score")
    told = _once(spark, d, lambda problems: _scored(problems).select(*_INPUTS, s["outcome"].alias("outcome"), metrics.bucket(s["first_illegal_reason"]).alias("reason")))
    return told.groupBy("outcome", "reason").agg(F.count("*").alias("n"))


@query(f"""WITH b AS (SELECT l_orderkey * 10 + l_linenumber AS id, k, {_SCORE}, CASE WHEN k = 2 THEN -0.1 WHEN k IN (0, 3) THEN 2.0 ELSE 0.0 END AS reward, k IN (0, 1, 2, 3) AS valid,
  CASE k WHEN 4 THEN 3 WHEN 5 THEN 1 WHEN 7 THEN 2 END AS first, CASE WHEN k = 3 THEN CASE WHEN s <> p THEN 1 WHEN q <> p * s THEN 2 END WHEN k = 4 THEN 3 WHEN k = 5 THEN 1 WHEN k = 7 THEN 2 END AS wrong FROM ({_N})),
c AS (SELECT *, k IN (0, 1, 2) OR (k = 3 AND wrong IS NULL) AS kept, CASE WHEN wrong IS NULL THEN CASE WHEN k = 6 THEN 1 ELSE 2 END ELSE wrong - 1 END AS right_calls FROM b),
d AS (SELECT *, CASE WHEN k = 2 THEN 'no_answer' WHEN kept AND k <> 1 THEN 'valid_correct' WHEN kept THEN 'valid_incorrect' ELSE 'invalid_correct' END AS outcome2, CASE WHEN k = 2 THEN -0.1 WHEN kept AND k <> 1 THEN 2.0 ELSE 0.0 END AS reward2 FROM c),
e AS (SELECT id, unnest(['reward', 'outcome', 'valid_trajectory', 'first_illegal_call_index', 'legal_call_count']) AS field, unnest([reward::DOUBLE::VARCHAR, outcome, valid::VARCHAR, first::VARCHAR, legal::VARCHAR]) AS before,
  unnest([reward2::DOUBLE::VARCHAR, outcome2, kept::VARCHAR, wrong::VARCHAR, right_calls::VARCHAR]) AS after FROM d)
SELECT * FROM e WHERE before IS DISTINCT FROM after""")
def rescored_changes(spark, d):
    """Stored trajectories replayed through a scorer that takes any order that reduces the expression and a revised one that takes the plan only, and what differs."""
    plan = F.transform(C("plan"), lambda c: F.struct(c["op"].alias("op"), c["a"].alias("a"), c["b"].alias("b")))
    versions = {
        "reduction": trace.score(C("expression"), C("calls"), C("stated"), F.lit(2), C("answer")),
        "plan": trace.planned_score(plan, C("calls"), C("stated"), C("answer")),
    }
    fields = ["reward", "outcome", "valid_trajectory", "first_illegal_call_index", "legal_call_count"]

    def changes(problems):
        return rollouts.replayed(_trajectories(problems).withColumn("id", F.struct(*_INPUTS)), "id", versions, fields).select("id.*", "field", "before", "after")

    return _once(spark, d, changes).select((C("l_orderkey") * 10 + C("l_linenumber")).alias("id"), "field", "before", "after")


def _call_text(op: str, a, b, name: str = "calculator"):
    return F.concat(F.lit(f'{{"name": "{name}", "arguments": {{"op": "{op}", "a": '), a, F.lit(', "b": '), b, F.lit("}}"))


@query(f"""SELECT l_orderkey, l_linenumber, CASE k WHEN 1 THEN 'unclosed_tool_call' WHEN 2 THEN 'multiple_tool_calls_in_one_turn' WHEN 3 THEN 'malformed_tool_call' WHEN 4 THEN 'wrong_tool_name'
  WHEN 5 THEN 'invalid_operator' WHEN 6 THEN 'non_numeric_operand' WHEN 7 THEN 'wrong_argument_schema' END AS error, CASE WHEN k = 0 THEN '*' END AS op,
  CASE WHEN k = 0 THEN p::DOUBLE END AS a, CASE WHEN k = 0 THEN s + 0.5 END AS b FROM ({_N})""")
def tool_call_parse(spark, d):
    """The tool call of a text, or what is wrong with it."""
    p, s, k = X.number_text(C("p")), F.concat(X.number_text(C("s")), F.lit(".5")), C("k")
    tag = lambda x: F.concat(F.lit("so <tool_call>\n"), x, F.lit("\n</tool_call>"))
    good = tag(_call_text("*", p, s))
    text = (
        F.when(k == 1, F.concat(F.lit("<tool_call>"), p)).when(k == 2, F.concat(good, good)).when(k == 3, tag(F.concat(F.lit('{"name": '), p)))
        .when(k == 4, tag(_call_text("*", p, s, "search"))).when(k == 5, tag(_call_text("/", p, s))).when(k == 6, tag(_call_text("*", F.lit("true"), s)))
        .when(k == 7, tag(F.concat(F.lit('{"name": "calculator", "arguments": {"op": "*", "a": '), p, F.lit("}}")))).otherwise(good)
    )
    got = parsing.tool_call(C("text"))
    return _problems(spark, d).select(*_KEYS, text.alias("text")).select(*_KEYS, got["error"].alias("error"), *(got["call"][c].alias(c) for c in ("op", "a", "b")))


@query(f"""SELECT l_orderkey, l_linenumber, CASE k WHEN 0 THEN q WHEN 1 THEN p WHEN 2 THEN q + 0.5 WHEN 3 THEN -s WHEN 4 THEN p WHEN 5 THEN q WHEN 6 THEN s END::DOUBLE AS answer FROM ({_N})""")
def final_answer(spark, d):
    """The last match of the first form of an answer that occurs."""
    q, p, s, k = X.number_text(C("q")), X.number_text(C("p")), X.number_text(C("s")), C("k")
    text = (
        F.when(k == 0, F.concat(F.lit("The answer is "), q)).when(k == 1, F.concat(F.lit("answer is "), q, F.lit(". The ANSWER IS: $"), p, F.lit("$")))
        .when(k == 2, F.concat(F.lit("The final result of\nall this is "), q, F.lit(".5"))).when(k == 3, F.concat(F.lit("\\boxed{ -"), s, F.lit(" }")))
        .when(k == 4, F.concat(F.lit("Final answer: "), p)).when(k == 5, F.concat(F.lit("  $"), q, F.lit("$. "))).when(k == 6, F.concat(F.lit("final = "), q, F.lit(" but the answer is "), s))
        .otherwise(F.concat(F.lit("about "), q, F.lit(" or so")))
    )
    return _problems(spark, d).select(*_KEYS, parsing.final_answer(text).alias("answer"))


@query(f"""SELECT l_orderkey, l_linenumber, 'think' AS lead, 'think <tool_call>' || q || '</tool_call>' AS kept, CASE WHEN k < 4 THEN 2 ELSE 3 END::BIGINT AS n_tokens,
  (k % 3)::BIGINT AS n_marks FROM ({_N})""")
def turn_text(spark, d):
    """Text up to the first call, tokens up to the end id, occurrences of a part."""
    text = F.concat(F.lit("think <tool_call>"), X.number_text(C("q")), F.lit("</tool_call> and more </tool_call>"))
    ids = F.when(C("k") < 4, F.array(F.lit(5), F.lit(9), F.lit(9))).otherwise(F.array(F.lit(5), F.lit(6), F.lit(7)))
    return _problems(spark, d).select(
        *_KEYS, parsing.before_call(text).alias("lead"), parsing.first_call_only(text).alias("kept"), parsing.generated_count(ids, 9, F.lit(False)).alias("n_tokens"),
        parsing.occurrences(F.concat(F.lit("x"), F.repeat(F.lit("<m>"), (C("k") % 3).cast("int"))), F.lit("<m>")).alias("n_marks"))


@query(f"""SELECT l_orderkey, l_linenumber, CASE k WHEN 1 THEN 'thinking_budget_exhausted' WHEN 2 THEN 'missing_final_answer' WHEN 3 THEN 'max_tool_calls_exceeded' WHEN 4 THEN 'agent_loop_exhausted'
  WHEN 5 THEN 'malformed_tool_call' END AS error, CASE WHEN k IN (0, 6, 7) THEN (q + p)::DOUBLE END AS answer, CASE k WHEN 3 THEN 1 WHEN 1 THEN 0 WHEN 5 THEN 0 ELSE 1 END AS n_calls,
  CASE k WHEN 1 THEN 1 WHEN 4 THEN 1 WHEN 5 THEN 1 ELSE 2 END AS turns_used FROM ({_N})""")
def turn_machine(spark, d):
    """An agent's turns folded to calls, answer and error."""
    q, p, k = C("q"), C("p"), C("k")
    turn = lambda text, exhausted=F.lit(False): F.struct(text.alias("text"), exhausted.alias("exhausted"))
    call = F.concat(F.lit("<tool_call>"), _call_text("+", X.number_text(q), X.number_text(p)), F.lit("</tool_call>"))
    answer = F.concat(F.lit("The answer is "), X.number_text(q + p))
    turns = (
        F.when(k == 1, F.array(turn(F.lit("hm"), F.lit(True)), turn(answer))).when(k == 2, F.array(turn(call), turn(F.lit("done"))))
        .when(k == 3, F.array(turn(call), turn(call), turn(answer))).when(k == 4, F.array(turn(call))).when(k == 5, F.array(turn(F.lit("<tool_call>{</tool_call>")), turn(answer)))
        .otherwise(F.array(turn(call), turn(answer)))
    )
    played = parsing.play(C("turns"), 1)
    inputs = ["q", "p", "k"]
    return _once(spark, d, lambda problems: problems.select(*inputs, turns.alias("turns")).select(*inputs, played.alias("r")).select(
        *inputs, "r.error", "r.answer", F.size("r.calls").alias("n_calls"), "r.turns_used"), inputs)


@query(f"""SELECT l_orderkey, l_linenumber, k NOT IN (1, 2) AS answer_correct, true AS used_tool, k <> 2 AS parseable_completion, k NOT IN (4, 6) AS tool_call_count_correct, k IN (0, 1, 2) OR (k = 3 AND p = s AND q = p * s) AS exact_trace,
  k IN (0, 3) AS task_success FROM ({_N})""")
def row_metrics(spark, d):
    """Metrics of a prediction against its plan; an answer that is missing is never right."""
    plan = F.transform(C("plan"), lambda c: F.struct(c["op"].alias("op"), c["a"].alias("a"), c["b"].alias("b")))
    correct = F.coalesce(C("stated") == C("answer"), F.lit(False))
    return _once(spark, d, lambda problems: _scored(problems).select(
        *_INPUTS, correct.alias("answer_correct"), (F.size("calls") > 0).alias("used_tool"), C("stated").isNotNull().alias("parseable_completion"),
        (F.size("calls") == 2).alias("tool_call_count_correct"), (C("calls") == plan).alias("exact_trace"),
        (correct & (F.size("calls") > 0) & C("score")["fully_reduced"]).alias("task_success")))


@query(f"""SELECT l_orderkey, l_linenumber, format('[{{:>6}}] ops={{}}  {{:<30}}  expected={{:<8}}  got={{:<8}}  ans={{:<7}}  trace={{:<7}}  calls={{}}/{{}}', 'easy', 2, q || ' + ' || p || '*' || s, q + p * s,
  coalesce((CASE k WHEN 2 THEN NULL WHEN 1 THEN q + p * s + 1 ELSE q + p * s END)::VARCHAR, 'None'), CASE WHEN k IN (1, 2) THEN 'wrong' ELSE 'correct' END,
  CASE WHEN k < 4 THEN 'valid' ELSE 'invalid' END, CASE k WHEN 4 THEN 3 WHEN 6 THEN 1 ELSE 2 END, 2) AS line FROM ({_N}) WHERE k NOT IN (0, 3)""")
def case_lines(spark, d):
    """A line of a report for each trajectory that failed."""
    s, n = C("score"), F.size("calls")
    line = rollouts.case_line(X.tier(F.lit(2)), F.lit(2), C("expression"), C("answer"), C("stated"), s["answer_correct"], s["valid_trajectory"], n)
    # As the variable of a function the score is worked out once; a plain condition on it would be moved before it, with the score in each of its terms.
    failed = F.explode(F.filter(F.array("score"), lambda x: ~(x["valid_trajectory"] & x["answer_correct"])))
    return _once(spark, d, lambda problems: _scored(problems).select(*_INPUTS, "expression", "answer", "stated", "calls", failed.alias("score")).select(*_INPUTS, line.alias("line")))


@query(f"""SELECT l_orderkey, l_linenumber, 2 AS n_calls, '*,+' AS ops, p * s || ',' || (q + p * s) AS results, 'The answer is ' || (q + p * s) || '.' AS final_text, 7 AS n_messages FROM ({_N})""")
def transcript_build(spark, d):
    """A transcript built from a trace, and its calls, observations and final text read back."""
    t, inputs = C("t"), ["q", "p", "s", "turn"]
    # The wording goes by the order's key modulo the number of sentences, so equal problems of one remainder have equal transcripts.
    sentences = math.lcm(*map(len, transcripts.WORDING.values()))
    lines = _lines(spark, d).withColumn("turn", F.pmod("l_orderkey", F.lit(sentences)))
    m = transcripts.build(F.lit("system"), X.render(C("e")), t["steps"], t["answer"], C("turn"))
    built = lambda problems: problems.withColumn("e", _expression()).withColumn("t", X.precedence_trace(C("e"))).select(*inputs, m.alias("m")).select(
        *inputs, F.size(transcripts.expected_calls(C("m"))).alias("n_calls"), F.array_join(F.transform(transcripts.expected_calls(C("m")), lambda c: c["op"]), ",").alias("ops"),
        F.array_join(F.transform(transcripts.observations(C("m")), lambda x: X.number_text(transcripts.read_result(x))), ",").alias("results"),
        transcripts.final_text(C("m")).alias("final_text"), F.size("m").alias("n_messages"))
    return shared.once(lines, inputs, built, f"{run.scratch(spark)}/told").drop("q", "p", "s", "k", "turn")


_SLOTS = "SELECT c_custkey::VARCHAR AS id, CASE WHEN c_nationkey = 0 THEN 'easy' WHEN c_mktsegment = 'BUILDING' THEN 'medium' ELSE 'hard' END AS tier, c_mktsegment AS stage FROM customer"


def _slots(spark, d):
    """Rows of customer as slots of a tier, and the expressions of line items, which no slot may get."""
    tier = F.when(C("c_nationkey") == 0, "easy").when(C("c_mktsegment") == "BUILDING", "medium").otherwise("hard")
    slots = table(spark, d, "customer").select(C("c_custkey").cast("string").alias("id"), tier.alias("tier"), C("c_mktsegment").alias("stage"))
    # Equal numbers are put into words once: line items share them.
    numbers = table(spark, d, "lineitem").select(*_numbers()).distinct()
    return slots, numbers.select(X.render(_expression()).alias("expression")).distinct()


@query(f"""SELECT tier, count(*) AS n_slots, count(*) AS n_filled, count(*) AS n_expressions, 0::BIGINT AS n_seen, 0::BIGINT AS n_other_tier, 0::BIGINT AS violations, 0::BIGINT AS ood_violations, 0::BIGINT AS replay_failures
FROM ({_SLOTS}) GROUP BY 1""")
def refilled_slots(spark, d):
    """Slots of a table filled with unseen expressions of their tier by rounds of draws, and the checks of all their records."""
    slots, seen = _slots(spark, d)
    folder = run.scratch(spark)
    seen = run.written(seen, f"{folder}/seen")
    filled = run.written(generate.refilled(slots, seen, "id", 11, folder), f"{folder}/filled")
    rows = run.written(generate.records(filled, slots=True), f"{folder}/records")
    replayed = checks.replay(rows).select("id", ((C("whole") != "valid_correct") | (C("cut") != "invalid_correct")).alias("bad"))
    met = filled.select("id", "expression").join(seen.withColumn("met", F.lit(True)), "expression", "left").select("id", "met")
    judged = rows.select("id", "expression", C("tier").alias("own_tier"), F.size(checks.record_violations()).alias("v"), checks.ood_violations(C("domain"), C("e")).alias("ood"))
    every = slots.join(judged, "id", "left").join(replayed, "id", "left").join(met, "id", "left")
    return every.groupBy("tier").agg(
        F.countDistinct("id").alias("n_slots"), F.count("expression").alias("n_filled"), F.countDistinct("expression").alias("n_expressions"), F.count_if("met").alias("n_seen"),
        F.count_if(C("tier") != C("own_tier")).alias("n_other_tier"), F.count_if(C("v") > 0).alias("violations"), F.count_if(C("ood").isNotNull()).alias("ood_violations"), F.count_if("bad").alias("replay_failures"))


@query("""WITH c AS (SELECT c_mktsegment AS stage, CASE WHEN c_custkey % 10 < 1 THEN 'length' WHEN c_custkey % 10 < 3 THEN 'negative' WHEN c_custkey % 10 < 4 THEN 'float' ELSE 'id' END AS domain, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey),
e AS (SELECT domain, count(*) AS n FROM c WHERE domain <> 'id' GROUP BY 1)
SELECT domain, n, 0::BIGINT AS repeated, 0::BIGINT AS ood_violations, 0::BIGINT AS useless FROM e""")
def domain_splits(spark, d):
    """A split of every other domain as large as its rows of orders, of useful expressions that no earlier one and no line item has."""
    kind = F.when(C("c_custkey") % 10 < 1, "length").when(C("c_custkey") % 10 < 3, "negative").when(C("c_custkey") % 10 < 4, "float")
    wanted = table(spark, d, "orders").join(table(spark, d, "customer"), C("o_custkey") == C("c_custkey")).select(C("o_orderkey").cast("string").alias("id"), kind.alias("domain")).where("domain is not null")
    folder, parts = run.scratch(spark), []
    seen = run.written(_slots(spark, d)[1], f"{folder}/seen")
    for domain in ("length", "negative", "float"):
        # Domains take turns, each with what those before it took among the seen; longer expressions leave room in every domain.
        slots = wanted.where(C("domain") == domain).select("id", F.lit("hard").alias("tier"))
        got = run.written(generate.refilled(slots, seen, domain, 5, f"{folder}/{domain}"), f"{folder}/{domain}-all")
        parts.append(got)
        seen = seen.unionByName(got.select("expression"))
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    often = every.groupBy("expression").agg(F.count("*").alias("times"))
    judged = every.join(often, "expression").select("domain", "times", checks.ood_violations(C("domain"), C("e")).alias("ood"), X.is_useful(C("e")).alias("useful"))
    return judged.groupBy("domain").agg(F.count("*").alias("n"), F.count_if(C("times") > 1).alias("repeated"), F.count_if(C("ood").isNotNull()).alias("ood_violations"), F.count_if(~C("useful")).alias("useless"))


@query(f"""WITH s AS ({_SLOTS}), cells AS (SELECT stage, tier AS domain, count(*) AS n FROM s GROUP BY ALL),
hashed AS (SELECT sum(('0x' || sha256('{{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '"}}')[1:15])::BIGINT::HUGEINT) AS h, count(*) AS n FROM customer)
SELECT '{{"name":"mix","seed":7,"rows":' || (SELECT count(*) FROM s) || ',"composition":[' || (SELECT string_agg('{{"stage":"' || stage || '","domain":"' || domain || '","n":' || n || '}}', ',' ORDER BY stage, domain) FROM cells)
  || '],"sources":[{{"name":"customer","rows":' || n || ',"fingerprint":"' || h || '"}}]}}' AS manifest FROM hashed""")
def mix_manifest(spark, d):
    """The manifest of a mixture, with the fingerprint of the table that it was made from."""
    slots, _ = _slots(spark, d)
    source = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return checks.manifest(slots.select("stage", C("tier").alias("domain")), "mix", 7, {"customer": (source, "c_custkey")})


@query("""WITH rows AS (SELECT doc_id // 64 AS node, count(*) AS n, count(*) FILTER (WHERE doc_id % 97 = 5) AS gone, count(*) FILTER (WHERE doc_id % 101 = 7 AND doc_id % 97 <> 5) AS other, count(*) FILTER (WHERE doc_id % 211 = 9 AND doc_id % 97 <> 5) AS again FROM documents GROUP BY 1)
SELECT node * 64 AS low, (node + 1) * 64 AS high, n AS n_before, n - gone + again AS n_after FROM rows WHERE gone + other + again > 0""")
def changed_ranges(spark, d):
    """Documents saved and loaded again, as they were and with rows lost, changed and repeated; the ranges of keys that differ, found from two hash trees."""
    folder, docs = run.scratch(spark), table(spark, d, "documents")
    k = C("doc_id")
    edited = docs.where(k % 97 != 5).withColumn("n_chars", C("n_chars") + F.when(k % 101 == 7, 1).otherwise(0))
    edited = edited.unionByName(edited.where(k % 211 == 9))
    trees = []
    for name, rows in (("before", docs), ("after", edited)):
        saved = run.written(rows, f"{folder}/{name}")
        trees.append(run.written(hashing.hash_tree(saved, "doc_id", 64), f"{folder}/{name}-tree"))
    again = run.written(hashing.hash_tree(spark.read.parquet(f"{folder}/before"), "doc_id", 64), f"{folder}/again-tree")
    same = hashing.differing_ranges(trees[0], again, 64)
    found = hashing.differing_ranges(*trees, 64)
    # What was only saved and loaded differs nowhere; if it did, the rows would show here with a wrong count.
    return found.unionByName(same.withColumn("n_after", F.lit(-1).cast("long")))


@query("""WITH c AS (SELECT conv_id, sum(len(string_split(coalesce(text, ''), ' '))) AS n FROM conversations GROUP BY 1)
SELECT count(*) AS n_rows, sum(n)::BIGINT AS n_tokens, count(*) AS n_placed, sum(n)::BIGINT AS n_placed_tokens, 0::BIGINT AS n_overfull, 0::BIGINT AS n_gaps, true AS within_bound FROM c""")
def packed_sequences(spark, d):
    """The sequences of conversations packed into bins of 512 tokens, none cut; the words of a text stand for its tokens."""
    words = F.size(F.split(F.coalesce("text", F.lit("")), " "))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.sum(words).cast("long").alias("n"))
    bins = packing.packed(rows, "n", "conv_id", 512)
    filled = bins.groupBy("bin").agg(F.count("*").alias("rows"), F.sum("n").alias("tokens"))
    whole = filled.agg(
        F.sum("rows").alias("n_placed"), F.sum("tokens").alias("n_placed_tokens"), F.count_if((C("tokens") > 512) & (C("rows") > 1)).alias("n_overfull"),
        (F.max("bin") + 1 - F.count("*")).alias("n_gaps"), F.count_if(C("tokens") <= 512).alias("bins"), F.sum(F.when(C("tokens") <= 512, C("tokens"))).alias("inner"))
    # Best fit decreasing needs 11/9 of the best number of bins and one more; the tokens give a lower bound of that number, and rows above half a bin another.
    least = rows.agg(F.count("*").alias("n_rows"), F.sum("n").alias("n_tokens"), F.count_if(C("n").between(257, 512)).alias("large"))
    best = F.greatest(F.ceil(C("inner") / 512), C("large"))
    return least.join(whole, F.lit(True)).select("n_rows", "n_tokens", "n_placed", "n_placed_tokens", "n_overfull", "n_gaps", F.coalesce(C("bins") <= 1.5 * best + 1, F.lit(True)).alias("within_bound"))


@query("SELECT count(*) AS n, count(DISTINCT item_id) AS n_items FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def contained_items(spark, d):
    """Documents that hold a test item word for word, wherever it begins and however short it is."""
    return containment.contained(table(spark, d, "documents"), table(spark, d, "benchmark")).agg(F.count("*").alias("n"), F.countDistinct("item_id").alias("n_items"))
