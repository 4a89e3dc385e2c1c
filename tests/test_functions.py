import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracemill.functions import expressions as X
from tracemill.functions import hashing, parsing, trace, transcripts
from tracemill.operators import rollouts

CALLS = "array<struct<op string, a double, b double>>"


def calls(*rows):
    return [(op, float(a), float(b)) for op, a, b in rows]


#: Fixed values.
GOLDEN = [
    ("2+3*4", calls(("*", 3, 4), ("+", 2, 12)), 14.0, 2, 14.0, "valid_correct", None, 2.0),
    ("2+3*4", calls(("*", 3, 4), ("+", 2, 12)), 13.0, 2, 14.0, "valid_incorrect", None, 0.0),
    ("2+3*4", calls(("+", 2, 3), ("*", 5, 4)), 14.0, 2, 14.0, "invalid_correct", "precedence_violation", 0.0),
    ("2+3*4", calls(("+", 2, 3), ("*", 5, 4)), 20.0, 2, 14.0, "invalid_incorrect", "precedence_violation", -1.0),
    ("2+3*4", calls(("*", 3, 4), ("+", 2, 12)), None, 2, 14.0, "no_answer", None, -0.1),
    ("2+3", calls(("+", 3, 2)), 5.0, 1, 5.0, "valid_correct", None, 2.0),
    ("2+3", calls(("+", 2, 3), ("+", 5, 0)), 5.0, 1, 5.0, "invalid_correct", "post_completion_call", 0.0),
    ("2*3+4*5", calls(("*", 4, 5), ("*", 2, 3), ("+", 6, 20)), 26.0, 3, 26.0, "valid_correct", None, 2.0),
    ("2+3+4", calls(("+", 3, 4)), 9.0, 2, 9.0, "invalid_correct", "branch_mismatch", 0.0),
    ("2*3+4", calls(("*", 2, 3), ("+", 2, 3)), 10.0, 2, 10.0, "invalid_correct", "reused_operand", 0.0),
    ("5-3", calls(("-", 5, 3)), 2.0, 1, 2.0, "invalid_correct", "ungrounded_operand", 0.0),
    ("5 - 3", calls(("-", 5, 3)), 2.0, 1, 2.0, "valid_correct", None, 2.0),
    ("5 - 3", [], 2.0, 1, 2.0, "invalid_correct", None, 0.0),
    ("5 - 3", None, 2.0, 1, 2.0, "invalid_correct", None, 0.0),
]


def test_golden_trajectories(spark):
    df = spark.createDataFrame([(i, *g) for i, g in enumerate(GOLDEN)], f"i int, e string, c {CALLS}, stated double, n int, ans double, outcome string, reason string, reward double")
    got = df.select("*", trace.score(F.col("e"), F.col("c"), F.col("stated"), F.col("n"), F.col("ans")).alias("s")).collect()
    for r in got:
        assert (r.s.outcome, r.s.first_illegal_reason, r.s.reward) == (r.outcome, r.reason, r.reward), r


def _reductions(terms):
    """Each step that an expression allows, and the expression after it. terms: (sign, factors) of a sum of products."""
    value = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b}
    for k, (sign, factors) in enumerate(terms):
        for i, (a, b) in enumerate(zip(factors, factors[1:])):
            yield "*", a, b, (*terms[:k], (sign, (*factors[:i], a * b, *factors[i + 2 :])), *terms[k + 1 :])
    if len(terms) > 1 and all(len(factors) == 1 for _, factors in terms):
        (_, (a,)), (op, (b,)) = terms[:2]
        yield op, a, b, (("+", (value[op](a, b),)), *terms[2:])


def _expected(terms, calls, stated, answer):
    """(outcome, legal calls, index and class of the first illegal one) by following every order of reduction to its end."""
    deepest, there = 0, {terms}
    todo = [(terms, 0)]
    while todo:
        now, depth = todo.pop()
        if depth > deepest:
            deepest, there = depth, set()
        if depth == deepest:
            there.add(now)
        if depth < len(calls):
            op, a, b = calls[depth]
            todo += [(after, depth + 1) for o, x, y, after in _reductions(now) if o == op and ((x, y) == (a, b) or op in "+*" and (y, x) == (a, b))]
    numbers = lambda s: Counter(x for _, factors in s for x in factors)
    reason = None
    if deepest < len(calls):
        op, a, b = calls[deepest]
        grounded = set(numbers(terms)) | {{"+": x + y, "-": x - y, "*": x * y}[o] for o, x, y in calls[:deepest]}
        if any(sum(numbers(s).values()) == 1 for s in there):
            reason = "post_completion_call"
        elif op in "+-" and any(len(factors) > 1 for s in there for _, factors in s):
            reason = "precedence_violation"
        elif any(not Counter([a, b]) - numbers(s) for s in there):
            reason = "branch_mismatch"
        else:
            reason = "reused_operand" if {a, b} <= grounded else "ungrounded_operand"
    valid = reason is None and len(calls) == sum(numbers(terms).values()) - 1 and (("+", (answer,)),) in there
    outcome = "no_answer" if stated is None else ("valid" if valid else "invalid") + ("_correct" if stated == answer else "_incorrect")
    return outcome, deepest, deepest + 1 if reason else None, reason


def test_random_trajectories(spark):
    rng, rows = random.Random(4), []
    for i in range(1500):
        terms, text = [], ""
        for k in range(rng.randint(1, 4)):
            sign, factors = rng.choice("+-") if k else "+", tuple(float(rng.randint(1, 4)) for _ in range(rng.choice([1, 1, 2, 3])))
            terms.append((sign, factors))
            text += (f" {sign} " if k else "") + "*".join(str(int(x)) for x in factors)
        terms, calls, now = tuple(terms), [], tuple(terms)
        while steps := list(_reductions(now)):
            op, a, b, now = rng.choice(steps)
            calls.append((op, a, b) if op == "-" or rng.random() < 0.7 else (op, b, a))
        answer = now[0][1][0]
        spoil = rng.random()
        if calls and spoil < 0.35:
            k = rng.randrange(len(calls))
            calls[k] = (rng.choice("+-*"), rng.choice([calls[k][1], float(rng.randint(1, 9))]), rng.choice([calls[k][2], float(rng.randint(1, 4))]))
        elif calls and spoil < 0.5:
            rng.shuffle(calls)
        elif calls and spoil < 0.65:
            calls.insert(rng.randrange(len(calls) + 1), rng.choice(calls))
        elif spoil < 0.75:
            calls = calls[:-1]
        stated = rng.choice([answer, answer, answer + 1, None])
        rows.append((i, text, calls, stated, sum(len(f) for _, f in terms) - 1, answer, *_expected(terms, calls, stated, answer)))
    df = spark.createDataFrame(rows, f"i int, e string, c {CALLS}, stated double, n int, answer double, outcome string, legal int, at int, reason string")
    got = df.select("*", trace.score(F.col("e"), F.col("c"), F.col("stated"), F.col("n"), F.col("answer")).alias("s")).collect()
    for r in got:
        assert (r.s.outcome, r.s.legal_call_count, r.s.first_illegal_call_index, r.s.first_illegal_reason) == (r.outcome, r.legal, r.at, r.reason), r
    assert {r.reason for r in got} == {None, "post_completion_call", "precedence_violation", "branch_mismatch", "reused_operand", "ungrounded_operand"}


def test_signs_in_odd_places(spark):
    """A number where an operator belongs is no operand."""
    df = spark.createDataFrame([("5-3", calls(("+", 5, -3)))], f"e string, c {CALLS}")
    assert df.select(trace.score(F.col("e"), F.col("c"), F.lit(2.0), F.lit(1), F.lit(2.0))["first_illegal_reason"]).first()[0] == "ungrounded_operand"


def test_shaping_modes(spark):
    row = spark.createDataFrame([("2+3*4", calls(("*", 3, 4)), 14.0)], f"e string, c {CALLS}, stated double")
    s = row.select(trace.score(F.col("e"), F.col("c"), F.col("stated"), F.lit(2), F.lit(14.0)).alias("s"))
    shaped = lambda **m: s.select(trace.shaped_reward(F.col("s"), F.lit(2), **m)["reward"]).first()[0]
    assert shaped(strict=True) == pytest.approx(-0.9)
    assert shaped(max_bonus=0.1) == pytest.approx(0.05)
    assert shaped(binary=True) == 0.0
    assert shaped() == 0.0
    with pytest.raises(ValueError):
        trace.shaped_reward(F.col("s"), F.lit(2), strict=True, binary=True)


def test_tool_calls(spark):
    tag = lambda x: f"<tool_call>{x}</tool_call>"
    full = '{"name":"calculator","arguments":{"op":"+","a":%s,"b":%s}}'
    cases = {
        "nothing": None, "<tool_call> x": "unclosed_tool_call", tag(full % (1, 2)) * 2: "multiple_tool_calls_in_one_turn", tag("{bad"): "malformed_tool_call",
        tag('{"name":"calculator"}'): "malformed_tool_call", tag("[1]"): "malformed_tool_call", tag((full % (1, 2)).replace("calculator", "x")): "wrong_tool_name",
        tag('{"name":"calculator","arguments":{"op":"+","a":1}}'): "wrong_argument_schema", tag((full % (1, 2)).replace('"+"', '"/"')): "invalid_operator",
        tag(full % ("true", 2)): "non_numeric_operand", tag(full % ('"1"', 2)): "non_numeric_operand", tag(full % (1.5, -2)): None,
    }
    df = spark.createDataFrame([(t, e) for t, e in cases.items()], "t string, e string")
    for r in df.select("*", parsing.tool_call(F.col("t")).alias("p"), parsing.tool_call(F.col("t"), dialect="integer").alias("q")).collect():
        assert r.p.error == r.e, r
        if "1.5" in r.t:
            assert (r.p.call.a, r.p.call.b) == (1.5, -2.0) and r.q.error == "non_integer_operand"


def test_odd_tool_calls(spark):
    """Arguments of every kind, repeated keys, numbers beyond JSON and texts that are nearly JSON."""
    of = lambda arguments, name='"calculator"': f'{{"name": {name}, "arguments": {arguments}}}'
    good = of('{"op":"+","a":1,"b":2}')
    malformed, schema = "malformed_tool_call", "wrong_argument_schema"
    cases = {
        of("5"): malformed, of("null"): malformed, of("true"): malformed, of('["op","a","b"]'): malformed, of('["op","a"]'): schema, of('[["op"],"a","b"]'): malformed,
        of('"abc"'): schema, of("{}"): schema, of('{"op":["+"],"a":1,"b":2}'): malformed, of('{"op":{},"a":1,"b":2}'): malformed, of('{"op":3,"a":1,"b":2}'): "invalid_operator",
        of('{"op":"-","op":"+","a":"x","a":7,"b":2}'): None, of('{"op":"+","a":NaN,"b":-Infinity}'): None, of('{"op":"+","a":1e3,"b":12345678901234567890}'): None,
        good + " x": malformed, good + "}": malformed, good[:-1]: malformed, good[:-1] + ",}": malformed, "[1]": malformed, "5": malformed, "": malformed,
        '{"arguments":{"op":"+","a":1,"b":2}}': malformed, of('{"op":"+","a":1,"b":2}', "null"): "wrong_tool_name", of("5", '"z"'): "wrong_tool_name",
        '{"name":"x",' + good[1:]: None, of('{"op":"+","a":01,"b":2}'): malformed, of("{'op':'+','a':1,'b':2}"): malformed, of('{"op":"+","a":1,"b":2,"c":3}'): schema,
    }
    df = spark.createDataFrame([(f"<tool_call>{t}</tool_call>", e) for t, e in cases.items()], "t string, e string")
    for r in df.select("*", parsing.tool_call(F.col("t")).alias("p")).collect():
        assert r.p.error == r.e and (r.p.call is None) == (r.e is not None), r


def test_canonical_json(spark):
    numbers = [5e-06, 12345678.0, 0.0001, 1e-5, 0.001, 1e16, 1e15, 123456789012345680.0, 0.1, -0.0, 1.5e300, -2.5e-9, 100.0, 1e7, float("inf"), float("nan"), 0.0, 9999999.5]
    texts = ["a\x1fb\n\"\\ é\x7f /\t\x0b", "\\u001F", "plain", ""]
    rows = [(x, t, [x, None], {"b": 1, "a": None}) for x in numbers for t in texts]
    df = spark.createDataFrame(rows, "x double, `é` string, l array<double>, m map<string,int>")
    for r in df.select("*", hashing.canonical_json(F.struct(*df.columns), df.schema).alias("j")).collect():
        assert r.j == json.dumps({"x": r.x, "é": r["é"], "l": r.l, "m": r.m}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_final_answers(spark):
    cases = {
        "The answer is 5. The answer is: 7": 7.0, "result of x is $3$": 3.0, "\\boxed{ 4 } and final: 9": 4.0, " 12.5. ": 12.5, "final answer = -3": -3.0,
        "final: 2 so the answer is 8": 8.0, "no number": None, "": None,
        "answer is\xa05": 5.0, "the answer is ٣": 3.0, "\u3000７\u3000": 7.0,
    }
    df = spark.createDataFrame(list(cases.items()), "t string, a double")
    assert all(r.a == r.got for r in df.select("a", parsing.final_answer(F.col("t")).alias("got")).collect())


def test_expressions(spark):
    e = X.expression(F.array(*map(F.lit, (14.0, 18.0, 7.0, 2.5))), F.array(*map(F.lit, "-*+")))
    r = spark.range(1).select(X.render(e).alias("t"), X.left_to_right(e).alias("l"), X.precedence_trace(e).alias("p"), X.structure(e).alias("s")).first()
    assert (r.t, r.l, r.p.answer, r.s.num_terms, r.s.max_factors) == ("14 - 18*7 + 2.5", -25.5, -109.5, 3, 2)
    assert [s.stage for s in r.p.steps] == ["precedence", "combine", "combine"]


def test_prompt_completion_and_labels(spark):
    talks = [
        [("system", [1]), ("user", [2, 3]), ("assistant", [4, 5]), ("user", [6]), ("assistant", [7, 8]), ("user", [9])],
        [("assistant", [4])], [("user", [1, 2])], [("user", []), ("assistant", [])], [], None,
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(talks)], "i int, m array<struct<role: string, ids: array<int>>>")
    got = df.select("i", transcripts.prompt_completion(F.col("m")).alias("c"), transcripts.assistant_labels(F.col("m")).alias("x")).orderBy("i").collect()
    for t, r in zip(talks, got):
        at = [k for k, (role, _) in enumerate(t or []) if role == "assistant"]
        assert (r.c is None) == (not at)
        if at:
            assert ([tuple(x) for x in r.c.prompt], [tuple(x) for x in r.c.completion]) == (t[: at[-1]], [t[at[-1]]])
        if t is not None:
            flat = [(x, role == "assistant") for role, ids in t for x in ids]
            assert r.x.input_ids == [x for x, _ in flat]
            assert r.x.labels == [x if own else transcripts.IGNORED for x, own in flat[1:]] + [transcripts.IGNORED] * bool(flat)


def test_case_line(spark):
    rows = [("hard", 12, "x" * 40, 0.5, None, None, None, 0), ("easy", 2, "1 + 2*3", 7.0, 9.0, False, True, 2)]
    df = spark.createDataFrame(rows, "tier string, n int, e string, answer double, stated double, correct boolean, valid boolean, calls int")
    got = [r[0] for r in df.select(rollouts.case_line(*(F.col(c) for c in df.columns))).collect()]
    assert got == [f"[{'hard':>6}] ops=12  {'x' * 40}  expected={0.5:<8}  got={'None':<8}  ans={'wrong':<7}  trace={'invalid':<7}  calls=0/12",
        f"[{'easy':>6}] ops=2  {'1 + 2*3':<30}  expected={7:<8}  got={9:<8}  ans={'wrong':<7}  trace={'valid':<7}  calls=2/2"]


def test_json_strings_in_one_pass(spark):
    """Every character that needs an escape and some that don't, as Python's json writes them; only odd ones take the escapes one by one."""
    texts = [*(f"a{chr(c)}b" for c in (*range(0x30), 0x5C, 0x7F, 0x80, 0xE9, 0x2028, 0xFFFD, 0x1F600)), "", "[x]", "\\u0041 \\\\ \"q\"\n\r\t\f\b/", "\n" * 50 + "\x0b", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("i", hashing.json_string(F.col("t")).alias("j")).collect():
        assert r.j == (None if texts[r.i] is None else json.dumps(texts[r.i], ensure_ascii=False)), repr(texts[r.i])
    odd = spark.sql("SELECT cast(X'61FF' AS string) AS t UNION ALL SELECT cast(X'61FE' AS string)")
    assert odd.select(F.hex(hashing.json_string(F.col("t"))).alias("h")).distinct().count() == 2
    plan = df.select(hashing.json_string(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "to_json" in plan.lower()
