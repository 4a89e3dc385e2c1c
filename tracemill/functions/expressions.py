"""Arithmetic expressions as columns: struct<operands: array<double>, operators: array<string>>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"-?\d+(?:\.\d+)?|[+*-]"
NUMBER = r"^-?\d+(?:\.\d+)?$"
OPERATORS = ("+", "-", "*")


def expression(operands: Column, operators: Column) -> Column:
    return F.struct(operands.cast("array<double>").alias("operands"), operators.alias("operators"))


def calculate(op: Column, a: Column, b: Column) -> Column:
    """a op b for + - *; any other operator is an error when it is met."""
    return (
        F.when(op == "+", a + b).when(op == "-", a - b).when(op == "*", a * b)
        .otherwise(F.raise_error(F.concat(F.lit("unsupported operation: "), F.coalesce(op, F.lit("null")))).cast("double"))
    )


def number_text(x: Column) -> Column:
    """A number as it is written: whole numbers without a fraction."""
    return F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(x.cast("string"))


def _pairs(e: Column) -> Column:
    """(op, right operand n) of each operation in order."""
    return F.transform(e["operators"], lambda op, i: F.struct(op.alias("op"), F.get(e["operands"], i + 1).alias("n")))


def render(e: Column) -> Column:
    """The expression as text: * without blanks, + and - with one on either side."""
    part = lambda s, x: F.concat(s, F.when(x["op"] == "*", "*").otherwise(F.concat(F.lit(" "), x["op"], F.lit(" "))), number_text(x["n"]))
    return F.aggregate(_pairs(e), number_text(F.get(e["operands"], F.lit(0))), part)


def left_to_right(e: Column) -> Column:
    """The value without regard to precedence."""
    return F.aggregate(_pairs(e), F.get(e["operands"], F.lit(0)), lambda s, x: calculate(x["op"], s, x["n"]))


STEP = "struct<op: string, a: double, b: double, result: double, stage: string>"


def precedence_trace(e: Column) -> Column:
    """struct<steps, answer>: products from left to right (stage precedence), then sums (stage combine)."""
    def add(steps: Column, op: Column, a: Column, b: Column, stage: str) -> Column:
        step = F.struct(op.alias("op"), a.alias("a"), b.alias("b"), calculate(op, a, b).alias("result"), F.lit(stage).alias("stage"))
        return F.concat(steps, F.array(step.cast(STEP)))

    empty = F.array().cast(f"array<{STEP}>")
    first = F.get(e["operands"], F.lit(0))
    # Terms so far as (operator before, value); the last term takes products.
    start = F.struct(empty.alias("steps"), F.array().cast("array<struct<op: string, n: double>>").alias("terms"), F.lit("+").alias("op"), first.alias("n"))

    def product(s: Column, x: Column) -> Column:
        held = F.struct(s["op"].alias("op"), s["n"].alias("n"))
        times = F.struct(add(s["steps"], x["op"], s["n"], x["n"], "precedence").alias("steps"), s["terms"].alias("terms"), s["op"].alias("op"), (s["n"] * x["n"]).alias("n"))
        other = F.struct(s["steps"].alias("steps"), F.concat(s["terms"], F.array(held)).alias("terms"), x["op"].alias("op"), x["n"].alias("n"))
        return F.when(x["op"] == "*", times).otherwise(other)

    close = lambda s: F.struct(s["steps"].alias("steps"), F.concat(s["terms"], F.array(F.struct(s["op"].alias("op"), s["n"].alias("n")))).alias("terms"))
    products = F.aggregate(_pairs(e), start, product, close)

    def total(p: Column) -> Column:
        begin = F.struct(p["steps"].alias("steps"), F.get(p["terms"], F.lit(0))["n"].alias("n"))
        add_term = lambda s, t: F.struct(add(s["steps"], t["op"], s["n"], t["n"], "combine").alias("steps"), calculate(t["op"], s["n"], t["n"]).alias("n"))
        return F.aggregate(
            F.slice(p["terms"], F.lit(2), F.greatest(F.size(p["terms"]) - 1, F.lit(0))), begin, add_term,
            lambda s: F.struct(s["steps"].alias("steps"), s["n"].alias("answer")),
        )

    return F.get(F.transform(F.array(products), total), F.lit(0))


def structure(e: Column) -> Column:
    """struct<num_terms, max_factors>: terms of the sum and the factors of the largest."""
    runs = F.aggregate(
        e["operators"], F.struct(F.lit(1).alias("now"), F.lit(1).alias("most")),
        lambda s, op: F.struct(
            F.when(op == "*", s["now"] + 1).otherwise(1).alias("now"),
            F.when(op == "*", F.greatest(s["most"], s["now"] + 1)).otherwise(s["most"]).alias("most"),
        ),
    )
    return F.struct((F.size(F.filter(e["operators"], lambda x: x != "*")) + 1).alias("num_terms"), runs["most"].alias("max_factors"))


def structure_of_text(text: Column) -> Column:
    """The same from the expression as text."""
    terms = F.split(F.replace(text, F.lit(" - "), F.lit(" + ")), r" \+ ")
    return F.struct(F.size(terms).alias("num_terms"), F.array_max(F.transform(terms, lambda t: F.size(F.split(t, r"\*")))).alias("max_factors"))


def tier(operation_count: Column) -> Column:
    """easy for 2 operations, medium below 5 (0 and 1 included), hard from 5."""
    return F.when(operation_count == 2, "easy").when(operation_count < 5, "medium").otherwise("hard")


def tokens(text: Column) -> Column:
    """Numbers and operators of an expression's text; a minus right before a digit belongs to the number."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def extent(e: Column) -> Column:
    """struct<answer, most>: the answer with precedence and the greatest size of a step's result, without the steps; most is null without any."""
    none = F.lit(None)
    # Sum of the terms so far, null before the first has ended, the operator before the last term (null: the first) and its value.
    start = F.struct(none.cast("double").alias("total"), none.cast("string").alias("op"), F.get(e["operands"], F.lit(0)).alias("n"), none.cast("double").alias("most"))
    closed = lambda s: F.when(s["op"].isNull(), s["n"]).otherwise(calculate(s["op"], s["total"], s["n"]))
    once = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))

    def step(s: Column, x: Column) -> Column:
        times = once(s["n"] * x["n"], lambda n: F.struct(s["total"].alias("total"), s["op"].alias("op"), n.alias("n"), F.greatest(s["most"], F.abs(n)).alias("most")))
        other = once(closed(s), lambda t: F.struct(t.alias("total"), x["op"].alias("op"), x["n"].alias("n"), F.when(s["op"].isNull(), s["most"]).otherwise(F.greatest(s["most"], F.abs(t))).alias("most")))
        return F.when(x["op"] == "*", times).otherwise(other)

    end = lambda s: once(closed(s), lambda t: F.struct(t.alias("answer"), F.when(s["op"].isNull(), s["most"]).otherwise(F.greatest(s["most"], F.abs(t))).alias("most")))
    return F.aggregate(_pairs(e), start, step, end)


def is_useful(e: Column, limit: float = 100_000, trace: Column | None = None) -> Column:
    """Precedence matters, and the answer and every intermediate result are within the limit. trace: that of e, where it is there already."""
    within = lambda t: (left_to_right(e) != t["answer"]) & (F.abs(t["answer"]) <= limit) & F.forall(t["steps"], lambda s: F.abs(s["result"]) <= limit)
    mixed = F.array_contains(e["operators"], "*") & F.exists(e["operators"], lambda x: x != "*")
    if trace is not None:
        return mixed & within(trace)
    bounded = lambda t: (left_to_right(e) != t["answer"]) & (F.abs(t["answer"]) <= limit) & (t["most"] <= limit)
    return mixed & F.get(F.transform(F.array(extent(e)), bounded), F.lit(0))
