"""Synthetic problems: seeded candidates by hash, rejection, de-duplication, records and replacement rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import expressions as X
from ..functions import transcripts
from ..streaming import run
from . import places
from .names import free
from .sampling import first_wins, ranked

DOMAINS = ("id", "length", "negative", "float")
#: Weights of + - * among 9 draws.
WEIGHTED = ["+", "+", "+", "-", "-", "*", "*", "*", "*"]
SYSTEM = "Work step by step and use the calculator for every operation."


def _draw(seed: int, key: Column, salt: str, i: Column, n: int | Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), key, F.lit(salt), i), F.lit(n)).cast("int")


#: The largest operand (in size) of a tier to begin with, and at most when its expressions run out.
HIGH, HIGHEST = 20, 320


def _operations(domain: str) -> tuple[int, int]:
    """The least number of operations of a domain, and how many numbers of them it has."""
    if domain not in DOMAINS:
        raise ValueError(domain)
    return (6, 3) if domain == "length" else (2, 4)


def _count(pos: Column, domain: str, seed: int) -> Column:
    low, span = _operations(domain)
    return _draw(seed, pos, f"{domain}:n", F.lit(0), span) + low


def expression_at(pos: Column, domain: str, seed: int, high: dict[str, int] | None = None) -> Column:
    """The candidate's expression, a function of seed, domain, pos and the largest operand of its tier alone."""
    salt, n = f"{domain}:", _count(pos, domain, seed)
    forced = F.pmod(F.xxhash64(F.lit(seed), pos, F.lit(salt + "f")), n + 1).cast("int")
    wide = {t: h for t, h in (high or {}).items() if h != HIGH}
    top = F.lit(HIGH)
    for name, h in wide.items():
        top = F.when(X.tier(n) == name, h).otherwise(top)

    def operand(i: Column) -> Column:
        whole = _draw(seed, pos, salt + "v", i, top - 1) + 2
        if domain == "negative":
            sign = F.when((i == forced) | (_draw(seed, pos, salt + "s", i, 2) == 1), -1).otherwise(1)
            return (whole * sign).cast("double")
        if domain == "float":
            half = _draw(seed, pos, salt + "h", i, 2 * top - 3) + 4
            odd = _draw(seed, pos, salt + "o", i, top - 2) * 2 + 5
            return F.when(i == forced, odd).otherwise(half) / F.lit(2.0)
        return whole.cast("double")

    ops = F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at(F.array(*map(F.lit, WEIGHTED)), _draw(seed, pos, salt + "op", i, len(WEIGHTED)) + 1))
    return X.expression(F.transform(F.sequence(F.lit(0), n), operand), ops)


def candidates(spark: SparkSession, count: int, domain: str, seed: int, start: int = 0, high: dict[str, int] | None = None, tiers: Sequence[str] | None = None) -> DataFrame:
    """pos, from start on, and expression of `count` candidates, a function of seed, domain, pos and high alone.

    id: 2 to 5 operations, operands 2 to 20; length: 6 to 8 operations; negative: operands of either sign, one at
    least below zero; float: halves from 2 to 20, one at least not whole. high: another largest operand by tier.
    tiers: only the candidates of these.
    """
    _operations(domain)
    pos = F.col("pos")
    rows = spark.range(start, start + count).select(F.col("id").alias("pos"))
    if tiers is not None:
        rows = rows.where(X.tier(_count(pos, domain, seed)).isin(list(tiers)))
    return rows.select("pos", expression_at(pos, domain, seed, high).alias("e"))


def _useful(rows: DataFrame) -> DataFrame:
    """The useful of the candidates. As the variable of a function each is drawn once; a plain condition would draw it again for each of its terms."""
    return rows.select("pos", F.explode(F.filter(F.array("e"), lambda e: X.is_useful(e))).alias("e"))


def accepted(rows: DataFrame, domain: str) -> DataFrame:
    """Useful candidates with their text, trace and structure, the first of equal texts."""
    useful = _useful(rows).select("pos", "e", X.render(F.col("e")).alias("expression"))
    return first_wins(useful, ["expression"], "pos").withColumn("domain", F.lit(domain))


def records(rows: DataFrame, prefix: str = "problem_", slots: bool = False) -> DataFrame:
    """Full records of accepted candidates, numbered in order of acceptance; with slots they keep the id of the slot that they fill."""
    told = free(rows, "trace")
    rows = rows.withColumn(told, X.precedence_trace(F.col("e")))  # a column of its own, so it is worked out once
    e, shape, trace = F.col("e"), X.structure(F.col("e")), F.col(told)
    at = F.col("pos") if slots else F.row_number().over(Window.partitionBy("domain").orderBy("pos")) - 1
    name = F.col("id") if slots else F.concat(F.lit(prefix), F.col("domain"), F.lit("_"), F.lpad(at.cast("string"), 6, "0"))
    return rows.select(
        at.cast("long").alias("pos"), name.alias("id"), "domain", "expression", "e",
        trace["steps"].alias("steps"), trace["answer"].alias("final_answer"), X.left_to_right(e).alias("naive_left_to_right_answer"),
        F.size(e["operators"]).cast("long").alias("operation_count"), X.tier(F.size(e["operators"])).alias("tier"),
        shape["num_terms"].cast("long").alias("num_terms"), shape["max_factors"].cast("long").alias("max_factors_in_a_term"),
        transcripts.build(F.lit(SYSTEM), F.col("expression"), trace["steps"], trace["answer"], F.col("pos")).alias("messages"),
    )


def exactly(df: DataFrame, count: int, order: str) -> DataFrame:
    """The first `count` rows; an error when there are fewer."""
    short = df.agg(F.count("*").alias("__n")).select(F.when(F.col("__n") < count, F.raise_error(F.lit("too few candidates")).cast("boolean")).otherwise(True).alias("__ok"))
    return df.orderBy(order).limit(count).crossJoin(F.broadcast(short)).where("__ok").drop("__ok")


def unseen(rows: list[DataFrame], seen: DataFrame | None = None) -> DataFrame:
    """Accepted candidates of several domains; of an expression that occurs in more than one the first domain keeps it."""
    ranked = None
    for k, r in enumerate(rows):
        one = r.withColumn("__d", F.lit(k))
        ranked = one if ranked is None else ranked.unionByName(one)
    names = [c for c in ranked.columns if c != "expression"]
    first = ranked.groupBy("expression").agg(F.min_by(F.struct(*names), F.struct("__d", "pos")).alias("r")).select("expression", "r.*").drop("__d")
    return first if seen is None else first.join(seen.select("expression"), "expression", "left_anti")


def replacements(slots: DataFrame, pool: DataFrame, seed: int) -> DataFrame:
    """For each slot (id, tier) an accepted candidate of its tier, each used once; a slot without one is an error."""
    by_tier = Window.partitionBy("tier")
    want = slots.withColumn("__r", F.row_number().over(by_tier.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id")), 256), "id")))
    have = pool.withColumn("tier", X.tier(F.size(F.col("e")["operators"]))).withColumn("__r", F.row_number().over(by_tier.orderBy("pos", "expression")))
    joined = want.join(have.select("tier", "__r", F.col("expression").alias("replacement_expression"), "domain"), ["tier", "__r"], "left")
    bad = F.raise_error(F.concat(F.lit("no candidate for "), F.col("id"))).cast("boolean")
    return joined.where(F.when(F.col("replacement_expression").isNull(), bad).otherwise(True)).drop("__r")


def refilled(slots: DataFrame, seen: DataFrame, domain: str, seed: int, folder: str, per_slot: int = 20_000, spare: int = 8) -> DataFrame:
    """Every slot (id, tier) with an accepted candidate of its tier whose expression is neither in seen (expression) nor in another slot: id, tier, expression, e, pos, domain.

    Rounds of draws until no slot is open. The first draws as many candidates as there are slots (and some thousands), the later ones
    as many as the open slots need at the share of the draws that came to new expressions, `spare` for each open slot at most. A round rejects
    those that aren't useful, are of another tier, were seen or are taken, and gives the rest out by tier, slots in the order of
    a shuffle by seed and candidates in the order of their draws. A tier whose share of new expressions falls to half has few left: its
    largest operand is doubled, from HIGH up to HIGHEST. An error when per_slot draws for each slot have left slots open.
    Each round is a written table in folder, which must be shared; only numbers by tier come to the driver. Ids must
    be unique; a slot with a null tier, or one that the domain doesn't have, can't be filled and is an error before any draw.
    """
    spark = slots.sparkSession
    low, span = _operations(domain)
    able = {"easy" if n == 2 else "medium" if n < 5 else "hard" for n in range(low, low + span)}
    open_ = run.written(slots.select(F.col("id").cast("string").alias("id"), "tier"), f"{folder}/open-0")
    taken, drawn, number, rounds = None, 0, 0, []
    total, high, best, rate = open_.count(), dict.fromkeys(able, HIGH), {}, {}
    while left := {r["tier"]: r["n"] for r in open_.groupBy("tier").agg(F.count("*").alias("n")).collect()}:
        many = sum(left.values())
        needed = max(ceil(1.1 * n / rate[t]) if rate.get(t) else many for t, n in left.items())
        count = min(min(needed, many * spare) + 4000, per_slot * total - drawn)
        if count <= 0 or set(left) - able:
            raise ValueError(f"slots without a candidate after {drawn} draws: {left}")
        number += 1
        drawn_now = _useful(candidates(spark, count, domain, seed, drawn, high, sorted(left)))
        pool = drawn_now.select("pos", X.render(F.col("e")).alias("expression"), X.tier(F.size(F.col("e")["operators"])).alias("tier"))
        pool = pool.groupBy("expression", "tier").agg(F.min("pos").alias("pos")).join(seen.select("expression"), "expression", "left_anti")
        if taken is not None:
            pool = pool.join(taken, "expression", "left_anti")
        pool = run.written(pool, f"{folder}/pool-{number}")
        found = {r["tier"]: r["n"] / count for r in pool.groupBy("tier").agg(F.count("*").alias("n")).collect()}
        have = places.running(pool, ["tier"], ["pos"], {"draw": F.lit(1).cast("long")}).drop("draw_all")
        want = ranked(open_, "tier", "id", f"{seed}:{number}")
        # The expression is drawn again from its place, so that the pool carries texts only.
        e = expression_at(F.col("pos"), domain, seed, high).alias("e")
        filled = run.written(want.join(have, ["tier", "draw"]).select("id", "tier", "expression", e, "pos", F.lit(domain).alias("domain")), f"{folder}/filled-{number}")
        rounds.append(filled)
        taken = filled.select("expression") if taken is None else taken.unionByName(filled.select("expression"))
        open_ = run.written(open_.join(filled.select("id"), "id", "left_anti"), f"{folder}/open-{number}")
        drawn += count
        for t in left:
            rate[t], best[t] = found.get(t, 0), max(best.get(t, 0), found.get(t, 0))
            if rate[t] < best[t] / 2 and high[t] < HIGHEST:
                high[t], rate[t] = high[t] * 2, best[t]
    if not rounds:
        return open_.select("id", "tier", F.lit("").alias("expression"), F.lit(None).cast("struct<operands: array<double>, operators: array<string>>").alias("e"), F.lit(0).cast("long").alias("pos"), F.lit(domain).alias("domain"))
    return reduce(DataFrame.unionByName, rounds)
