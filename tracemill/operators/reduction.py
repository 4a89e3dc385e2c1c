"""Scores of call sequences over a graph of reductions that all trajectories share.

A node is a state of an expression and an edge a call that leads from it to others. The graph grows by joins, a round for
each call: the states that trajectories are in meet their next calls, and what a call leads to from a state is worked out
once for all trajectories that make it there. A fold over each trajectory by itself carries its set of states instead, which
for a long expression that thousands of trajectories work on is the same work again and again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import trace
from ..streaming import run


def scored(df: DataFrame, id_: str, folder: str, expression: str = "expression", calls: str = "calls", stated: str = "stated", expected: str = "expected", answer: str = "answer") -> DataFrame:
    """id and score, what trace.score gives for each row of df.

    id_ tells rows apart. folder must be shared; each round writes its frontier (id and the key of a state) and its new
    nodes there. There are as many rounds as the longest trajectory has calls that are legal, and one more. States and calls
    are told apart by 64-bit hashes. An empty table has no rounds.
    """
    spark, put = df.sparkSession, lambda rows, name: run.written(rows, f"{folder}/{name}")
    rows = put(df.select(F.col(id_).alias("id"), trace.given(F.col(expression), F.col(calls), F.col(stated), F.col(expected), F.col(answer)).alias("x")), "trajectories")
    key = lambda state, stuck: F.xxhash64(state, stuck)
    start, stuck = F.col("x")["start"], F.col("x")["stuck"]
    nodes = put(rows.select(key(start, stuck).alias("node"), start.alias("state"), stuck.alias("stuck")).dropDuplicates(["node"]), "nodes-0")
    frontier, ends, known, number = put(rows.select("id", key(start, stuck).alias("node")), "frontier-0"), [], [nodes], 0
    while frontier.head(1):
        calls_ = rows.select("id", F.get(F.col("x")["calls"], F.lit(number)).alias("call"), (F.size(F.col("x")["calls"]) > number).alias("more"))
        at = frontier.join(calls_, "id").withColumn("call_key", F.xxhash64("call"))
        wanted = at.where("more").select("node", "call_key", "call").dropDuplicates(["node", "call_key"]).join(nodes, "node")
        to = F.transform(trace.next_states(F.array("state"), F.col("call"), F.col("stuck")), lambda s: F.struct(key(s, F.col("stuck")).alias("node"), s.alias("state"), F.col("stuck").alias("stuck")))
        edges = put(wanted.select("node", "call_key", F.explode(to).alias("to")), f"edges-{number}")
        moved = put(at.where("more").join(edges.select("node", "call_key", F.col("to.node").alias("to")), ["node", "call_key"]).select("id", F.col("to").alias("node")).distinct(), f"frontier-{number + 1}")
        # Trajectories without a further call end here, and so do those whose next call is illegal in all their states.
        stays = at.join(moved.select("id").distinct(), "id", "left_anti").select("id", "node", F.lit(number).alias("legal"), F.col("more").alias("bad"))
        ends.append(put(stays, f"ends-{number}"))
        nodes = put(edges.select("to.*").dropDuplicates(["node"]), f"nodes-{number + 1}")
        known.append(nodes)
        frontier, number = moved, number + 1
    if not ends:
        return rows.select("id", trace.judged(F.col("x"), F.struct(F.array(start).alias("states"), F.lit(0).alias("legal"), F.lit(False).alias("bad"))).alias("score"))
    every = reduce(DataFrame.unionByName, ends).join(reduce(DataFrame.unionByName, known).dropDuplicates(["node"]), "node")
    end = every.groupBy("id").agg(F.collect_list("state").alias("states"), F.first("legal").alias("legal"), F.first("bad").alias("bad"))
    return rows.join(end, "id").select("id", trace.judged(F.col("x"), F.struct("states", "legal", "bad")).alias("score"))
