"""Slots filled by rounds of draws, replay of scorers, hash trees and manifests."""

import json

import pytest
from pyspark.sql import functions as F

from tracemill.functions import expressions as X
from tracemill.functions import hashing, trace
from tracemill.operators import checks, generate, rollouts
from tracemill.streaming import run


def slots(spark, n):
    return spark.range(n).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 5 == 0, "easy").when(F.col("id") % 2 == 0, "medium").otherwise("hard").alias("tier"))


@pytest.mark.parametrize(("spare", "domain"), [(1, "id"), (1, "float"), (8, "negative")])
def test_refilled(spark, tmp_path, spare, domain):
    """Every slot has one useful expression of its tier that is new; few spare draws take several rounds."""
    seen = generate.accepted(generate.candidates(spark, 3000, domain, 4), domain).select("expression")
    want = slots(spark, 1500)
    got = generate.refilled(want, seen, domain, 4, str(tmp_path), spare=spare)
    rows = got.select("id", "tier", "expression", "pos", X.tier(F.size(F.col("e")["operators"])).alias("own"), X.is_useful(F.col("e")).alias("useful"), (X.render(F.col("e")) == F.col("expression")).alias("same")).collect()
    assert sorted((r.id, r.tier) for r in rows) == sorted(map(tuple, want.collect()))
    assert all(r.own == r.tier and r.useful and r.same for r in rows) and len({r.expression for r in rows}) == 1500
    assert not {r.expression for r in rows} & {r.expression for r in seen.collect()}
    again = generate.refilled(want.repartition(9), seen, domain, 4, str(tmp_path / "again"), spare=spare).collect()
    assert {(r.id, r.expression) for r in again} == {(r.id, r.expression) for r in rows}
    bad = generate.records(got, slots=True).where(F.size(checks.record_violations()) > 0)
    assert bad.count() == 0


def test_slots_that_cannot_be_filled(spark, tmp_path):
    seen = spark.createDataFrame([], "expression string")
    with pytest.raises(ValueError, match="easy"):
        generate.refilled(slots(spark, 20), seen, "length", 1, str(tmp_path), per_slot=300)
    with pytest.raises(ValueError, match="None"):
        generate.refilled(slots(spark, 3).withColumn("tier", F.lit(None).cast("string")), seen, "id", 1, str(tmp_path / "null"), per_slot=300)
    assert generate.refilled(slots(spark, 0), seen, "id", 1, str(tmp_path / "none")).count() == 0


def test_planned_score(spark):
    plan = [("*", 2.0, 3.0), ("+", 1.0, 6.0)]
    cases = [(plan, 7.0), (plan, 8.0), (plan, None), (plan[:1], 7.0), ([("*", 3.0, 2.0), plan[1]], 7.0), ([*plan, plan[0]], 7.0), (None, 1.0), ([], 7.0), ([plan[0], (None, 1.0, None)], 7.0)]
    df = spark.createDataFrame([(i, plan, c, s, 7.0) for i, (c, s) in enumerate(cases)], f"id int, plan array<{trace.CALL}>, calls array<{trace.CALL}>, stated double, answer double")
    s = df.select("id", trace.planned_score(F.col("plan"), F.col("calls"), F.col("stated"), F.col("answer")).alias("s")).select("id", "s.*").orderBy("id").collect()
    assert [(r.outcome, r.reward, r.legal_call_count, r.first_illegal_call_index) for r in s] == [
        ("valid_correct", 2.0, 2, None), ("valid_incorrect", 0.0, 2, None), ("no_answer", -0.1, 2, None), ("invalid_correct", 0.0, 1, None), ("invalid_correct", 0.0, 0, 1),
        ("invalid_correct", 0.0, 2, 3), ("invalid_incorrect", -1.0, 0, None), ("invalid_correct", 0.0, 0, None), ("invalid_correct", 0.0, 1, 2)]
    versions = {"a": F.struct(F.lit(1).alias("x"), F.col("stated").alias("y")), "b": F.struct(F.lit(1).alias("x"), F.when(F.col("id") < 3, F.col("stated")).alias("y"))}
    got = rollouts.replayed(df, "id", versions, ["x", "y"]).collect()
    assert sorted((r.id, r.field, r.before, r.after) for r in got) == [(i, "y", str(cases[i][1]), None) for i in range(3, 9)]


@pytest.mark.parametrize("edit", ["none", "lost", "changed", "repeated", "added", "null key"])
def test_hash_tree(spark, tmp_path, edit):
    """The differing ranges against a comparison of all rows by range, however rows lie in partitions."""
    df = spark.range(-700, 300_000, 37).select("id", (F.col("id") % 7).cast("string").alias("x"), F.when(F.col("id") % 5 > 0, F.col("id") / 3).alias("y"))
    at = F.col("id").isin(-700, -700 + 37 * 20, -700 + 37 * 4000)
    after = {
        "none": df, "lost": df.where(~at), "changed": df.withColumn("y", F.when(at, -1.0).otherwise(F.col("y"))), "repeated": df.unionByName(df.where(at)),
        "added": df.unionByName(spark.createDataFrame([(10**9, "a", None)], "id long, x string, y double")), "null key": df.unionByName(spark.createDataFrame([(None, "a", None)], "id long, x string, y double")),
    }[edit]
    a, b = (run.written(hashing.hash_tree(x, "id", 50), f"{tmp_path}/{k}") for k, x in enumerate((df.repartition(5), after.orderBy(F.desc("id")))))
    got = sorted(map(tuple, hashing.differing_ranges(a, b, 50).collect()), key=str)
    by = [{}, {}]
    for side, rows in zip(by, (df, after)):
        for r in rows.collect():
            side.setdefault(None if r.id is None else r.id // 50 * 50, []).append(str(r))
    want = [(k, None if k is None else k + 50, len(by[0].get(k, [])), len(by[1].get(k, []))) for k in {*by[0], *by[1]} if sorted(by[0].get(k, [])) != sorted(by[1].get(k, []))]
    assert got == sorted(want, key=str)
    assert a.where("level = 3").count() <= 3 and hashing.differing_ranges(hashing.hash_tree(df.limit(0), "id", 50), hashing.hash_tree(df.limit(0), "id", 50), 50).count() == 0


def test_manifest(spark):
    df = spark.createDataFrame([("train", "id"), ("train", "id"), ("eval", "float")], "stage string, domain string")
    source = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    told = json.loads(checks.manifest(df, "m", 3, {"s": (source, "k")}).first().manifest)
    print_ = hashing.fingerprint(source.orderBy(F.desc("k")), "k").first()
    assert told == {"name": "m", "seed": 3, "rows": 3, "composition": [{"stage": "eval", "domain": "float", "n": 1}, {"stage": "train", "domain": "id", "n": 2}], "sources": [{"name": "s", "rows": 2, "fingerprint": print_.fingerprint}]}
    assert json.loads(checks.manifest(df.limit(0), "m", 3).first().manifest) == {"name": "m", "seed": 3, "rows": 0, "composition": []}


def test_slots_beyond_the_first_operands(spark, tmp_path):
    """More easy slots than there are easy expressions of operands up to 20: the operands grow, and nothing is drawn on and on."""
    want = spark.range(30_000).select(F.col("id").cast("string").alias("id"), F.lit("easy").alias("tier"))
    seen = spark.createDataFrame([("2 + 3*4",)], "expression string")
    got = generate.refilled(want, seen, "id", 4, str(tmp_path), per_slot=60)
    told = got.agg(F.countDistinct("id"), F.countDistinct("expression"), F.bool_and(X.is_useful(F.col("e")) & (X.render(F.col("e")) == F.col("expression"))), F.max(F.array_max(F.col("e")["operands"]))).first()
    assert told[:3] == (30_000, 30_000, True) and 20 < told[3] <= generate.HIGHEST


def test_extent(spark):
    """Answer and largest step without the steps, against those of the trace."""
    rows = generate.candidates(spark, 3000, "negative", 9).unionByName(generate.candidates(spark, 3000, "length", 9))
    t, x = X.precedence_trace(F.col("e")), X.extent(F.col("e"))
    both = rows.select(t["answer"].alias("a"), F.array_max(F.transform(t["steps"], lambda s: F.abs(s["result"]))).alias("m"), x["answer"].alias("b"), x["most"].alias("n"))
    assert both.where(~(F.col("a").eqNullSafe(F.col("b")) & F.col("m").eqNullSafe(F.col("n")))).count() == 0
