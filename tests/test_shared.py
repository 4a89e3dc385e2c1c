"""Work that rows with equal inputs share."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tracemill.operators import shared
from tracemill.plans import catalogue
from tracemill.streaming import run


def test_once(spark, tmp_path):
    rows = [(i, v, t) for i, (v, t) in enumerate([(1.0, "a"), (1.0, "a"), (None, "a"), (None, "a"), (-0.0, None), (0.0, None), (float("nan"), "b"), (float("nan"), "b"), (2.0, "none")])]
    df, given = spark.createDataFrame(rows, "id long, v double, t string"), []

    def work(inputs):
        given.append(sorted(map(str, inputs.collect())))
        return inputs.select("v", "t", F.explode(F.when(F.coalesce("t", F.lit("")) == "none", F.array().cast("array<int>")).otherwise(F.array(F.lit(1), F.lit(2)))).alias("n"))

    got = sorted(map(tuple, shared.once(df, ["v", "t"], work, f"{tmp_path}/told").select("id", "n").collect()))
    assert got == [(i, n) for i in range(8) for n in (1, 2)] and len(given[0]) == 5
    assert shared.once(df.limit(0), ["v"], lambda x: x.withColumn("w", F.lit(1)), f"{tmp_path}/none").count() == 0
    with pytest.raises(ValueError, match="id"):
        shared.once(df, ["v"], lambda x: x.withColumn("id", F.lit(1)), f"{tmp_path}/clash")


#: The queries that work on equal problems once.
QUERIES = """rescored_changes case_lines score_graph transcript_build turn_machine score_trace semantic_trace failure_classes row_metrics reward_modes""".split()


@pytest.mark.parametrize("name", QUERIES)
def test_equal_problems_are_worked_on_once(spark, tmp_path, monkeypatch, name):
    """Line items of few problems: as many rows as they are, from no more results than there are problems."""
    n, fields = 480, 5
    spark.range(n).select(
        F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), (F.col("id") % 24 % 3).cast("double").alias("l_quantity"), (F.col("id") % 2).alias("l_partkey"), F.lit(3).cast("long").alias("l_suppkey"),
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    folder = f"{tmp_path}/scratch"
    monkeypatch.setattr(run, "scratch", lambda _: folder)
    got = catalogue.queries()[name](spark, str(tmp_path))
    c = duckdb.connect()
    c.execute(f"create view lineitem as select * from read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    want = c.execute(f"select count(*) from ({catalogue.oracle_sql()[name]})").fetchone()[0]
    assert got.count() == want
    assert 0 < spark.read.parquet(f"{folder}/told").count() <= 24 * fields
