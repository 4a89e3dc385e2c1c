"""Every registered query of the transcript engine against its SQL."""

import decimal
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

from tracemill.plans import catalogue

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canon(x):
    if isinstance(x, (list, tuple, np.ndarray)):
        return "[" + ",".join(map(canon, x)) + "]"
    if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and x != x:
        return "null"
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x))
    if isinstance(x, (int, float, np.number, decimal.Decimal)):
        return f"{float(x):.9g}"
    return str(x)


@pytest.fixture(scope="session")
def duck():
    if not DATA.exists():
        pytest.skip("no test tables here")
    c = duckdb.connect()
    for t in TABLES:
        p = DATA / f"{t}.parquet"
        c.execute(f"create view {t} as select * from read_parquet('{p}/*.parquet')" if p.is_dir() else f"create view {t} as select * from read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_sql(spark, duck, name):
    a, b = catalogue.queries()[name](spark, str(DATA)).toPandas(), duck.execute(catalogue.oracle_sql()[name]).fetchdf()
    assert sorted(a.columns) == sorted(b.columns)
    rows = lambda df: sorted(tuple(canon(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None))
    assert rows(a) == rows(b)


def test_contained_items_anywhere(spark, tmp_path):
    texts = ["the quick brown fox jumps over the lazy dog", 'he said "quick brown fox jumps over" twice', "pre-quick brown fox (the lazy dog)", " a\tb  c\nd ", "", None, "x" * 40, "the quick brown fox jumps over the lazy dog"]
    items = ["fox", "quick brown fox jumps over", " lazy", "lazy dog)", "brown fox", "uick brown fox jump", "b  c\nd", "b c d", "\tb  c\n", " the lazy dog", "x" * 17, "", " ", None, "quick brown fox jumps over", "none of it is here"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    want = c.execute(catalogue.oracle_sql()["contained_items"]).fetchone()
    hits = [i for i, x in enumerate(items) if x is not None for t in texts if t is not None and x in t]
    assert want == (len(hits), len(set(hits)))
    assert tuple(catalogue.queries()["contained_items"](spark, str(tmp_path)).first()) == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["lang", "is_total", "n", "quality", "toxic"]
    assert set(e.oracle_sql()) <= set(e.queries())
