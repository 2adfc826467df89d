"""Every registered query against its SQL on the smallest generated tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    cell = lambda v: None if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)) else round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(cell(v.item() if hasattr(v, "item") else v) for v in r) for r in frame.itertuples(index=False)), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="generated tables not present")
@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = contract.queries()[name](spark, SF).toPandas()
    want = duck.execute(contract.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    own = {n for n in contract.queries() if n != "pipeline" and not n.startswith("op")}
    assert own - set(contract.oracle_sql()) == set()
    assert contract.entry(spark).count() == 3
