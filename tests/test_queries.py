"""Every query of the catalogue against its SQL in DuckDB, and the contract of the entry module."""

import duckdb
import pytest

import __spark_entry__ as entry
from quillgraph.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    rel = duck.sql(catalog.SQL[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert in_order(tuple(r[c] for c in cols) for r in df.collect()) == in_order(tuple(r[k] for k in at) for r in rel.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["name", "summary", "entity_type", "n"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries())


def test_a_package_may_be_missing():
    """Without a package that only the training-text operators need, the queries of the graph are all there."""
    import os
    import subprocess
    import sys

    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    got = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=os.path.dirname(os.path.abspath(entry.__file__)))
    assert got.stdout.split() == [str(len(catalog.QUERIES)), str(len(catalog.SQL))]


@pytest.mark.parametrize("name", ["rrf_hybrid", "context_split_caps"])
def test_a_top_k_is_no_sort_of_everything(spark, name, capsys):
    catalog.QUERIES[name](spark, DATA).explain("formatted")
    assert "TakeOrderedAndProject" in capsys.readouterr().out


def test_registry_split_compares_once(spark):
    """What is resolved is read from a table for both of its states, not compared for each."""
    assert "MapInArrow" not in (plan := catalog.QUERIES["registry_split"](spark, DATA)._jdf.queryExecution().executedPlan().toString()) and "Pandas" not in plan
