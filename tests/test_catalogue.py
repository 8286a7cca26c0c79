"""Every query with SQL gives the same rows in DuckDB at the smallest scale; the others give rows of a stable schema."""

import os

import pytest

from sieveworks.plans import catalogue as C
from sieveworks.plans import extended, scaled  # noqa: F401  they add their queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in os.listdir(SF):
        if f.endswith(".parquet"):
            c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


def rows(frame):
    columns = sorted(frame.columns)
    values = frame[columns].astype(object).where(frame[columns].notna(), None)
    return columns, sorted(map(str, values.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(C.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    assert rows(C.QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(C.ORACLE_SQL[name]).df())


#: Queries without SQL, and what their rows must hold: their functions are held against plain rules in the other test files.
WITHOUT_SQL = {"snap_phrases": lambda rows: len(rows) == 200 and any(r["snapped"] for r in rows)}


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_without_sql(spark, name):
    rows = C.QUERIES[name](spark, SF).collect()
    assert rows and WITHOUT_SQL[name](rows)


def test_all_others_have_sql():
    assert {n for n in C.QUERIES if n not in C.ORACLE_SQL} == set(WITHOUT_SQL)


def test_plain_counts():
    assert C.plain_counts("count_if(f(a) > 1) + count_if(b)") == "count(CASE WHEN f(a) > 1 THEN 1 END) + count(CASE WHEN b THEN 1 END)"


def test_entry(spark):
    import __spark_entry__ as e

    assert {r["pool"] for r in e.entry(spark).collect()} == {"test", "verifier_train", "reserve"}
