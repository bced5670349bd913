"""Every registered query with SQL against DuckDB on the smallest tables, where these are there."""

import os

import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def views():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


def plain(df):
    def one(v):
        if v is None or v is pd.NA or v != v:
            return "null"
        return f"{float(v):.6g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    columns = sorted(df.columns)
    return columns, sorted(tuple(one(v) for v in row) for row in df[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_sql(spark, views, name):
    assert plain(entry.queries()[name](spark, SF).toPandas()) == plain(views.sql(entry.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql()) - {"pipeline"} - {n for n in entry.queries() if n.startswith("op")}))
def test_runs(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["id", "score"]


def test_places_by_ranges(spark):
    """Sections get their places within ranges: no window holds a whole document, and order within each stays."""
    from lexatlas.plans import workload

    made = workload._ordered(spark, SF)
    assert "windowspecdefinition(document" not in made._jdf.queryExecution().executedPlan().toString()
    rows = made.join(workload.sections(spark, SF).select("id", "number_norm"), "id").select("document", "ord", "number_norm").collect()
    assert sorted(r["ord"] for r in rows) == list(range(1, len(rows) + 1))
    assert [r["ord"] for r in sorted(rows, key=lambda r: (r["document"], r["number_norm"]))] == list(range(1, len(rows) + 1))
