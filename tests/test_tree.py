"""Lineage of sections against a plain stack."""

import random

import pytest

from pyspark.sql import functions as F
from lexatlas.operators import lookup, tree


def stack(rows):
    out, open_ = {}, []
    for _, ord_, depth in sorted(rows):
        while open_ and open_[-1][1] >= depth:
            open_.pop()
        out[ord_] = [o for o, _ in open_]
        open_.append((ord_, depth))
    return out


@pytest.mark.parametrize("block", [4, 1 << 16])
def test_lineage(spark, monkeypatch, block):
    monkeypatch.setattr(tree, "BLOCK", block)
    rng = random.Random(4)
    rows = [(d, o, rng.choice((0, 1, 1, 2, 3, 7))) for d in ("a", "b") for o in range(-1, 120, rng.choice((1, 2)))]
    rows += [("deep", i, i) for i in range(20)]
    rows += [("flat", i, 3) for i in range(9)]
    got = tree.lineage(spark.createDataFrame(rows, "document string, ord int, depth int"), [])
    for d in ("a", "b", "deep", "flat"):
        assert {r["ord"]: [x["ord"] for x in r["above"]] for r in got.where(f"document = '{d}'").collect()} == stack([r for r in rows if r[0] == d])
    assert tree.lineage(spark.createDataFrame([], "document string, ord int, depth int"), []).count() == 0


def test_ancestors_and_breadcrumbs(spark):
    rows = [(10 + o, 1, o, d, str(o), f"t{o}") for o, d in enumerate((0, 1, 2, 1))]
    s = spark.createDataFrame(rows, "id long, document_id long, ordinal int, depth int, number string, title string")
    got = sorted((r["id"], r["anc"], r["dist"], r["depth"]) for r in lookup.ancestors(s).collect())
    assert got == [(11, 10, 1, 0), (12, 10, 2, 0), (12, 11, 1, 1), (13, 10, 1, 0)]
    named = s.withColumnsRenamed({"document_id": "document", "ordinal": "ord"})
    paths = {r["ord"]: (r["parent"], r["path"]) for r in tree.breadcrumbs(named, "Root").collect()}
    assert paths[2] == (1, "Root > 0 t0 > 1 t1 > 2 t2") and paths[0] == (None, "Root > 0 t0")


def test_nearest_for_many(spark):
    """The same as one by one: ties of spelling, lengths without numbers, questions before and after all, repeated and null ones."""
    from lexatlas.functions.numbers import normalize_number
    from lexatlas.operators import lookup

    rows = ["1", "2.1", "2.2", "2.9", "02.2", "2.02", "2.10", "10.1", "2.1.1", "2.1.2", "2.1.2", "1004.5", "1004.10.3"]
    s = spark.createDataFrame([(x, x.count(".")) for x in rows], "number string, depth int").withColumn("number_norm", normalize_number(F.col("number")))
    asked = ["2.3", "2.3", "0.1", "9999.9", "2.1.9", "1004.7", "x", "", "1004.5.6.7.8.9", "02.02"]
    got = lookup.nearest_for(spark.createDataFrame([(a,) for a in [*asked, None]], "number string"), s).collect()
    for a in set(asked):
        assert [r["number"] for r in sorted(got, key=lambda r: r["rank"]) if r["asked"] == a] == [r["number"] for r in lookup.nearest_numbers(a, s).collect()], a
    assert {r["asked"] for r in got} == set(asked)
    assert lookup.nearest_for(spark.createDataFrame([], "number string"), s).count() == 0


def test_accepted_in_one_pass(spark):
    """Headings against the rule said plainly, over batches of three rows, so that documents go over their ends; no group is handed to Python whole."""
    rng = random.Random(7)
    rows = [(f"d{d}", o, rng.random() < 0.7, f"{rng.randrange(9):04}", rng.randrange(4)) for d in range(30) for o in range(rng.randrange(1, 20))]
    want, path, last = set(), [], {}
    for d, o, inline, number, depth in sorted(rows):
        if o == 0:
            path, last = [], {}
        above = [p for p in path if p[0] < depth]
        slot = (above[-1][1] if above else -1, depth)
        if inline and slot in last and number <= last[slot]:
            continue
        path, last[slot] = [*above, (depth, o)], number
        want.add((d, o))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        found = tree.accepted(spark.createDataFrame(rows, "document string, ord int, inline boolean, number_norm string, depth int"))
        assert {(r["document"], r["ord"]) for r in found.collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "InPandas" not in found._jdf.queryExecution().toString()


def test_build_broadcasts_nothing(spark, monkeypatch):
    """Files that pack well aren't taken for small tables: no join of the sections is a broadcast."""
    made, own = [], tree.settled
    monkeypatch.setattr(tree, "settled", lambda df: (made.append(df._jdf.queryExecution().toString()), own(df))[1])
    blocks = [("d", i, "heading" if i % 5 == 0 else "paragraph", f"{1000 + i} Rules" if i % 5 == 0 else "Text.", 1, 1, None, False) for i in range(40)]
    schema = "document string, ord int, kind string, text string, page int, level int, font_size double, bold boolean"
    assert tree.build(spark.createDataFrame(blocks, schema), "code").count() == 8
    assert len(made) == 5 and not any("BroadcastHashJoin" in p for p in made)


def _whole_documents(spark, tmp_path, name):
    """A query on 9,200 orders of one made-up document, so that its numbers get five digits, as rows with those of its SQL."""
    import __spark_entry__ as entry

    orders = spark.range(9200).selectExpr("id * 3 AS o_orderkey", "CAST(40 * (id % 3) AS LONG) AS o_custkey").union(spark.range(5).selectExpr("id * 3 + 1", "CAST(7 AS LONG)"))
    items = spark.range(9190).selectExpr("id * 3 AS l_orderkey", "id % 11 AS l_partkey", "1 AS l_linenumber").union(spark.range(2).selectExpr("9150 * 3 AS l_orderkey", "id AS l_partkey", "2 + CAST(id AS INT)"))
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    items.write.parquet(f"{tmp_path}/lineitem.parquet")
    con = pytest.importorskip("duckdb").connect()
    for t in ("orders", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    got = entry.queries()[name](spark, str(tmp_path))
    want = con.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    rows = [tuple(r) for r in got.select(*want.columns).collect()]
    assert sorted(rows, key=str) == sorted(want.fetchall(), key=str)
    return [dict(zip(want.columns, r, strict=True)) for r in rows]


def test_tables_of_documents_that_grow(spark, tmp_path):
    """Documents are whole: the first section has the tables of every fourth order, and numbers of five digits are read."""
    rows = _whole_documents(spark, tmp_path, "table_attach")
    assert {r["document"] for r in rows} == {"0", "7"}
    assert max(r["tables"] for r in rows) == 9200 // 4 and sum(r["tables"] for r in rows) == 9200 // 2 + 2
    assert "10198" in {r["number"] for r in rows}


def test_outline_of_documents_that_grow(spark, tmp_path):
    """Documents are whole: a line for each section that has something, with numbers of five digits, and all tables of the first."""
    rows = _whole_documents(spark, tmp_path, "outline")
    assert {r["document"] for r in rows} == {"0", "7"} and max(r["ordinal"] for r in rows) == 9198
    assert next(r["line"] for r in rows if r["document"] == "0" and r["ordinal"] == 1) == "  1001 Rules for orders  [3w 2300t amends 1001]"
    assert any(r["line"].startswith("  10150 ") for r in rows)
