"""Every registered query with SQL gives the rows of its SQL, over a small set of the shared tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the shared tables")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def _plain(v):
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) and not (isinstance(v, float) and math.isnan(v)) else v


@pytest.mark.parametrize("name", sorted(k for k in entry.oracle_sql() if not k.startswith("op")))
def test_query_equals_its_sql(spark, con, name):
    found = entry.queries()[name](spark, FOLDER)
    columns = sorted(found.columns)
    want = con.sql(entry.oracle_sql()[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    key = lambda rows: sorted((tuple(_plain(v) for v in r) for r in rows), key=repr)
    assert key([r[c] for c in columns] for r in found.collect()) == key([r[i] for i in at] for r in want.fetchall())


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 30 and {"query_id", "rank", "score"} <= set(rows[0].asDict())


@pytest.mark.parametrize("name", ["word_heatmaps", "heatmap_parts", "highlight_parts"])
def test_queries_without_sql_have_rows(spark, name):
    assert entry.queries()[name](spark, FOLDER).count() > 0
