"""The driver's entry points."""

import __spark_entry__


def test_names_match():
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) >= 20


def test_queries_match_sql(spark):
    """Every query with SQL, over the smallest tables."""
    import glob
    import os

    import duckdb
    import pytest

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    db = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        db.sql(f"create view {os.path.basename(f)[:-8]} as from '{f}'")
    for name, query in __spark_entry__.oracle_sql().items():
        got, want = __spark_entry__.queries()[name](spark, folder).toArrow(), db.sql(query).to_arrow_table()
        cols = sorted(want.column_names)
        assert sorted(got.column_names) == cols, name
        assert sorted(map(repr, zip(*[got.column(c).to_pylist() for c in cols], strict=True))) == sorted(map(repr, zip(*[want.column(c).to_pylist() for c in cols], strict=True))), name
