"""Every query of the training-data problems that has SQL, against it."""

import importlib

import pytest

SF = "/root/testdata/sf0.001"


def test_queries_equal_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    q = importlib.import_module("filmgrain.llm.queries")
    con = duckdb.connect()
    for name in ("reviews", "movie_reviews", "documents", "eval_items"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")

    def norm(df):
        df = df[sorted(df.columns)].astype(object)
        return sorted(tuple("" if v is None or v != v else f"{v:.5f}" if isinstance(v, float) else str(v) for v in r) for r in df.itertuples(index=False, name=None))

    for name, sql in q.SQL.items():
        a, b = q.QUERIES[name](spark, SF).toPandas(), con.execute(sql).fetchdf()
        assert sorted(a.columns) == sorted(b.columns) and norm(a) == norm(b), name
