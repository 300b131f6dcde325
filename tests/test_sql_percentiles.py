"""Percentiles to the last bit of the SQL's, and bounds that only rounding inverts."""

import datetime as dt

import duckdb

from loadloom.operators import stochastic as E
from loadloom.plans import fixtures as X


def test_bits_of_the_sql(spark, tmp_path):
    rows = [(u, 24 * n, dt.datetime(2024, 1, 2), float(v)) for u, vs in enumerate([(29, 29, 29), (1, 3, 7, 9), (13, 14, 14, 31, 50)]) for n, v in enumerate(vs)]
    path = str(tmp_path / "lineitem.parquet")
    spark.createDataFrame(rows, "l_suppkey long, l_orderkey long, l_shipdate timestamp, l_quantity double").write.parquet(path)
    got = {r.unit: (r.min_load, r.max_load) for r in X.sql_profiles(spark, str(tmp_path)).collect()}
    want = duckdb.sql(f"SELECT l_suppkey, quantile_cont(l_quantity, 0.1), quantile_cont(l_quantity, 0.9) FROM '{path}/*.parquet' GROUP BY 1").fetchall()
    assert got == {u: (a, b) for u, a, b in want}
    flags = E.fit_envelope(X.sql_profiles(spark, str(tmp_path))).where("unit = 0").first()
    assert (flags.inverted, flags.zero_width) == (False, got[0][0] == got[0][1])
