"""Catchments of regions with many pairs are solved, not refused."""

import numpy as np

from loadloom.operators import matching as M


def test_no_bound_on_pairs(spark):
    row = "0L AS region, id AS k, 32 + (id * 37 % 1000) / 100 AS lat, -124 + (id * 91 % 1000) / 100 AS lon"
    units, nodes = spark.range(41).selectExpr(*row.split(", ")), spark.range(500_000).selectExpr(*row.split(", "))
    got = M.catchments(units, nodes).toPandas()
    assert len(got) == 500_000 and got["anchor"].sum() == 41 and got["unit"].nunique() == 41


def test_rows_of_costs_on_demand():
    cost = np.random.default_rng(1).integers(0, 4, (6, 9)).astype(float)
    a, b = M.anchors(cost), M._anchors(lambda i: cost[i], 6, 9)
    assert (a == b).all() and len(set(a)) == 6
