"""Invariants on small made-up tables: shares add up, totals are kept to the last printed digit, refusals refuse."""

import random

import pytest
from pyspark.sql import functions as F

from loadloom.functions import scalar
from loadloom.operators import allocation, relational


def test_shares_fall_back_to_equal(spark):
    df = spark.createDataFrame([("a", -1.0), ("a", None), ("b", 3.0), ("b", 1.0)], "k string, v double")
    got = {(r.k, r.v): r.weight for r in relational.share_within(df, ["k"], "v").collect()}
    assert got == {("a", -1.0): 0.5, ("a", None): 0.5, ("b", 3.0): 0.75, ("b", 1.0): 0.25}


def test_rounding_keeps_totals(spark):
    rng = random.Random(4)
    rows = [(k, i, rng.random() * 37) for k in range(20) for i in range(50)]
    out = relational.round_to_printed(spark.createDataFrame(rows, "k int, o int, v double"), ["k"], "v", "o", 1)
    for r in out.groupBy("k").agg(F.sum("v").alias("v"), F.sum("printed").alias("p"), F.max(F.abs(F.col("v") - F.col("printed"))).alias("d")).collect():
        assert abs(round(r.v, 1) - r.p) < 1e-6 and r.d <= 0.1 + 1e-9


def test_levels_net_within_a_base(spark):
    rows = [(0, "foo", "a", 10.0), (0, "foo", "b", 11.0), (0, "foo", "c", -1.0), (0, "u1", "u1", 45.0), (0, "u2", "u2", 35.0)]
    nodes = spark.createDataFrame(rows, "block int, base string, node string, level double")
    got = {r.node: r.share for r in allocation.level_shares(nodes).collect()}
    assert abs(sum(got.values()) - 1) < 1e-12 and got["c"] == 0 and abs(got["a"] + got["b"] - 0.2) < 1e-12
    with pytest.raises(Exception, match="negative level"):
        allocation.level_shares(nodes, "refuse").collect()


def test_county_first_adds_up(spark):
    nodes = spark.createDataFrame([(1, "x", 2.0, True), (2, "x", 0.0, False), (3, "y", 0.0, False), (4, "z", 0.0, True), (5, "z", 0.0, False)], "node int, county string, weight double, covered boolean")
    counties = spark.createDataFrame([("x", 0.5), ("y", 0.2), ("z", 0.3)], "county string, fraction double")
    got = {r.node: r.share for r in allocation.county_first(nodes, counties).collect()}
    assert abs(sum(got.values()) - 1) < 1e-12 and got[1] == 0.25 and got[3] == 0.2


def test_slack_goes_to_unmapped_nodes(spark):
    levels = spark.createDataFrame([("a", 0, 0.6, True), ("b", 0, 0.3, False), ("c", 0, 0.1, False)], "node string, block int, share double, mapped boolean")
    shapes = spark.createDataFrame([("a", 0, 0, 1.2), ("a", 1, 0, 0.8)], "node string, cell int, block int, shape double")
    got = {(r.node, r.cell): r.s for r in allocation.slack_shares(shapes, levels).collect()}
    assert abs(got["b", 0] - 0.28 * 0.75) < 1e-12 and abs(sum(v for (_, c), v in got.items() if c == 1) - 1) < 1e-12


def test_normal_quantile(spark):
    p = spark.createDataFrame([(x,) for x in (0.001, 0.1, 0.5, 0.9, 0.999)], "p double")
    got = [r.z for r in p.select(scalar.normal_quantile(F.col("p")).alias("z")).collect()]
    assert max(abs(a - b) for a, b in zip(got, (-3.090232306, -scalar.Z90, 0.0, scalar.Z90, 3.090232306), strict=True)) < 1e-7
