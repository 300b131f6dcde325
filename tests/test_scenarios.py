"""Edges of the scenario operators."""

import datetime as dt

import pytest

from loadloom.operators import scenarios as C


def test_pool(spark):
    rows = [(1, "a", 2.0, True), (2, "a", 0.0, False), (3, "b", 6.0, True), (4, "b", 0.0, False), (5, "b", 0.0, False)]
    nodes = spark.createDataFrame(rows, "node int, county string, weight double, covered boolean")
    got = {r.node: r.share for r in C.pool_shares(nodes, 0.5).collect()}
    assert set(got) == {1, 2, 3} and sum(got.values()) == pytest.approx(1) and got[2] == pytest.approx(1 / 3) and got[3] == pytest.approx(0.5)
    narrow = {r.node: r.share for r in C.pool_shares(nodes, 2.0).collect()}
    assert narrow == {1: 0.25, 3: 0.75}
    with pytest.raises(Exception, match="no covered node"):
        C.pool_shares(nodes.where("not covered"), 0.0).collect()


def test_unknown_cell(spark):
    rows = spark.createDataFrame([(1, 0), (2, 5)], "month int, hour int")
    cells = spark.createDataFrame([(1, 0, 7)], "month int, hour int, cell int")
    assert C.encoded(rows.where("month = 1"), cells).first().cell == 7
    with pytest.raises(Exception, match="no cell for month 2, hour 5"):
        C.encoded(rows, cells).collect()


def test_resampled(spark):
    base = dt.datetime(2024, 1, 30)
    past = [(base + dt.timedelta(hours=h), float(h)) for h in range(24 * 6 + 5)]
    ahead = [(dt.datetime(2025, m, 1) + dt.timedelta(hours=h),) for m in (1, 2, 6) for h in range(48)]
    got = C.resampled(spark.createDataFrame(past, "t timestamp, z double"), spark.createDataFrame(ahead, "t timestamp"), 2, 7).orderBy("t").collect()
    assert len(got) == 144
    for first in (0, 48):
        z = [r.z for r in got[first : first + 48]]
        assert z == [z[0] + h for h in range(48)] and z[0] % 24 == 0
        assert (base + dt.timedelta(hours=z[0])).month == got[first].t.month and z[0] <= 24 * 4
    assert all(r.z is None for r in got[96:])


def test_problems_and_sets(spark):
    a = spark.createDataFrame([(1, None), (2, 2.0)], "k int, v double")
    assert [tuple(r) for r in C.problems(a, {"null": a.v.isNull(), "large": a.v > 5}).collect()] == [("null", 1)]
    assert {tuple(r) for r in C.compared_sets(a, a.where("k = 2"), ["k"]).collect()} == {(1, "left"), (2, "both")}
    assert C.common_value(a, ["k"], "v").collect()[0].v == 2.0
