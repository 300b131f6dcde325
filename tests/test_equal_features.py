"""Equal features are compared once; ranks are those of all donors."""

from loadloom.operators import testing as Q


def test_many_donors_of_equal_features(spark, capsys):
    kind = "unit long, a double, b double"
    donors = spark.createDataFrame([(k, float(k % 4), None if k % 5 == 0 else float(k % 3)) for k in range(120)], kind)
    units = spark.createDataFrame([(1000 + k, float(k % 4) + 0.1, 1.0) for k in range(40)], kind)
    out = Q.feature_neighbours(units, donors, ["a", "b"], 5)
    got = {(r.unit, r["rank"]): r.donor for r in out.collect()}
    rows = [(k, k % 4, 1.0 if k % 5 == 0 else float(k % 3)) for k in range(120)]
    n = len(rows)
    spread = [(sum((r[i] - sum(x[i] for x in rows) / n) ** 2 for r in rows) / n) ** 0.5 for i in (1, 2)]
    for k in range(40):
        far = lambda r: ((k % 4 + 0.1 - r[1]) / spread[0]) ** 2 + ((1.0 - r[2]) / spread[1]) ** 2  # noqa: B023, E731
        best = sorted(rows, key=lambda r: (round(far(r) ** 0.5, 9), r[0]))[:5]
        assert [got[1000 + k, i] for i in range(1, 6)] == [r[0] for r in best]
    out.explain()
    assert "BroadcastNestedLoopJoin" not in capsys.readouterr().out
