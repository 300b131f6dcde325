"""Siblings' noise is drawn once for each node and day, whatever the number of regions and cells."""

import datetime as dt

from pyspark.sql import functions as F

from loadloom.operators import envelopes as V


def test_no_cross_join(spark, capsys):
    z = spark.createDataFrame([(dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), r, h % 24, float(h)) for h in range(96) for r in (0, 1)], "t timestamp, region int, cell int, z double")
    base = spark.createDataFrame([("b", c, 1.0, 1.0) for c in range(24)], "base string, cell int, mu double, sigma double")
    nodes = spark.createDataFrame([(n, "b", 1.0) for n in range(3)], "node int, base string, k double")
    drawn = V.sibling_draws(base, nodes, z, z.select("cell").distinct().withColumn("rho", F.lit(0.5)), 7, keys=["region"])
    assert drawn.count() == 2 * 3 * 24
    drawn.explain(True)
    plan = capsys.readouterr().out
    assert "_day" not in plan.split("== Physical Plan ==")[1].split("MapInPandas")[0] and "MapInPandas" in plan
