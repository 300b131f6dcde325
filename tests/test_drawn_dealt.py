"""Siblings' noise is a row for each node, dealt out by number, until it meets the result's cells."""

import datetime as dt

from pyspark.sql import functions as F

from loadloom.operators import envelopes as V


def test_a_row_for_each_node(spark, capsys):
    z = spark.createDataFrame([(dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), h % 24, float(h)) for h in range(96)], "t timestamp, cell int, z double")
    base = spark.createDataFrame([("b", c, 1.0, 1.0) for c in range(25)], "base string, cell int, mu double, sigma double")
    nodes = spark.createDataFrame([(n, "b", 1.0) for n in range(3)], "node int, base string, k double")
    drawn = V.sibling_draws(base, nodes, z, z.select("cell").distinct().withColumn("rho", F.lit(0.5)), 7)
    got = drawn.collect()
    assert len(got) == 3 * 25 and {r["mean"] for r in got if r.cell == 24} == {1.0}
    drawn.explain(True)
    plan = capsys.readouterr().out.split("== Physical Plan ==")[1]
    made = next(line for line in plan.splitlines() if "MapInPandas" in line)
    assert "cell" not in made.split(", [")[-1] and "REPARTITION_BY_NUM" in plan
