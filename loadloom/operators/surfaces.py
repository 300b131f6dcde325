"""Surfaces of values by unit and cell: gaps, what units have in common, totals and peaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def filled(surface: DataFrame, cells: DataFrame) -> DataFrame:
    """A row for each unit and cell; gaps have the unit's mean over all of its cells.  ``cells`` are at most a few hundred."""
    units = surface.groupBy("unit").agg(F.avg("value").alias("_mean"))
    grid = units.crossJoin(F.broadcast(cells.select("cell").distinct()))
    return grid.join(surface.select("unit", "cell", "value"), ["unit", "cell"], "left").select("unit", "cell", F.coalesce("value", "_mean").alias("value"), F.col("value").isNull().alias("gap"))


def without_common(shapes: DataFrame) -> DataFrame:
    """Shapes divided by their cell's mean over the units, and by each unit's new mean; a mean of 0 divides nothing."""
    common = shapes.groupBy("cell").agg(F.avg("shape").alias("_c"))
    out = shapes.join(common, "cell").withColumn("shape", F.when(F.col("_c") != 0, F.col("shape") / F.when(F.col("_c") != 0, F.col("_c"))).otherwise(F.col("shape"))).drop("_c")
    own = F.avg("shape").over(Window.partitionBy("unit"))
    return out.withColumn("shape", F.when(own != 0, F.col("shape") / F.when(own != 0, own)).otherwise(F.col("shape")))


def annual_and_peak(shares: DataFrame, cells: DataFrame) -> DataFrame:
    """Energy and exact peak of each node from shares (node, cell, s) and cells (cell, energy, low, high), without hourly rows:
    a negative share peaks where the target is lowest."""
    at = shares.join(F.broadcast(cells), "cell")
    top = F.when(F.col("s") >= 0, F.col("high") * F.col("s")).otherwise(F.col("low") * F.col("s"))
    return at.groupBy("node").agg(F.sum(F.col("energy") * F.col("s")).alias("energy"), F.max(top).alias("peak"))


def mass_moved(before: DataFrame, after: DataFrame) -> DataFrame:
    """For each k the part of its shares (k, other, share) that is at another place afterwards."""
    a, b = before.withColumnRenamed("share", "_a"), after.withColumnRenamed("share", "_b")
    both = a.join(b, ["k", "other"], "full").withColumn("_s", F.least(F.coalesce("_a", F.lit(0.0)), F.coalesce("_b", F.lit(0.0))))
    return both.groupBy("k").agg((1 - F.sum("_s")).alias("moved"))


def expanded(series: DataFrame, shares: DataFrame) -> DataFrame:
    """A compact package made hourly again: the series (t, cell, mw) by each cell's shares (node, cell, s)."""
    return series.join(shares, "cell").select("t", "node", (F.col("mw") * F.col("s")).alias("mw"))
