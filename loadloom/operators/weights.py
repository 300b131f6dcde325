"""Participation weights and disaggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import share_within

LEVELS = {"annual": [], "monthly": ["month"], "hourly": ["hour"], "monthhour": ["month", "hour"]}


def average_load(profiles: DataFrame) -> DataFrame:
    """Duplicates of a cell averaged; ``avg_load`` is null if a bound is."""
    keys = ["unit", "month", "hour"]
    return profiles.groupBy(*keys).agg(F.avg("min_load").alias("min_load"), F.avg("max_load").alias("max_load")).withColumn("avg_load", (F.col("min_load") + F.col("max_load")) / 2)


def aggregate_to_level(loads: DataFrame, level: str) -> DataFrame:
    return loads.groupBy("unit", *LEVELS[level]).agg(F.avg("avg_load").alias("avg_load"))


def single_stage(loads: DataFrame, units: DataFrame, level: str = "monthhour") -> DataFrame:
    """Shares of a region's units in each cell of the level; they add up to 1."""
    keys = LEVELS[level]
    return share_within(aggregate_to_level(loads, level).join(units.select("unit", "region"), "unit"), ["region", *keys], "avg_load")


def chain(loads: DataFrame, units: DataFrame, counties: DataFrame) -> DataFrame:
    """County's fraction of its region times the unit's share of its county; a county without loads is a unit of its own.

    ``counties``: region, county, fraction."""
    own = share_within(loads.join(units.select("unit", "county"), "unit"), ["county", "month", "hour"], "avg_load", "_own")
    cells = loads.select("month", "hour").distinct()
    have = own.select("county", "month", "hour").distinct()
    grid = counties.crossJoin(F.broadcast(cells))  # at most 288 cells
    empty = grid.join(have, ["county", "month", "hour"], "left_anti")
    empty = empty.select("region", "county", "month", "hour", F.concat(F.lit("SYNTHETIC_"), F.col("county")).alias("name"), F.col("fraction").alias("weight"))
    real = own.join(counties, "county").select("region", "county", "month", "hour", F.col("unit").cast("string").alias("name"), (F.col("fraction") * F.col("_own")).alias("weight"))
    return real.unionByName(empty)


def disaggregate(series: DataFrame, weights: DataFrame) -> DataFrame:
    """``series`` (region, t, mw) over the units of its region by the weights of the hour's cell."""
    timed = series.withColumn("month", F.month("t")).withColumn("hour", F.hour("t"))
    return timed.join(weights, ["region", "month", "hour"]).withColumn("load", F.col("mw") * F.col("weight"))


def disaggregate_by(series: DataFrame, weights: DataFrame, **periods: Column) -> DataFrame:
    """Energy by unit and period (such as year and month) without the hourly rows: the series is added up by cell and period before
    the join."""
    cells = series.groupBy("region", F.month("t").alias("_m"), F.hour("t").alias("hour"), *[c.alias(f"_of_{n}") for n, c in periods.items()]).agg(F.sum("mw").alias("energy"))
    met = cells.join(weights.withColumnRenamed("month", "_m"), ["region", "_m", "hour"])
    return met.groupBy("region", "unit", *[F.col(f"_of_{n}").alias(n) for n in periods]).agg(F.sum(F.col("energy") * F.col("weight")).alias("energy"))


def disaggregate_totals(series: DataFrame, weights: DataFrame) -> DataFrame:
    """Totals by unit without the hourly rows."""
    return disaggregate_by(series, weights)


def broadcast_to_cells(table: DataFrame, level: str, value: str) -> DataFrame:
    """A level's values in all 288 cells; of the finest level, repeats of a cell add up."""
    if level == "monthhour":
        return table.groupBy("unit", "month", "hour").agg(F.sum(value).alias(value))
    spark = table.sparkSession
    out = table
    for name, first, last in (("month", 1, 13), ("hour", 0, 24)):
        if name not in LEVELS[level]:
            out = out.crossJoin(F.broadcast(spark.range(first, last).select(F.col("id").cast("int").alias(name))))  # 12 or 24 rows
    return out.select("unit", "month", "hour", value)


def county_fractions(units: DataFrame) -> DataFrame:
    """Each county's part of its region's clipped levels."""
    by = units.groupBy("region", "county").agg(F.sum(F.greatest(F.col("level"), F.lit(0.0))).alias("_l"))
    return by.select("region", "county", (F.col("_l") / F.sum("_l").over(Window.partitionBy("region"))).alias("fraction"))
