"""Node tables under contract, target cells, composite shapes of bases and what shares come to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .allocation import refuse

SEASONS = ("winter_load", "summer_load")


def node_table(raw: DataFrame) -> DataFrame:
    """A table of strings as nodes: ``node_id``, ``base_id``, ``subname``, the two seasonal levels as numbers and all other columns.

    Refused: blank or repeated node ids, blank base ids where the column is there (else a node is its own base), and levels that
    are no finite number.  Nothing is read off the ids themselves, and no coordinate counts."""
    missing = [c for c in ("node_id", *SEASONS) if c not in raw.columns]
    if missing:
        raise ValueError(f"the node table has no column {missing}")
    out = raw.withColumn("node_id", F.trim("node_id"))
    out = out.withColumn("base_id", F.trim("base_id") if "base_id" in raw.columns else F.col("node_id"))
    out = out if "subname" in raw.columns else out.withColumn("subname", F.lit(""))
    for c in SEASONS:
        out = out.withColumn(c, F.trim(F.col(c).cast("string")).try_cast("double"))
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    times = F.count("*").over(Window.partitionBy("node_id"))
    out = out.withColumn("_times", times)
    problems = [
        (F.coalesce(F.col("node_id"), F.lit("")) == "", "a node id is blank"),
        (F.col("_times") > 1, "a node id repeats"),
        (F.coalesce(F.col("base_id"), F.lit("")) == "", "a base id is blank"),
        (~(finite(SEASONS[0]) & finite(SEASONS[1])), "a level is no finite number"),
    ]
    for bad, message in problems:
        out = out.where(refuse(bad, message))
    return out.drop("_times")


def by_block(nodes: DataFrame, winter: Column, summer: Column) -> DataFrame:
    """A row for each node and half year: block 0 with the winter's level, 1 with the summer's."""
    return nodes.select("*", F.explode(F.array(F.struct(F.lit(0).alias("block"), winter.alias("level")), F.struct(F.lit(1).alias("block"), summer.alias("level")))).alias("_b")).select(*nodes.columns, "_b.*")


def net_to_gross(df: DataFrame, keys: Sequence[str], value: str, out: str = "kappa") -> DataFrame:
    """|sum| / sum of |values|: 1 where nothing cancels, 0 where all does or there is nothing."""
    gross = F.sum(F.abs(value))
    return df.groupBy(*keys).agg(F.coalesce(F.abs(F.sum(value)) / F.nullif(gross, F.lit(0.0)), F.lit(0.0)).alias(out))


def target_cells(series: DataFrame, cell: Column, block: Column) -> DataFrame:
    """By cell: energy, hours, least and greatest value; a half year without energy raises an error."""
    out = series.groupBy(cell.alias("cell"), block.alias("block")).agg(F.sum("mw").alias("energy"), F.count("mw").alias("hours"), F.min("mw").alias("low"), F.max("mw").alias("high"))
    sums = out.groupBy("block").agg(F.sum("energy").alias("_e")).where(refuse(~(F.col("_e") > 0), "a half year has no energy"))
    return out.join(F.broadcast(sums), "block").drop("_e")  # two rows


def base_envelope(surface: DataFrame, edges: DataFrame) -> DataFrame:
    """The surface (unit, cell, value) of each base: the weighted sum over its units, of edges (base, unit, weight, status) that are ok."""
    ok = edges.where("status = 'ok'").select("base", "unit", F.coalesce("weight", F.lit(1.0)).alias("_w"))
    return surface.join(ok, "unit").groupBy("base", "cell").agg(F.sum(F.col("_w") * F.col("value")).alias("value"), F.count("*").alias("units"))


def for_siblings(shapes: DataFrame, nodes: DataFrame) -> DataFrame:
    """A base's shape for each of its nodes: a pattern is copied, not split."""
    return nodes.select("node", "base").join(shapes, "base")


def realised_shares(shares: DataFrame, cells: DataFrame) -> DataFrame:
    """Each node's share of the energy of a block, from shares (node, cell, s) and cells (cell, block, energy)."""
    totals = cells.groupBy("block").agg(F.sum("energy").alias("_e"))
    met = shares.join(F.broadcast(cells.join(totals, "block")), "cell")  # a few hundred rows
    return met.groupBy("node", "block").agg(F.sum(F.col("s") * F.col("energy") / F.col("_e")).alias("share"))


def safe_names(nodes: DataFrame, order: str, prefix: str = "z", width: int = 4) -> DataFrame:
    """A column name by position for each node, in the order of the table, whatever its id is made of.

    Positions are running sums over parts of the order: only one row a part is ordered in one task."""
    ranged = nodes.repartitionByRange(F.col(order)).withColumn("_part", F.spark_partition_id())
    number = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))
    placed = ranged.withColumn("_i", number).join(F.broadcast(offsets), "_part").withColumn("_i", F.col("_i") + F.col("_before"))
    return placed.withColumn("column", F.concat(F.lit(prefix), F.when(F.length(F.col("_i").cast("string")) >= width, F.col("_i").cast("string")).otherwise(F.lpad(F.col("_i").cast("string"), width, "0")))).drop("_part", "_before", "_i")


def system_cells(series: DataFrame, envelope: DataFrame, weight: Column | None = None) -> DataFrame:
    """By cell: sums of the envelope's mu and sigma; mean, spread and number of the series' values, weighted if asked for; the implied
    factor, the calibrated level F* (the envelope's energy over the series' energy), the shape, and rho = min(1, (f sd / sum sigma)^2).

    ``series``: cell, mw; ``envelope``: cell, mu, sigma.  Cells that either lacks are left out."""
    if weight is None:
        moments = series.groupBy("cell").agg(F.avg("mw").alias("ybar"), F.stddev_samp("mw").alias("sd"), F.count("mw").cast("double").alias("n_obs"))
    else:
        w, y = F.col("_w"), F.col("mw")
        sums = series.withColumn("_w", weight).groupBy("cell").agg(F.sum(w).alias("_s"), F.sum(w * y).alias("_y"), F.sum(w * y * y).alias("_yy"), F.sum(w * w).alias("_ww")).where("_s > 0")
        mean, n = F.col("_y") / F.col("_s"), F.col("_s") * F.col("_s") / F.col("_ww")
        spread = F.greatest(F.lit(0.0), F.col("_yy") / F.col("_s") - mean * mean)
        moments = sums.select("cell", mean.alias("ybar"), F.when(n > 1.000001, F.sqrt(spread * n / (n - 1))).alias("sd"), n.alias("n_obs"))
    units = envelope.groupBy("cell").agg(F.sum("mu").alias("sum_mu"), F.sum("sigma").alias("sum_sigma"))
    cells = units.join(moments, "cell")
    level = cells.agg((F.sum(F.col("sum_mu") * F.col("n_obs")) / F.nullif(F.sum(F.col("ybar") * F.col("n_obs")), F.lit(0.0))).alias("f_star"))
    f = F.col("sum_mu") / F.nullif("ybar", F.lit(0.0))
    out = cells.crossJoin(F.broadcast(level)).withColumn("implied_f", f)  # a single row
    return out.withColumn("shape_s", F.col("implied_f") / F.nullif("f_star", F.lit(0.0))).withColumn("rho", F.least(F.lit(1.0), F.pow(F.col("implied_f") * F.col("sd") / F.nullif("sum_sigma", F.lit(0.0)), 2)))


def grid_of_years(models: Sequence[int], weathers: Sequence[int], energies: DataFrame, profile: DataFrame) -> DataFrame:
    """Hourly series for every model year and weather year: the weather year's profile (year, hour_of_year, mw) brought to the model
    year's energy (year, energy)."""
    totals = profile.where(F.col("year").isin(*weathers)).groupBy("year").agg(F.sum("mw").alias("_e"))
    jobs = energies.where(F.col("year").isin(*models)).select(F.col("year").alias("model_year"), "energy").crossJoin(F.broadcast(totals.select(F.col("year").alias("weather_year"), "_e")))  # a few years each
    return profile.withColumnRenamed("year", "weather_year").join(F.broadcast(jobs), "weather_year").select("model_year", "weather_year", "hour_of_year", (F.col("mw") * F.col("energy") / F.col("_e")).alias("mw"))
