"""Pools and holds, cells of the user's own, resampled days, fallbacks for shapes, and checks of inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import hash_uniform


def pool_shares(nodes: DataFrame, gate: float, top_off: bool = True) -> DataFrame:
    """Shares of a pool of nodes (node, county, weight, covered): all of a county in which at least ``gate`` of the nodes are covered, and the
    covered ones elsewhere.  With ``top_off`` the pool's u uncovered of n nodes have u / n of it evenly, the others the rest by weight.

    A pool without any weight raises an error."""
    coverage = F.avg(F.col("covered").cast("double")).over(Window.partitionBy("county"))
    pool = nodes.withColumn("_in", (coverage >= gate) | F.col("covered")).where("_in").drop("_in")
    bare = (~F.col("covered")).cast("double")
    total = pool.agg(F.count("*").alias("_n"), F.sum(bare).alias("_u"), F.sum(F.when(F.col("covered"), F.col("weight")).otherwise(0.0)).alias("_w"))
    beta = F.col("_u") / F.col("_n") if top_off else F.lit(0.0)
    weight = F.col("weight") / F.when(F.col("_w") > 0, F.col("_w"))
    even = F.when(F.col("_u") > 0, beta / F.when(F.col("_u") > 0, F.col("_u")))
    joined = pool.crossJoin(F.broadcast(total))  # a single row
    share = F.when(F.col("covered"), (1 - beta) * weight).otherwise(even)
    refused = F.raise_error(F.lit("no covered node has weight")).cast("double")
    return joined.withColumn("share", F.when(F.col("_w") > 0, share).otherwise(refused)).drop("_n", "_u", "_w")


def hold_shares(nodes: DataFrame) -> DataFrame:
    """Shares by weight of the nodes that have some."""
    some = nodes.where("weight > 0")
    return some.crossJoin(F.broadcast(some.agg(F.sum("weight").alias("_w")))).withColumn("share", F.col("weight") / F.col("_w")).drop("_w")  # a single row


def encoded(df: DataFrame, cells: DataFrame) -> DataFrame:
    """Rows (month, hour) with the cell of a table of cells (month, hour, cell); an hour without a cell, or with several, raises an error."""
    several = F.raise_error(F.format_string("several cells for month %d, hour %d", "month", "hour")).cast("int")
    each = cells.groupBy("month", "hour").agg(F.min("cell").alias("_a"), F.max("cell").alias("_b"))
    known = F.broadcast(each.select("month", "hour", F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(several).alias("cell")))  # at most 288 rows
    missing = F.raise_error(F.format_string("no cell for month %d, hour %d", "month", "hour")).cast("int")
    return df.join(known, ["month", "hour"], "left").withColumn("cell", F.coalesce("cell", missing))


def straddling(fine: DataFrame, coarse: DataFrame) -> DataFrame:
    """Fine cells that lie in several coarse ones; both are (month, hour, cell)."""
    both = fine.join(coarse.withColumnRenamed("cell", "_c"), ["month", "hour"])
    return both.groupBy("cell").agg(F.countDistinct("_c").alias("coarse")).where("coarse <> 1")


def resampled(z: DataFrame, target: DataFrame, block: int, seed: int) -> DataFrame:
    """``target`` (t) with z of past days (t, z), drawn in blocks of consecutive complete days that begin in the same month as the
    target's block.  The draw of a block is a hash of the seed and its number, so that it is the same however rows are dealt.

    Months without a past start have null.  Calendars of days are all that is ordered in one task."""
    past = z.withColumn("_d", F.to_date("t")).withColumn("_h", F.hour("t"))
    days = past.groupBy("_d").agg(F.count("z").alias("_n")).where("_n = 24").withColumn("_i", F.row_number().over(Window.orderBy("_d")) - 1)
    last = F.max("_i").over(Window.partitionBy(F.lit(0)))
    starts = days.withColumn("_last", last).where(F.col("_i") <= F.col("_last") + 1 - block).withColumn("_m", F.month("_d"))
    by = Window.partitionBy("_m")
    starts = starts.select("_m", F.col("_i").alias("_s"), (F.row_number().over(by.orderBy("_i")) - 1).alias("_k"), F.count("*").over(by).alias("_of"))
    ahead = target.select(F.to_date("t").alias("_td")).distinct().withColumn("_j", F.row_number().over(Window.orderBy("_td")) - 1)
    ahead = ahead.withColumn("_b", F.floor(F.col("_j") / block)).withColumn("_m", F.month(F.min("_td").over(Window.partitionBy("_b"))))
    sizes = starts.select("_m", "_of").distinct()
    pick = F.floor(hash_uniform(F.lit(str(seed)), F.col("_b").cast("string")) * F.col("_of")).cast("int")
    chosen = ahead.join(sizes, "_m").withColumn("_k", pick).join(starts.drop("_of"), ["_m", "_k"])
    chosen = chosen.select("_td", (F.col("_s") + F.col("_j") % block).alias("_i")).join(days.select("_i", "_d"), "_i")
    drawn = chosen.join(past.select("_d", "_h", "z"), "_d").select("_td", "_h", "z")
    at = target.withColumn("_td", F.to_date("t")).withColumn("_h", F.hour("t"))
    return at.join(drawn, ["_td", "_h"], "left").drop("_td", "_h")


def shapes_with_fallback(units: DataFrame, cells: DataFrame, own: DataFrame, minimum: int = 1) -> DataFrame:
    """A shape in every cell for each unit (unit, county): its own, else the mean of its county's, else of all, else 1; the unit's mean is then 1.

    ``own``: unit, cell, shape; ``cells``: at most a few hundred."""
    placed = own.join(units.select("unit", "county"), "unit")
    county = placed.groupBy("county", "cell").agg(F.avg("shape").alias("_c"), F.countDistinct("unit").alias("_n")).where(F.col("_n") >= minimum).drop("_n")
    fleet = cells.select("cell").distinct().join(own.groupBy("cell").agg(F.avg("shape").alias("_f")), "cell", "left")
    grid = units.select("unit", "county").crossJoin(F.broadcast(fleet))
    out = grid.join(own.select("unit", "cell", F.col("shape").alias("_o")), ["unit", "cell"], "left").join(county, ["county", "cell"], "left")
    route = F.when(F.col("_o").isNotNull(), "own").when(F.col("_c").isNotNull(), "county").when(F.col("_f").isNotNull(), "fleet").otherwise("flat")
    out = out.withColumn("route", route).withColumn("_s", F.coalesce("_o", "_c", "_f", F.lit(1.0)))
    mean = F.avg("_s").over(Window.partitionBy("unit"))
    return out.select("unit", "cell", "route", F.when(mean > 0, F.col("_s") / F.when(mean > 0, mean)).otherwise(1.0).alias("shape"))


def problems(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """How many rows have each problem, all of them in one pass; problems that no row has are left out."""
    found = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    return df.select(F.explode(found).alias("problem")).groupBy("problem").agg(F.count("*").alias("n"))


def demand_divergence(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row on two tables of annual demand (node, mw): the part relocated, RMSE and that relative to the mean over loaded nodes,
    correlation, and the loaded nodes in common by all loaded."""
    both = a.select("node", F.col("mw").alias("x")).join(b.select("node", F.col("mw").alias("y")), "node", "full").na.fill(0.0, ["x", "y"])
    total = both.agg(F.sum("x").alias("_x"), F.sum("y").alias("_y"))
    x, y = F.col("x"), F.col("y")
    one, any_, each = (lambda c: F.sum(c.cast("double"))), (x > 0) | (y > 0), (x > 0) & (y > 0)
    rmse = F.sqrt(F.avg(F.when(any_, (x - y) * (x - y))))
    part = lambda v, t: v / F.nullif(F.col(t), F.lit(0.0))
    return both.crossJoin(F.broadcast(total)).agg(  # a single row
        (F.sum(F.abs(part(x, "_x") - part(y, "_y"))) / 2).alias("relocated"), rmse.alias("rmse"), (rmse / F.nullif(F.avg(F.when(x > 0, x)), F.lit(0.0))).alias("nrmse"),
        F.corr("x", "y").alias("pearson"), (one(each) / F.nullif(one(any_), F.lit(0.0))).alias("jaccard"),
    )


def median_peak_year(series: DataFrame, value: str = "mw") -> DataFrame:
    """The year whose highest value is the middle one of all years' (the upper of two); ties go to the earlier year."""
    peaks = series.groupBy(F.year("t").alias("year")).agg(F.max(value).alias("peak"))
    everything = Window.partitionBy(F.lit(0))  # a row a year
    ranked = peaks.withColumn("_i", F.row_number().over(everything.orderBy("peak", "year")) - 1).withColumn("_n", F.count("*").over(everything))
    return ranked.where(F.col("_i") == F.floor(F.col("_n") / 2)).select("year", "peak")


def compared_sets(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every key of either table with where it is: left, right or both."""
    left, right = a.select(*keys).distinct().withColumn("_a", F.lit(True)), b.select(*keys).distinct().withColumn("_b", F.lit(True))
    side = F.when(F.col("_b").isNull(), "left").when(F.col("_a").isNull(), "right").otherwise("both")
    return left.join(right, list(keys), "full").select(*keys, side.alias("side"))


def distance_bands(df: DataFrame, km: str, edges: Sequence[float]) -> DataFrame:
    """Counts and medians by band of distance; a band has its lower edge, and the last has no end."""
    band = F.lit(0)
    for i, edge in enumerate(edges, 1):
        band = F.when(F.col(km) >= edge, i).otherwise(band)
    return df.where(F.col(km).isNotNull()).groupBy(band.cast("int").alias("band")).agg(F.count("*").alias("n"), F.percentile(km, 0.5).alias("median_km"))


def common_value(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The value that most rows of a key have, ties to the smaller; counted before rows are brought together by key."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))).alias("_b")
    return counts.groupBy(*keys).agg(best).select(*keys, F.col("_b.v").alias(value), (-F.col("_b.m")).alias("n"))


def overlaid(baseline: DataFrame, scale: float, overlays: DataFrame, reductions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The target by ``keys``: baseline (keys, mw) times ``scale``, plus overlays, less reductions; both are summed first, and hours without them have none."""
    extra = overlays.groupBy(*keys).agg(F.sum("mw").alias("_plus"))
    less = reductions.groupBy(*keys).agg(F.sum("mw").alias("_less"))
    met = baseline.join(extra, list(keys), "left").join(less, list(keys), "left")
    return met.withColumn("mw", scale * F.col("mw") + F.coalesce("_plus", F.lit(0.0)) - F.coalesce("_less", F.lit(0.0))).drop("_plus", "_less")
