"""Tests, decompositions, templates, folds and scores of series and profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import average_rank


def _over(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def mann_whitney(df: DataFrame, keys: Sequence[str], value: str, first: str) -> DataFrame:
    """U of the rows where ``first`` holds, and z with the correction for ties; z is null where all values are equal."""
    same = Window.partitionBy(*keys, value)
    ranked = average_rank(df.where(F.col(value).isNotNull()), keys, value, "_r").withColumn("_c", F.count("*").over(same).cast("double"))
    own = F.col(first).cast("double")
    n = ranked.groupBy(*keys).agg(F.sum(own).alias("_a"), F.sum(1 - own).alias("_b"), F.sum(own * F.col("_r")).alias("_s"), F.sum(F.col("_c") * F.col("_c") - 1).alias("_t"))
    a, b, every = F.col("_a"), F.col("_b"), F.col("_a") + F.col("_b")
    u = F.col("_s") - a * (a + 1) / 2
    spread = F.sqrt(F.greatest(F.lit(0.0), a * b / 12 * (every + 1 - F.coalesce(_over(F.col("_t"), every * (every - 1)), F.lit(0.0)))))
    return n.select(*keys, u.alias("u"), _over(u - a * b / 2, spread).alias("z"))


def decompose_variance(df: DataFrame, keys: Sequence[str], cell: Sequence[str], value: str) -> DataFrame:
    """Variance of a key's values as that of its cells' means plus that within the cells."""
    parts = df.groupBy(*keys, *cell).agg(F.count(value).alias("_n"), F.avg(value).alias("_m"), F.var_pop(value).alias("_v"))
    n, m = F.sum("_n"), F.sum(F.col("_n") * F.col("_m"))
    within = F.sum(F.col("_n") * F.col("_v")) / n
    between = F.greatest(F.lit(0.0), F.sum(F.col("_n") * F.col("_m") * F.col("_m")) / n - m / n * (m / n))
    return parts.where("_n > 0").groupBy(*keys).agg((between + within).alias("total"), between.alias("between"), within.alias("within"))


def explained(df: DataFrame, partitions: dict[str, Column], value: str) -> DataFrame:
    """The part of the variance that each partition of the rows explains, all in one pass."""
    named = F.explode(F.array(*[F.struct(F.lit(name).alias("partition"), label.cast("string").alias("_label")) for name, label in partitions.items()]))
    parts = decompose_variance(df.select(value, named.alias("_p")).select(value, "_p.*"), ["partition"], ["_label"], value)
    return parts.select("partition", _over(F.col("between"), F.col("total")).alias("explained"))


def magnitude_and_shape(profiles: DataFrame, value: str) -> DataFrame:
    """Each unit's mean and its values as multiples of it; a mean of 0 has shape 1."""
    mean = F.avg(value).over(Window.partitionBy("unit"))
    return profiles.withColumn("magnitude", mean).withColumn("shape", F.coalesce(_over(F.col(value), mean), F.lit(1.0)))


def group_template(donors: DataFrame, targets: DataFrame, group: str, cell: Sequence[str], minimum: int = 3) -> DataFrame:
    """Shapes for ``targets`` (unit, group): the mean of the group's donors in each cell if there are ``minimum``, else of all."""
    own = donors.groupBy(group, *cell).agg(F.avg("shape").alias("_g"), F.countDistinct("unit").alias("_n")).where(F.col("_n") >= minimum).drop("_n")
    fleet = donors.groupBy(*cell).agg(F.avg("shape").alias("_f"))
    grid = targets.select("unit", group).crossJoin(F.broadcast(fleet))  # as many rows as there are cells
    joined = grid.join(own, [group, *cell], "left")
    return joined.select("unit", *cell, F.coalesce("_g", "_f").alias("shape"), F.when(F.col("_g").isNotNull(), "group").otherwise("fleet").alias("route"))


def neighbour_template(donors: DataFrame, neighbours: DataFrame, cell: Sequence[str]) -> DataFrame:
    """Mean shape of each unit's neighbours (k, other) in each cell."""
    met = neighbours.select(F.col("k").alias("_k"), F.col("other").alias("unit")).join(donors.select("unit", *cell, "shape"), "unit")
    return met.groupBy(F.col("_k").alias("unit"), *cell).agg(F.avg("shape").alias("shape"), F.count("*").alias("donors"))


def group_folds(df: DataFrame, group: str, folds: int, out: str = "fold") -> DataFrame:
    """A fold for each row that depends on its group alone, so that no group is on both sides of a split."""
    digest = F.conv(F.substring(F.md5(F.col(group).cast("string")), 1, 8), 16, 10).cast("long")
    return df.withColumn(out, (digest % folds).cast("int"))


def out_of_fold_means(df: DataFrame, cell: Sequence[str], value: str, fold: str = "fold") -> DataFrame:
    """Each row with the mean of its cell outside its fold, else the mean of everything outside it.

    Sums by cell and fold are enough: what is outside is all less the fold's own."""
    sums = df.groupBy(*cell, fold).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    by, whole, own = Window.partitionBy(*cell), Window.partitionBy(F.lit(0)), Window.partitionBy(fold)
    left = lambda c, w: F.sum(c).over(w) - F.col(c)
    totals = sums.groupBy(fold).agg(F.sum("_s").alias("_fs"), F.sum("_n").alias("_fn"))
    outside = totals.select(fold, _over(F.sum("_fs").over(whole) - F.col("_fs"), F.sum("_fn").over(whole) - F.col("_fn")).alias("_all"))
    cells = sums.select(*cell, fold, _over(left("_s", by), left("_n", by)).alias("_cell"))
    return df.join(cells, [*cell, fold], "left").join(F.broadcast(outside), fold, "left").withColumn("predicted", F.coalesce("_cell", "_all")).withColumn("baseline", F.col("_all")).drop("_cell", "_all")


def scores(df: DataFrame, keys: Sequence[str], y: str, predicted: str, baseline: str) -> DataFrame:
    """RMSE, MAE, bias, WAPE, R2 and skill (1 - RMSE / that of the baseline)."""
    e, b = F.col(predicted) - F.col(y), F.col(baseline) - F.col(y)
    rmse = F.sqrt(F.avg(e * e))
    return df.groupBy(*keys).agg(
        F.count(e).alias("n"), rmse.alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"), _over(F.sum(F.abs(e)), F.sum(F.abs(y))).alias("wape"),
        (1 - _over(F.avg(e * e), F.var_pop(y))).alias("r2"), (1 - _over(rmse, F.sqrt(F.avg(b * b)))).alias("skill"),
    )


def rolling_origins(series: DataFrame, days: Sequence[int], half_lives: Sequence[float], horizon: int = 1) -> DataFrame:
    """Errors of weighted means by cell (region, hour) before each origin over the ``horizon`` days after it.

    Origins count days from the series' first; they and the half-lives are rows, so that all fits are one aggregation."""
    first = series.agg(F.min(F.to_date("t")).alias("_first"))
    aged = series.crossJoin(F.broadcast(first)).withColumn("_day", F.datediff(F.to_date("t"), "_first"))  # a single row
    seen = aged.withColumn("origin", F.explode(F.array(*map(F.lit, days))))
    past = seen.where("_day < origin").withColumn("half_life", F.explode(F.array(*[F.lit(float(h)) for h in half_lives])))
    w = F.pow(F.lit(0.5), (F.col("origin") - F.col("_day")) / F.col("half_life"))
    fit = past.groupBy("region", "hour", "origin", "half_life").agg((F.sum(w * F.col("mw")) / F.sum(w)).alias("predicted"))
    ahead = seen.where((F.col("_day") >= F.col("origin")) & (F.col("_day") < F.col("origin") + horizon))
    e = F.col("predicted") - F.col("mw")
    return ahead.join(fit, ["region", "hour", "origin"]).groupBy("origin", "half_life").agg(F.count("*").alias("n"), _over(F.sqrt(F.avg(e * e)), F.avg("mw")).alias("rel_rmse"), F.avg(e).alias("bias"))
