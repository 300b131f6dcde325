"""Joins, groupings and reshaping that series and profiles need beyond the plain ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, value: str, out: str) -> DataFrame:
    """Each row of ``left`` with the ``value`` of the latest row of ``right`` of its keys at or before its time; null before the first.

    One pass over both sides in order, in place of a join of all pairs; of equal times of ``right`` the greatest value counts."""
    given = right.where(F.col(value).isNotNull()).groupBy(*keys, at).agg(F.max(value).alias(out)).withColumn("_side", F.lit(0))
    rows = left.withColumn("_side", F.lit(1)).unionByName(given, allowMissingColumns=True)
    so_far = Window.partitionBy(*keys).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.last(out, ignorenulls=True).over(so_far)).where("_side = 1").select(*left.columns, out)


def within_intervals(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, width: int) -> DataFrame:
    """Pairs of points and intervals [start, end) that hold them; intervals are copied to each span of ``width`` seconds that they touch,
    so that pairs meet in an equi-join."""
    span = lambda c: F.floor(F.unix_timestamp(c) / width)
    spread = intervals.withColumn("_span", F.explode(F.sequence(span(start), span(end))))
    met = points.withColumn("_span", span(at)).join(spread, "_span")
    return met.where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_span")


def neighbours_in_cycle(df: DataFrame, keys: Sequence[str], order: str, period: int, value: str, steps: Sequence[int]) -> DataFrame:
    """Adds ``value`` of the rows so many steps away in a cycle, hour 23 being next to hour 0; null where there is no such row."""
    out = df
    for step in steps:
        name = f"{value}_{'lead' if step > 0 else 'lag'}{abs(step)}"
        other = df.select(*keys, F.pmod(F.col(order) - step, F.lit(period)).alias(order), F.col(value).alias(name))
        out = out.join(other, [*keys, order], "left")
    return out


def looked_up(df: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with the columns of a table that has each key once; a key that repeats raises an error, so no row is ever doubled."""
    rest = [c for c in table.columns if c not in keys]
    one = table.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.any_value(c).alias(c) for c in rest])
    once = F.when(F.col("_n") > 1, F.raise_error(F.lit("a key of the table repeats")).cast("boolean")).otherwise(F.lit(True))
    return df.join(one.where(once).drop("_n"), list(keys), "left")


def by_month(years: DataFrame, vintages: DataFrame) -> DataFrame:
    """Every year of a month with every vintage of it (many to many), for comparisons of profiles that share only months."""
    return years.join(vintages, "month")


def complete_years(series: DataFrame, least: int, keys: Sequence[str] = ()) -> DataFrame:
    """Keys and years with at least so many hours that have a value."""
    return series.groupBy(*keys, F.year("t").alias("year")).agg(F.count("mw").alias("hours")).where(F.col("hours") >= least)


def trailing_years(series: DataFrame, last: int | None, least: int) -> DataFrame:
    """The hours of the last complete years; all rows without ``last``."""
    if not last:
        return series
    years = complete_years(series, least)
    keep = years.orderBy(F.desc("year")).limit(last).select("year")  # a few rows
    return series.join(F.broadcast(keep), F.year("t") == keep["year"], "left_semi")


def with_totals(df: DataFrame, key: str, value: str, at: Sequence[str], totals: dict[str, Sequence]) -> DataFrame:
    """The rows, and for each named total one for each ``at`` with the sum over its members (all of them where none are listed)."""
    out = df.select(*at, F.col(key).cast("string").alias(key), value)
    names = F.array(*[F.when(F.lit(not members) | F.col(key).isin(*members or [None]), F.lit(name)) for name, members in totals.items()])
    summed = df.withColumn("_total", F.explode(F.array_compact(names))).groupBy(*at, "_total").agg(F.sum(value).alias(value))
    return out.unionByName(summed.select(*at, F.col("_total").alias(key), value))


def latest(df: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """The rows of the greatest version of each key, met in a join of a row a key."""
    newest = df.groupBy(*keys).agg(F.max(version).alias(version))
    return df.join(newest, [*keys, version])


def climatology(series: DataFrame, keys: Sequence[str], value: str = "mw") -> DataFrame:
    """By key: percentiles and extremes of the means by year, and of the days' values."""
    yearly = series.groupBy(*keys, F.year("t").alias("_y")).agg(F.avg(value).alias("_m"))
    daily = series.groupBy(*keys, F.to_date("t").alias("_d")).agg(F.avg(value).alias("_m"))
    parts = None
    for name, part in (("year", yearly), ("day", daily)):
        found = part.groupBy(*keys).agg(F.percentile("_m", 0.1).alias(f"{name}_p10"), F.percentile("_m", 0.9).alias(f"{name}_p90"), F.min("_m").alias(f"{name}_min"), F.max("_m").alias(f"{name}_max"))
        parts = found if parts is None else parts.join(found, list(keys))
    return parts


def listed(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """The distinct values of each key in order, as one text; they are made distinct before they are brought together."""
    return df.select(*keys, value).where(F.col(value).isNotNull()).distinct().groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list(F.col(value).cast("string"))), ", ").alias(out))


def margins(df: DataFrame, row: str, column: str) -> DataFrame:
    """Counts by row and column value with the totals of both, "All"; long, as values of columns need not be known."""
    counted = df.groupBy(F.col(row).cast("string").alias("row"), F.col(column).cast("string").alias("column")).agg(F.count("*").alias("_c"))
    cube = counted.cube("row", "column").agg(F.sum("_c").alias("n"), F.grouping("row").alias("_r"), F.grouping("column").alias("_k"))
    return cube.select(F.when(F.col("_r") == 1, "All").otherwise(F.col("row")).alias("row"), F.when(F.col("_k") == 1, "All").otherwise(F.col("column")).alias("column"), "n")


def scaled_to_annual(series: DataFrame, targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The series times what brings its sum in each year to the target (keys, year, energy); years without one stay."""
    timed = series.withColumn("year", F.year("t"))
    factors = timed.groupBy(*keys, "year").agg(F.sum("mw").alias("_e")).join(targets, [*keys, "year"])
    factors = factors.select(*keys, "year", (F.col("energy") / F.nullif("_e", F.lit(0.0))).alias("factor"))
    return timed.join(factors, [*keys, "year"], "left").withColumn("mw", F.col("mw") * F.coalesce("factor", F.lit(1.0))).drop("year")


def hours_of_year(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The number of each hour in its year, from 1, without 29 February; an hour that is missing leaves no gap."""
    kept = series.where(~((F.month("t") == 2) & (F.dayofmonth("t") == 29)))
    return kept.withColumn("hour_of_year", F.row_number().over(Window.partitionBy(*keys, F.year("t")).orderBy("t")))


def rolling(df: DataFrame, keys: Sequence[str], at: str, value: str, hours: int) -> DataFrame:
    """Means over the last so many hours by time, whatever rows there are, quartiles and the part of the values that are no larger."""
    seconds = F.unix_timestamp(at)
    back = Window.partitionBy(*keys).orderBy(seconds).rangeBetween(-(hours - 1) * 3600, 0)
    ordered = Window.partitionBy(*keys).orderBy(value, at)
    return df.select(*keys, at, value, F.avg(value).over(back).alias("mean"), F.ntile(4).over(ordered).alias("quartile"), F.cume_dist().over(Window.partitionBy(*keys).orderBy(value)).alias("part"))


def to_columns(df: DataFrame, keys: Sequence[str], name: str, value: str, values: Sequence, prefix: str) -> DataFrame:
    """Long to wide with known columns."""
    wide = df.groupBy(*keys).pivot(name, list(values)).agg(F.first(value))
    return wide.select(*keys, *[F.col(str(v)).alias(f"{prefix}{v}") for v in values])


def to_rows(df: DataFrame, keys: Sequence[str], prefix: str, name: str, value: str) -> DataFrame:
    """Wide to long: the columns with a prefix as rows, numbered by what follows it; nulls are left out."""
    columns = [c for c in df.columns if c.startswith(prefix)]
    return df.unpivot(list(keys), columns, name, value).where(F.col(value).isNotNull()).withColumn(name, F.expr(f"CAST(substring({name}, {len(prefix) + 1}) AS INT)"))


def trimmed_to_common(series: DataFrame, key: str) -> DataFrame:
    """Up to the earliest of the keys' last times and from the latest of their first."""
    ends = series.groupBy(key).agg(F.min("t").alias("_a"), F.max("t").alias("_b")).agg(F.max("_a").alias("_from"), F.min("_b").alias("_to"))
    return series.join(F.broadcast(ends), F.col("t").between(F.col("_from"), F.col("_to"))).drop("_from", "_to")  # a single row


def peak_by_day(series: DataFrame, key: str, total: str) -> DataFrame:
    """The hour of each day's highest value, ties to the earlier, by key and for the sum of all keys."""
    every = with_totals(series, key, "mw", ["t"], {total: ()})
    best = F.max(F.struct("mw", (-F.hour("t")).alias("h")))
    return every.groupBy(key, F.to_date("t").alias("day")).agg(best.alias("_b")).select(key, "day", (-F.col("_b.h")).cast("int").alias("hour"), F.col("_b.mw").alias("mw"))


def composites(wide: DataFrame, sums: dict[str, Sequence[str]]) -> DataFrame:
    """Adds columns that are sums of others, a null counting as 0."""
    return wide.withColumns({name: sum(F.coalesce(F.col(c), F.lit(0.0)) for c in parts) for name, parts in sums.items()})


def deviations(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """By key: RMSE of b against a relative to a's mean, and bias."""
    diff = F.col(b) - F.col(a)
    mean = F.nullif(F.avg(a), F.lit(0.0))
    return df.groupBy(*keys).agg((F.sqrt(F.avg(diff * diff)) / mean).alias("rel_rmse"), (F.avg(diff) / mean).alias("bias"))


def unused_columns(raw: DataFrame, kept: DataFrame, renamed: dict[str, str]) -> list[str]:
    """Columns of a source that the cleaned table doesn't have under their own or a new name."""
    have = {c.lower() for c in kept.columns}
    return [c for c in raw.columns if renamed.get(c, c).lower() not in have]


def dominant(df: DataFrame, keys: Sequence[str], sums: Sequence[str], mode: str, order: str) -> DataFrame:
    """Parts rolled up: sums of columns, and the most frequent value of another; of equally frequent ones that seen first by ``order``."""
    counts = df.groupBy(*keys, mode).agg(F.count(mode).alias("_n"), F.min(order).alias("_first"), *[F.sum(c).alias(c) for c in sums], F.count("*").alias("_rows"))
    best = F.max(F.when(F.col("_n") > 0, F.struct("_n", (-F.col("_first")).alias("f"), F.col(mode).alias("v"))))
    return counts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums], best["v"].alias(mode), F.sum("_rows").alias("n"))


def case(condition: Column, name: str) -> Column:
    return F.when(condition, F.lit(name))


def checked_overrides(overrides: DataFrame, sites: DataFrame, box: tuple[float, float, float, float], far_km: float, km: Column) -> DataFrame:
    """What is wrong with overriding coordinates (k, lat, lon): repeated, outside the box, unknown, or far from the known place (``km``)."""
    south, north, west, east = box
    repeats = overrides.groupBy("k").agg(F.count("*").alias("_n"))
    met = overrides.join(repeats, "k").join(sites.select("k", F.col("lat").alias("site_lat"), F.col("lon").alias("site_lon"), F.lit(True).alias("_known")), "k", "left")
    outside = ~(F.col("lat").between(south, north) & F.col("lon").between(west, east))
    found = F.array_compact(F.array(case(F.col("_n") > 1, "repeated"), case(outside, "outside"), case(F.col("_known").isNull(), "unknown"), case(km > far_km, "far")))
    return met.select("k", F.explode(found).alias("problem"))
