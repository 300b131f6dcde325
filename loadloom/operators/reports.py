"""Reports that reconcile sources: agreement, missing values, vintages, shapes and shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import first_by, islands


def agreement(a: DataFrame, b: DataFrame, keys: Sequence[str], values: Sequence[str], large: float) -> DataFrame:
    """By key and value column: pairs, correlation, mean and median absolute difference, large differences.  If no hour of the two
    (keys, t, values) meets, ``b`` is read one hour later, and ``shifted`` says so."""
    on = [*keys, "t"]
    later = b.withColumn("t", F.col("t") + F.expr("INTERVAL 1 HOUR"))
    shifted = not a.select(*on).join(b.select(*on), on, "left_semi").limit(1).count()
    other = later if shifted else b
    met = a.select(*on, *values).join(other.select(*on, *[F.col(v).alias(f"_{v}") for v in values]), on)
    pairs = F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("_x"), F.col(f"_{v}").cast("double").alias("_y")) for v in values])
    long = met.select(*keys, F.explode(pairs).alias("_p")).select(*keys, "_p.*").where("_x IS NOT NULL AND _y IS NOT NULL").withColumn("_d", F.abs(F.col("_x") - F.col("_y")))
    return long.groupBy(*keys, "metric").agg(
        F.count("*").alias("n"), F.corr("_x", "_y").alias("corr"), F.avg("_d").alias("mae"), F.percentile("_d", 0.5).alias("median_ae"), F.count_if(F.col("_d") > large).alias("n_large")
    ).withColumn("shifted", F.lit(shifted))


def null_anatomy(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """By key and value column with nulls: their number, first, last, longest run of rows, and where in the record they are."""
    pairs = F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).isNull().alias("_null")) for v in values])
    long = df.select(*keys, "t", F.explode(pairs).alias("_p")).select(*keys, "t", "_p.*")
    by = [*keys, "metric"]
    runs = islands(long, by, "t", F.col("_null"), "_run").groupBy(*by, "_run", "_null").agg(F.count("*").alias("_n"), F.min("t").alias("_a"), F.max("t").alias("_b"))
    gap = F.col("_null")
    one = runs.groupBy(*by).agg(
        F.sum("_n").alias("rows"), F.sum(F.when(gap, F.col("_n"))).alias("nulls"), F.max(F.when(gap, F.col("_n"))).alias("longest"), F.min("_a").alias("_from"), F.max("_b").alias("_to"),
        F.min(F.when(gap, F.col("_a"))).alias("first_null"), F.max(F.when(gap, F.col("_b"))).alias("last_null"),
    ).where("nulls > 0")
    seconds = lambda c: F.unix_timestamp(c) - F.unix_timestamp("_from")
    part = lambda c: seconds(c) / F.greatest(seconds("_to"), F.lit(3600))
    where = (
        F.when(part("last_null") < 0.25, "early").when(part("first_null") > 0.75, "recent").when(F.col("longest") >= 720, "long run")
        .when(F.col("nulls") / F.col("rows") > 0.5, "majority").otherwise("scattered")
    )
    return one.withColumn("location", where).drop("_from", "_to")


def shape_invariance(series: DataFrame, zone: str, value: str) -> DataFrame:
    """By zone of non-zero load, the correlation of its shape (value by its mean) with the mean shape over zones."""
    means = series.groupBy(zone).agg(F.avg(value).alias("_m"), F.sum(value).alias("_s")).where("_s > 0")
    shapes = series.join(means, zone).select(zone, "t", (F.col(value) / F.col("_m")).alias("_shape"))
    overall = shapes.groupBy("t").agg(F.avg("_shape").alias("_mean"))
    return shapes.join(overall, "t").groupBy(zone).agg(F.corr("_shape", "_mean").alias("corr"), F.count("*").alias("n"))


def share_variation(series: DataFrame, zone: str, unit: str, value: str) -> DataFrame:
    """By unit, mean and coefficient of variation over hours of its share of its zone; hours in which the zone has no load are left out."""
    totals = series.groupBy(zone, "t").agg(F.sum(value).alias("_total")).where("_total > 0")
    shares = series.join(totals, [zone, "t"]).withColumn("_share", F.col(value) / F.col("_total"))
    return shares.groupBy(zone, unit).agg(F.avg("_share").alias("share"), (F.stddev_pop("_share") / F.nullif(F.avg("_share"), F.lit(0.0))).alias("cv"))


def worst_by_year(met: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """The ``n`` largest absolute differences of rows (keys, t, x, y) a key and year, ties to the earlier."""
    rows = met.withColumn("year", F.year("t")).withColumn("diff", F.col("x") - F.col("y"))
    w = Window.partitionBy(*keys, "year").orderBy(F.abs("diff").desc_nulls_last(), "t")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select(*keys, "year", "rank", "t", "diff")


def annual_totals(met: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sums of both sides a key and year, their difference, and it in percent of the second."""
    out = met.groupBy(*keys, F.year("t").alias("year")).agg(F.count("*").alias("hours"), F.sum("x").alias("x"), F.sum("y").alias("y"))
    return out.withColumn("diff", F.col("x") - F.col("y")).withColumn("percent", 100 * F.col("diff") / F.nullif("y", F.lit(0.0)))


def two_hops(loads: DataFrame, attributes: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Loads (id, ...) to names through attributes (id, name), then to places through the dictionary (name, place); ``hop`` tells
    where a row stopped: 0 no attributes, 1 not in the dictionary, 2 placed.  Both tables are reduced to a row a key."""
    names = attributes.where("name IS NOT NULL").groupBy("id").agg(F.min("name").alias("name"))
    places = dictionary.where("place IS NOT NULL").groupBy("name").agg(F.min("place").alias("place"))
    hop = F.when(F.col("name").isNull(), 0).when(F.col("place").isNull(), 1).otherwise(2)
    return loads.join(names, "id", "left").join(places, "name", "left").withColumn("hop", hop)


def vintages(profiles: DataFrame, old: Column, new: Column) -> DataFrame:
    """Units with hourly profiles (vintage, unit, hour, load): in which vintages they are, peak hours of the shapes, how far the peak moved
    around the clock, and the change of the mean in percent."""
    side = F.when(old, "old").when(new, "new")
    one = profiles.withColumn("_side", side).where("_side IS NOT NULL").groupBy("_side", "unit", "hour").agg(F.avg("load").alias("load"))
    peaks = first_by(one, ["_side", "unit"], F.desc("load"), F.asc("hour")).select("_side", "unit", F.col("hour").alias("peak"))
    both = one.groupBy("_side", "unit").agg(F.avg("load").alias("mean")).join(peaks, ["_side", "unit"])
    wide = both.groupBy("unit").agg(*[F.max(F.when(F.col("_side") == s, F.col(c))).alias(f"{c}_{s}") for s in ("old", "new") for c in ("mean", "peak")])
    present = F.when(F.col("mean_old").isNull(), "new").when(F.col("mean_new").isNull(), "old").otherwise("both")
    turn = F.pmod(F.col("peak_new") - F.col("peak_old") + 12, F.lit(24)) - 12
    return wide.select("unit", present.alias("vintage"), "peak_old", "peak_new", turn.alias("shift"), (100 * (F.col("mean_new") - F.col("mean_old")) / F.nullif("mean_old", F.lit(0.0))).alias("change"))
