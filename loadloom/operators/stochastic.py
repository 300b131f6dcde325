"""Envelopes, calibration to a system series, and seeded conditional generation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import Z90, hash_uniform, normal_cdf, normal_quantile


def fit_envelope(profiles: DataFrame) -> DataFrame:
    """mu and sigma from the 10th and 90th percentiles, with flags; inverted bounds are swapped, and rounding inverts none."""
    low, high = F.least("min_load", "max_load"), F.greatest("min_load", "max_load")
    known = F.col("min_load").isNotNull() & F.col("max_load").isNotNull()
    return profiles.select(
        "unit", "month", "hour",
        F.when(known, (low + high) / 2).alias("mu"), F.when(known, (high - low) / (2 * Z90)).alias("sigma"),
        (~known).alias("missing"), (known & (F.col("min_load") - F.col("max_load") > 1e-12 * F.greatest(F.abs(low), F.abs(high)))).alias("inverted"), (known & (low == high)).alias("zero_width"),
    )


def coarsen(envelope: DataFrame, keys: list[str]) -> DataFrame:
    """Law of total variance over the finer cells of each key."""
    return envelope.groupBy("unit", *keys).agg(F.avg("mu").alias("mu"), F.sqrt(F.avg(F.col("sigma") * F.col("sigma")) + F.var_pop("mu")).alias("sigma"))


def fit_percentiles(long: DataFrame) -> DataFrame:
    """Least squares of loads on normal quantiles; ``long``: unit, percentile, load."""
    z = long.withColumn("_z", normal_quantile(F.col("percentile")))
    return z.groupBy("unit").agg(F.regr_intercept("load", "_z").alias("mu"), F.regr_slope("load", "_z").alias("sigma"))


def standardised(series: DataFrame) -> DataFrame:
    """z of each hour within its region's hours of the day."""
    moments = series.groupBy("region", "hour").agg(F.avg("mw").alias("_mean"), F.stddev_samp("mw").alias("_sd"))
    sd = F.col("_sd")
    return series.join(moments, ["region", "hour"]).withColumn("z", F.when(sd > 0, (F.col("mw") - F.col("_mean")) / F.when(sd > 0, sd))).drop("_mean", "_sd")


def system_cells(series: DataFrame, envelope: DataFrame) -> DataFrame:
    """By hour: the level of the system and of the envelope, the implied factor f and rho = min(1, (f sd / sum sigma)^2)."""
    system = series.groupBy("hour").agg(F.avg("mw").alias("ybar"), F.stddev_samp("mw").alias("sd"))
    units = envelope.groupBy("hour").agg(F.sum("mu").alias("mu"), F.sum("sigma").alias("sigma"))
    out = system.join(units, "hour").withColumn("f", F.when(F.col("ybar") > 0, F.col("mu") / F.when(F.col("ybar") > 0, F.col("ybar"))))
    return out.withColumn("rho", F.least(F.lit(1.0), F.pow(F.col("f") * F.col("sd") / F.nullif("sigma", F.lit(0.0)), 2)))


def generate(envelope: DataFrame, z: DataFrame, cells: DataFrame, seed: int, draw: int, family: str = "normal", hourly: bool = False, scale: float = 1.0) -> DataFrame:
    """mu + sigma w, w = sqrt(rho) z + sqrt(1 - rho) eps, eps by unit and day, or hour, from a hash, so that it does not depend on how rows are dealt.

    ``uniform`` sends w through the normal distribution function to the uniform load of the same 10th and 90th percentiles."""
    if family not in ("normal", "uniform"):
        raise ValueError(f"unknown family: {family}")
    when = F.date_format("t", "yyyy-MM-dd HH" if hourly else "yyyy-MM-dd")
    eps = normal_quantile(hash_uniform(F.lit(str(seed)), F.lit(str(draw)), F.col("unit").cast("string"), when))
    joined = z.join(F.broadcast(cells.select("hour", "rho")), "hour").join(envelope, "hour")  # as many rows as there are hours
    w = F.sqrt("rho") * F.col("z") + F.sqrt(1 - F.col("rho")) * eps
    step = w if family == "normal" else Z90 / 0.8 * (2 * normal_cdf(w) - 1)
    return joined.withColumn("load", scale * (F.col("mu") + F.col("sigma") * step))
