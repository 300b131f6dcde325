"""Generic steps that the domain operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One row for each key: the first in a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def share_within(df: DataFrame, keys: Sequence[str], value: str, out: str = "weight") -> DataFrame:
    """Shares of the clipped values within each key; equal shares where they add up to nothing.

    Sums by key are joined, so that a key with a third of all rows is dealt to many tasks."""
    v = F.greatest(F.coalesce(F.col(value), F.lit(0.0)), F.lit(0.0))
    sums = df.groupBy(*[F.col(k).alias(f"_of_{k}") for k in keys]).agg(F.sum(v).alias("_total"), F.count("*").alias("_many"))
    joined = df.join(sums, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    share = F.when(F.col("_total") > 0, v / F.when(F.col("_total") > 0, F.col("_total"))).otherwise(1 / F.col("_many"))
    return joined.withColumn(out, share).drop("_total", "_many", *[f"_of_{k}" for k in keys])


def min_rank(df: DataFrame, keys: Sequence[str], value: str, out: str = "rank") -> DataFrame:
    """Descending, ties share the least rank; null values have none."""
    w = Window.partitionBy(*keys).orderBy(F.col(value).desc_nulls_last())
    return df.withColumn(out, F.when(F.col(value).isNotNull(), F.rank().over(w)))


def average_rank(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Ascending, ties share the mean of their ranks."""
    w, same = Window.partitionBy(*keys).orderBy(value), Window.partitionBy(*keys, value)
    return df.withColumn(out, F.rank().over(w) + (F.count("*").over(same) - 1) / 2)


def islands(df: DataFrame, keys: Sequence[str], order: str, flag: Column, out: str = "run") -> DataFrame:
    """Numbers the runs of equal ``flag`` within each key."""
    w = Window.partitionBy(*keys).orderBy(order)
    df = df.withColumn("_f", flag)
    df = df.withColumn("_new", F.coalesce((F.col("_f") != F.lag("_f").over(w)).cast("int"), F.lit(1)))
    return df.withColumn(out, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new", "_f")


def round_to_printed(df: DataFrame, keys: Sequence[str], value: str, ordinal: str, digits: int, target: Column | None = None, out: str = "printed", allow_negative: bool = False) -> DataFrame:
    """Largest remainder: values cut to ``digits`` whose sum within each key is that of the values, or the target, as printed.

    Works in whole units of the last digit.  Deficits go to the largest remainders, excesses come off the smallest remainders of
    those that have a unit, or of all with ``allow_negative``.  A gap of more units than there are values, or than can be
    taken back, raises an error, so that what is printed always adds up."""
    scale = float(10**digits)
    by = Window.partitionBy(*keys)
    x = F.col(value) * scale
    df = df.withColumn("_u", F.floor(x).cast("long")).withColumn("_r", x - F.floor(x))
    has = F.lit(True) if allow_negative else F.col("_u") >= 1
    wanted = F.rint((F.sum(value).over(by) if target is None else target) * scale).cast("long")
    df = df.withColumn("_gap", wanted - F.sum("_u").over(by)).withColumn("_n", F.count("*").over(by)).withColumn("_m", F.sum(has.cast("long")).over(by))
    refused = F.when(F.abs("_gap") > F.col("_n"), F.raise_error(F.lit("a gap is wider than rounding can explain"))).when(-F.col("_gap") > F.col("_m"), F.raise_error(F.lit("not enough units to take back")))
    up = F.row_number().over(by.orderBy(F.desc("_r"), ordinal))
    down = F.row_number().over(by.orderBy((~has).cast("int"), "_r", ordinal))
    step = F.when(up <= F.col("_gap"), 1).when((F.col("_gap") < 0) & has & (down <= -F.col("_gap")), -1).otherwise(0)
    return df.withColumn(out, F.coalesce(refused.cast("double"), (F.col("_u") + step) / scale)).drop("_u", "_r", "_gap", "_n", "_m")


def weighted_moments(df: DataFrame, keys: Sequence[str], y: str, w: str) -> DataFrame:
    """mean, sd and n_eff = (sum w)^2 / sum w^2, with Bessel's correction by n_eff."""
    m = df.groupBy(*keys).agg(F.sum(w).alias("_w"), F.sum(F.col(w) * F.col(y)).alias("_wy"), F.sum(F.col(w) * F.col(y) * F.col(y)).alias("_wyy"), F.sum(F.col(w) * F.col(w)).alias("_ww"))
    m = m.where("_w > 0").withColumn("mean", F.col("_wy") / F.col("_w")).withColumn("n_eff", F.col("_w") * F.col("_w") / F.col("_ww"))
    var = F.greatest(F.lit(0.0), F.col("_wyy") / F.col("_w") - F.col("mean") * F.col("mean"))
    return m.select(*keys, "mean", F.when(F.col("n_eff") > 1.000001, F.sqrt(var * F.col("n_eff") / (F.col("n_eff") - 1))).alias("sd"), "n_eff")
