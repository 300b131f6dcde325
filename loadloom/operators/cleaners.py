"""Cleaners of raw sources: profiles by month and hour, hourly forecasts, operations and interchange of areas, sales by state."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cleaning as N
from ..functions import scalar as S
from .allocation import refuse


def canonical(df: DataFrame, name: str) -> DataFrame:
    """Names in capitals without blanks around or between single letters; pass-through sites go."""
    text = F.upper(F.trim(name))
    return df.where(~F.coalesce(S.pass_through(F.col(name)), F.lit(False))).withColumn(name, F.regexp_replace(text, r"\b([A-Z]) ([A-Z])\b", "$1$2"))


def cells_in_kw(raw: DataFrame, utility: str) -> DataFrame:
    """Profiles (name, monthhour such as 7_18, low and high in kW, as texts) as utility, name, month, hour, hour_standard, min_load and max_load in MW."""
    month, hour = N.split_cell(F.col("monthhour"))
    number = lambda c: N.kw_to_mw(F.col(c).cast("string").try_cast("double"))
    out = canonical(raw, "name").select(F.lit(utility).alias("utility"), "name", month.alias("month"), hour.alias("hour"), number("low").alias("min_load"), number("high").alias("max_load"))
    return out.withColumn("hour_standard", S.wall_clock_to_standard(F.col("month"), F.col("hour")))


def cells_in_amps(raw: DataFrame, utility: str) -> DataFrame:
    """Profiles by circuit (name, voltage such as 12KV, month, hour, amps) as the least and greatest sum of a site's circuits in MW.

    ``kind`` tells least from greatest (min, max); circuits whose voltage can't be read are left out of the sums."""
    mw = N.amps_to_mw(F.col("amps").cast("double"), N.kilovolts(F.col("voltage")))
    sums = canonical(raw, "name").groupBy("name", "month", "hour").agg(F.sum(F.when(F.col("kind") == "min", mw)).alias("min_load"), F.sum(F.when(F.col("kind") == "max", mw)).alias("max_load"))
    return sums.select(F.lit(utility).alias("utility"), "name", "month", "hour", "min_load", "max_load", S.wall_clock_to_standard(F.col("month"), F.col("hour")).alias("hour_standard"))


def cells_in_columns(raw: DataFrame, utility: str, keys: Sequence[str] = ("name", "month", "kind")) -> DataFrame:
    """Profiles with a column for each hour (h0 to h23) and rows of kind min and max, long, both bounds in a row; of several years the latest counts."""
    columns = [f"h{i}" for i in range(24)]
    if "year" in raw.columns:
        newest = raw.groupBy(*keys).agg(F.max("year").alias("year"))
        raw = raw.join(newest, [*keys, "year"])
    long = canonical(raw, "name").unpivot(list(keys), columns, "hour", "mw").withColumn("hour", F.substring("hour", 2, 2).cast("int"))
    pick = lambda kind: F.avg(F.when(F.col("kind") == kind, F.col("mw").cast("double")))
    return long.groupBy("name", "month", "hour").agg(pick("min").alias("min_load"), pick("max").alias("max_load")).withColumn("utility", F.lit(utility))


def hourly_forecast(raw: DataFrame, path: str) -> DataFrame:
    """Rows of a forecast's files (YEAR, MONTH, DAY, HOUR from 1, ``path`` and values) with vintage, utility, scenario and the hour that
    begins; files that are no hourly forecasts of a utility are left out, and repeats of an hour refused."""
    told = raw.withColumn("_f", N.forecast_file(F.col(path))).where("_f IS NOT NULL")
    at = N.timestamp_of(F.col("YEAR"), F.col("MONTH"), F.col("DAY"), N.hour_beginning(F.col("HOUR")))
    out = told.withColumns({"vintage": F.col("_f.vintage"), "utility": F.col("_f.utility"), "scenario": F.col("_f.scenario"), "t": at}).drop("_f", path)
    keys = ["vintage", "utility", "scenario", "t"]
    once = out.groupBy(*keys).agg(F.count("*").alias("_n")).where(refuse(F.col("_n") > 1, "an hour of a forecast repeats"))
    return out.join(once.drop("_n"), keys)


def operations(raw: DataFrame, areas: Mapping[str, str]) -> DataFrame:
    """Hourly operations (utc, area, demand, generation, interchange) of known areas, named, in standard time; where a value was revised,
    the revised one counts; of rows of an hour and area the first by value is kept."""
    named = raw.where(F.col("area").isin(*areas)).withColumn("name", N.mapped(F.col("area"), areas))
    columns = [c for c in ("demand", "generation", "interchange") if c in raw.columns]
    best = lambda c: F.coalesce(F.col(f"{c}_revised"), F.col(c)) if f"{c}_revised" in raw.columns else F.col(c)
    values = named.select(N.utc_ending_to_standard(F.col("utc")).alias("t"), "area", "name", *[best(c).cast("double").alias(c) for c in columns])
    return values.groupBy("t", "area", "name").agg(F.min(F.struct(*columns)).alias("_v")).select("t", "area", "name", "_v.*")


def interchange(raw: DataFrame, end: str = "min") -> DataFrame:
    """Edges (utc, source, target, mwh) with each pair in one direction, by name: swapped rows change their sign; repeats of an edge and hour are
    averaged; hours beyond the earliest of the areas' last ones are cut off."""
    flipped = F.col("source") > F.col("target")
    ordered = raw.select("utc", F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target"), F.when(flipped, -F.col("mwh")).otherwise(F.col("mwh")).alias("mwh"))
    edges = ordered.groupBy("utc", "source", "target").agg(F.avg("mwh").alias("mwh"))
    last = edges.groupBy("source", "target").agg(F.max("utc").alias("_l")).agg(F.min("_l").alias("_l"))
    return edges.join(F.broadcast(last), F.col("utc") <= F.col("_l")).drop("_l")  # a single row


def fraction_in_state(sales: DataFrame, state: str) -> DataFrame:
    """By year and area: the state's part of all sales (year, area, state, mwh); null where there are none."""
    inside = F.sum(F.when(F.col("state") == state, F.col("mwh")).otherwise(0.0))
    return sales.groupBy("year", "area").agg((inside / F.nullif(F.sum("mwh"), F.lit(0.0))).alias("fraction"), F.sum("mwh").alias("total"))


def scenarios_by_bus(raw: DataFrame, props: str, scenarios: Sequence[str]) -> DataFrame:
    """A row a bus with a column for each scenario, from rows of JSON texts with a list of (scenario, mw)."""
    parsed = raw.withColumn("_s", F.explode(F.from_json(props, "array<struct<scenario: string, mw: double>>")))
    return parsed.groupBy("bus").pivot("_s.scenario", list(scenarios)).agg(F.sum("_s.mw"))


def without_footnotes(sheet: DataFrame, year: str) -> DataFrame:
    """Rows of a sheet read as texts whose year has four digits; others are headers and notes."""
    return sheet.where(F.trim(year).rlike(r"^\d{4}$")).withColumn(year, F.trim(year).cast("int"))
