"""Loads from outside: their contract, shapes from files, dictionaries of names and weights by node and cell."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cleaning import plain_name
from .allocation import refuse

#: Names under which places and voltages come.
SYNONYMS = (("lat", "latitude"), ("lon", "long"), ("lon", "longitude"), ("voltage_kv", "voltage"), ("voltage_kv", "kv"))
BLOCKS = {"winter": 0, "summer": 1}


def seasonal_loads(raw: DataFrame, duplicates: str = "error") -> DataFrame:
    """A table of name, summer_load and winter_load (and lat, lon, voltage_kv, utility, whatever they are called) as typed rows with a ``row_id``.

    Refused: half a coordinate, and one off the globe.  Of names that repeat: ``error`` refuses them, ``keep`` has each row as a
    load of its own, ``sum`` adds up rows of a name and place (to about 0.5 km, that is rounded to 0.005 degrees).  ``row_id`` is a
    hash of what the row says and, among equal rows, a number, so that it does not depend on how rows are dealt."""
    missing = [c for c in ("name", "summer_load", "winter_load") if c not in raw.columns]
    if missing:
        raise ValueError(f"the loads have no column {missing}")
    if duplicates not in ("error", "keep", "sum"):
        raise ValueError(f"unknown way with duplicates: {duplicates}")
    out = raw.withColumn("name", F.col("name").cast("string"))
    for c, other in SYNONYMS:
        if c not in out.columns and other in out.columns:
            out = out.withColumn(c, F.col(other))
    for c in ("summer_load", "winter_load", "lat", "lon", "voltage_kv"):
        out = out.withColumn(c, F.col(c).cast("string").try_cast("double") if c in out.columns else F.lit(None).cast("double"))
    out = out.withColumn("utility", F.lower(F.trim("utility")) if "utility" in out.columns else F.lit(None).cast("string"))
    out = out.where(refuse(F.col("lat").isNull() != F.col("lon").isNull(), "a row has only one of lat and lon"))
    out = out.where(refuse(F.coalesce((F.abs("lat") > 90) | (F.abs("lon") > 180), F.lit(False)), "a coordinate is off the globe"))
    columns = ["name", "utility", "lat", "lon", "voltage_kv", "summer_load", "winter_load"]
    if duplicates == "error":
        out = out.withColumn("_n", F.count("*").over(Window.partitionBy("name"))).where(refuse(F.col("_n") > 1, "a name repeats")).drop("_n")
    elif duplicates == "sum":
        place = [F.round(F.col(c) / 0.005).alias(f"_{c}") for c in ("lat", "lon")]
        out = out.groupBy("name", *place).agg(F.min("utility").alias("utility"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.max("voltage_kv").alias("voltage_kv"), F.sum("summer_load").alias("summer_load"), F.sum("winter_load").alias("winter_load"), F.count("*").alias("merged"))
        out = out.select(*columns, "merged")
    rest = [c for c in out.columns if c not in columns]
    hashed = F.xxhash64(*columns)
    return out.select(*columns, *rest).withColumn("row_id", F.concat_ws("-", hashed, F.row_number().over(Window.partitionBy(hashed).orderBy(*columns))))


def seasonal_shapes(raw: DataFrame) -> DataFrame:
    """A table of utility, season, hour and shape as ``utility``, ``block``, ``hour`` and ``shape`` with the mean 1 in each block.

    Refused: seasons other than summer and winter, what is no number, curves without all 24 hours, and means that are not positive."""
    season = F.lower(F.trim("season"))
    block = F.when(season == "winter", BLOCKS["winter"]).when(season == "summer", BLOCKS["summer"])
    out = raw.select(F.lower(F.trim("utility")).alias("utility"), block.alias("block"), F.col("hour").cast("string").try_cast("int").alias("hour"), F.col("shape").cast("string").try_cast("double").alias("shape"))
    out = out.where(refuse(F.col("block").isNull(), "unknown season")).where(refuse(F.col("hour").isNull() | F.col("shape").isNull(), "an hour or shape is no number"))
    curves = out.groupBy("utility", "block").agg(F.countDistinct("hour").alias("_n"), F.avg("shape").alias("_m"))
    curves = curves.where(refuse(F.col("_n") != 24, "a curve needs all 24 hours")).where(refuse(~(F.col("_m") > 0), "a curve's mean is not positive"))
    return out.join(curves, ["utility", "block"]).select("utility", "block", "hour", (F.col("shape") / F.col("_m")).alias("shape"))


def inverted_dictionary(dictionary: DataFrame) -> DataFrame:
    """From target names back to sources, by utility: ``key``, ``place``, ``n`` and ``status``: ok, ambiguous, or vetoed by a blank target.

    ``dictionary``: utility, source, target.  Keys of vetoed sources are those of the sources themselves."""
    rows = dictionary.select(F.lower(F.trim("utility")).alias("utility"), plain_name(F.col("source")).alias("_source"), plain_name(F.col("target")).alias("_target"))
    key = F.when(F.col("_target") == "", F.col("_source")).otherwise(F.col("_target"))
    vetoed = F.max((F.col("_target") == "").cast("int"))
    out = rows.groupBy("utility", key.alias("key")).agg(F.countDistinct(F.when(F.col("_target") != "", F.col("_source"))).alias("n"), F.min(F.when(F.col("_target") != "", F.col("_source"))).alias("place"), vetoed.alias("_v"))
    status = F.when(F.col("n") == 0, "vetoed").when(F.col("n") > 1, "ambiguous").otherwise("ok")
    return out.select("utility", "key", F.when(F.col("n") == 1, F.col("place")).alias("place"), "n", status.alias("status"))


def record_index(records: DataFrame) -> DataFrame:
    """An inventory (owner, name, lat, lon, kv) by owner and plain name: places, the highest voltage and whether it is one place only."""
    keyed = records.withColumn("key", plain_name(F.col("name"))).where("key <> ''")
    return keyed.groupBy("owner", "key").agg(F.count("*").alias("records"), F.max("kv").alias("kv"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.countDistinct(F.struct("lat", "lon")).alias("places"))


def weight_tables(loads: DataFrame, cells: DataFrame, own: DataFrame, files: DataFrame, county: DataFrame, fleet: DataFrame) -> DataFrame:
    """Shares of each cell's load by unit: level times shape, the shape by the first route that has one.

    ``loads``: unit, utility, county, block, level; ``cells``: cell, block, hour (at most a few hundred); ``own``: unit, cell, shape; ``files``: utility, block,
    hour, shape; ``county``: county, cell, shape; ``fleet``: cell, shape; else 1.  Shapes are brought to the mean 1 in each block, so
    that a unit's seasonal level keeps its meaning; then each cell's loads are shares."""
    grid = loads.join(F.broadcast(cells), "block")
    named = lambda df, keys, out: df.select(*keys, F.col("shape").alias(out))
    met = grid.join(named(own, ["unit", "cell"], "_o"), ["unit", "cell"], "left").join(F.broadcast(named(fleet, ["cell"], "_t")), "cell", "left")
    met = met.join(named(files, ["utility", "block", "hour"], "_f"), ["utility", "block", "hour"], "left").join(named(county, ["county", "cell"], "_c"), ["county", "cell"], "left")
    route = F.when(F.col("_o").isNotNull(), "own").when(F.col("_f").isNotNull(), "file").when(F.col("_c").isNotNull(), "county").when(F.col("_t").isNotNull(), "fleet").otherwise("flat")
    met = met.withColumn("route", route).withColumn("_s", F.coalesce("_o", "_f", "_c", "_t", F.lit(1.0)))
    means = met.groupBy("unit", "block").agg(F.avg("_s").alias("_m"))
    met = met.join(means, ["unit", "block"]).withColumn("load", F.col("level") * F.when(F.col("_m") > 0, F.col("_s") / F.when(F.col("_m") > 0, F.col("_m"))).otherwise(1.0))
    totals = met.groupBy("cell").agg(F.sum("load").alias("_l")).where(refuse(~(F.col("_l") > 0), "a cell has no load"))
    return met.join(F.broadcast(totals), "cell").select("unit", "cell", "route", (F.col("load") / F.col("_l")).alias("share"))
