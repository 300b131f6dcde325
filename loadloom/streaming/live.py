"""Series that arrive as streams: hourly sums, disaggregation as they come, repeats and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly(stream: DataFrame, keys: list[str], value: str, late: str = "2 hours", width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Sums by key and window; rows later than ``late`` behind the latest are left out.  State is a row a key and open window."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    sums = stream.withWatermark("ts", late).groupBy(window.alias("w"), *keys).agg(F.sum(value).alias("mw"), F.count("*").alias("n"))
    return sums.select(F.col("w.start").alias("t"), *keys, "mw", "n")


def disaggregated(stream: DataFrame, weights: DataFrame) -> DataFrame:
    """Rows (region, t, mw) dealt to units by a table of weights (region, unit, month, hour, weight); no state is kept."""
    timed = stream.withColumn("month", F.month("t")).withColumn("hour", F.hour("t"))
    return timed.join(weights, ["region", "month", "hour"]).select("region", "unit", "t", (F.col("mw") * F.col("weight")).alias("load"))


def without_repeats(stream: DataFrame, key: str, late: str = "2 hours") -> DataFrame:
    """The first row of each key; a repeat is known for as long as the watermark is behind it."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def sessions(stream: DataFrame, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Runs of a key's rows without a pause of ``gap``."""
    found = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return found.select(key, F.col("w.start").alias("begins"), F.col("w.end").alias("ends"), "n")


def drain(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Writes all that has arrived as Parquet and ends; called again with the same checkpoint it goes on from there."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
