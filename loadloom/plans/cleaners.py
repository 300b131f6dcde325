"""Queries of cleaners over the driver's tables put into the shape of raw sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cleaners as K
from . import fixtures as X
from .registry import query

STANDARD = "CASE WHEN month BETWEEN 3 AND 10 THEN (hour + 23) % 24 ELSE hour END::INT"
CELLS = "x AS (SELECT 'SUPPLIER#' || lpad(l_suppkey::VARCHAR, 9, '0') AS name, month(l_shipdate)::INT AS month, (l_orderkey % 24)::INT AS hour, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY ALL)"


def _cells(s, d):
    x = X.read(s, d, "lineitem").withColumn("name", F.format_string(" Supplier#%09d ", "l_suppkey"))
    return x.groupBy("name", F.month("l_shipdate").alias("month"), (F.col("l_orderkey") % 24).cast("int").alias("hour")).agg(F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))


@query("cells_in_kw", f"WITH {CELLS} SELECT 'pge' AS utility, name, month, hour, lo / 1000 AS min_load, hi / 1000 AS max_load, {STANDARD} AS hour_standard FROM x")
def cells_in_kw(s, d):
    raw = _cells(s, d).select("name", F.concat_ws("_", "month", "hour").alias("monthhour"), F.col("lo").cast("string").alias("low"), F.col("hi").cast("string").alias("high"))
    passing = raw.withColumn("name", F.concat("name", F.lit("P.T.")))
    return K.cells_in_kw(raw.unionByName(passing), "pge")


@query("cells_in_amps", f"WITH {CELLS} SELECT 'sce' AS utility, name, month, hour, round(lo * 2 * sqrt(3) * 0.95 * 12.5 / 1000, 9) AS min_load, round(hi * 2 * sqrt(3) * 0.95 * 12.5 / 1000, 9) AS max_load, {STANDARD} AS hour_standard FROM x")
def cells_in_amps(s, d):
    kinds = F.explode(F.array(F.struct(F.lit("min").alias("kind"), F.col("lo").alias("amps")), F.struct(F.lit("max").alias("kind"), F.col("hi").alias("amps"))))
    rows = _cells(s, d).withColumn("_k", kinds).select("name", "month", "hour", "_k.*").withColumn("voltage", F.explode(F.array(F.lit("12.5KV"), F.lit("12.5 kv "), F.lit("?"))))
    return K.cells_in_amps(rows, "sce").withColumn("min_load", F.round("min_load", 9)).withColumn("max_load", F.round("max_load", 9))


@query("cells_in_columns", f"WITH {CELLS} SELECT 'sdge' AS utility, name, month, h::INT AS hour, max(lo) FILTER (hour = h) AS min_load, max(hi) FILTER (hour = h) AS max_load FROM x, range(24) t(h) GROUP BY name, month, h")
def cells_in_columns(s, d):
    kinds = F.explode(F.array(F.struct(F.lit("min").alias("kind"), F.col("lo").alias("mw")), F.struct(F.lit("max").alias("kind"), F.col("hi").alias("mw"))))
    rows = _cells(s, d).withColumn("_k", kinds).select("name", "month", "hour", "_k.*")
    wide = rows.groupBy("name", "month", "kind").pivot("hour", list(range(24))).agg(F.max("mw")).withColumnsRenamed({str(i): f"h{i}" for i in range(24)})
    both = wide.withColumn("year", F.lit(2024)).unionByName(wide.withColumn("year", F.lit(2023)).withColumn("h0", F.lit(-1.0)))
    return K.cells_in_columns(both, "sdge")


@query("hourly_forecasts", """SELECT 2025 AS vintage, 'PGE' AS utility, 'Local_Reliability' AS scenario, strftime(o_orderdate + to_hours(o_orderkey % 24), '%Y-%m-%d %H:%M:%S') AS t, round(sum(o_totalprice), 2) AS mw FROM orders GROUP BY 4""")
def hourly_forecasts(s, d):
    o = X.read(s, d, "orders").groupBy("o_orderdate", (F.col("o_orderkey") % 24 + 1).cast("int").alias("HOUR")).agg(F.round(F.sum("o_totalprice"), 2).alias("mw"))
    raw = o.select(F.year("o_orderdate").alias("YEAR"), F.month("o_orderdate").alias("MONTH"), F.dayofmonth("o_orderdate").alias("DAY"), "HOUR", "mw")
    files = raw.withColumn("path", F.explode(F.array(F.lit("a/2025/Hourly Forecast - PGE - Local Reliability - Corrected.xlsx"), F.lit("a/2025/Hourly Forecast - CAISO - Local Reliability.xlsx"))))
    return K.hourly_forecast(files, "path").select("vintage", "utility", "scenario", F.date_format("t", "yyyy-MM-dd HH:mm:ss").alias("t"), "mw")


AREAS = {"click": "Area C", "error": "Area E", "view": "Area V"}


@query("area_operations", """WITH e AS (SELECT date_trunc('hour', ts) - INTERVAL 9 HOUR AS t, event_type AS area, CASE WHEN event_id % 3 = 0 THEN value * 2 ELSE value END AS demand, user_id::DOUBLE AS generation FROM events WHERE event_type IN ('click', 'error', 'view'))
  SELECT strftime(t, '%Y-%m-%d %H:%M:%S') AS t, area, 'Area ' || upper(area[1]) AS name, demand, generation FROM e QUALIFY row_number() OVER (PARTITION BY t, area ORDER BY demand, generation) = 1""")
def area_operations(s, d):
    e = X.read(s, d, "events").select(F.date_trunc("hour", "ts").alias("utc"), F.col("event_type").alias("area"), F.col("value").alias("demand"), F.when(F.col("event_id") % 3 == 0, F.col("value") * 2).alias("demand_revised"), F.col("user_id").alias("generation"))
    return K.operations(e, AREAS).withColumn("t", F.date_format("t", "yyyy-MM-dd HH:mm:ss"))


@query("area_interchange", """WITH e AS (SELECT date_trunc('day', ts) AS utc, 'a' || user_id % 4 AS a, 'a' || event_id % 4 AS b, value AS v FROM events WHERE user_id % 4 <> event_id % 4), o AS (SELECT utc, least(a, b) AS source, greatest(a, b) AS target, avg(CASE WHEN a > b THEN -v ELSE v END) AS mwh FROM e GROUP BY ALL)
  SELECT utc, source, target, round(mwh, 6) AS mwh FROM o WHERE utc <= (SELECT min(l) FROM (SELECT max(utc) AS l FROM o GROUP BY source, target))""")
def area_interchange(s, d):
    e = X.read(s, d, "events").select(F.date_trunc("day", "ts").alias("utc"), F.concat(F.lit("a"), F.col("user_id") % 4).alias("source"), F.concat(F.lit("a"), F.col("event_id") % 4).alias("target"), F.col("value").alias("mwh")).where("source <> target")
    return K.interchange(e).withColumn("mwh", F.round("mwh", 6))


@query("fractions_in_state", "SELECT year(o_orderdate)::INT AS year, o_orderpriority AS area, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END) / sum(o_totalprice), 9) AS fraction, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL")
def fractions_in_state(s, d):
    o = X.read(s, d, "orders").select(F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("area"), F.col("o_orderstatus").alias("state"), F.col("o_totalprice").alias("mwh"))
    return K.fraction_in_state(o, "F").select("year", "area", F.round("fraction", 9).alias("fraction"), F.round("total", 2).alias("total"))


@query("scenarios_by_bus", "SELECT p_partkey AS bus, p_size::DOUBLE AS low, p_size * 2.0::DOUBLE AS high FROM part")
def scenarios_by_bus(s, d):
    text = F.format_string('[{"scenario": "low", "mw": %d}, {"scenario": "high", "mw": %d}, {"scenario": "other", "mw": 1}]', "p_size", F.col("p_size") * 2)
    return K.scenarios_by_bus(X.read(s, d, "part").select(F.col("p_partkey").alias("bus"), text.alias("props")), "props", ["low", "high"])


@query("sheet_without_notes", "SELECT year(o_orderdate)::INT AS year, count(*)::BIGINT AS n FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY 1")
def sheet_without_notes(s, d):
    cell = F.when(F.col("o_orderkey") % 7 == 0, "* note 2024").otherwise(F.concat(F.lit(" "), F.year("o_orderdate").cast("string")))
    return K.without_footnotes(X.read(s, d, "orders").select(cell.alias("year")), "year").groupBy("year").agg(F.count("*").alias("n"))
