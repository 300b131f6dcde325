"""Queries of the forms that files have: pushed filters, labelled rows, calendars, gaps and printed values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scenarios as C
from ..sources import tables as Z
from . import fixtures as X
from .registry import query


@query("regions_read", "SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_regionkey IN (1, 3)")
def regions_read(s, d):
    """The list reaches the scan as a pushed filter."""
    return X.read(s, d, "nation").where(F.col("n_regionkey").isin(1, 3)).select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))


@query("labelled_rows", """WITH x AS (SELECT 't' || p_partkey AS label, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size::DOUBLE END AS a, p_retailprice AS b FROM part WHERE p_partkey % 3 > 0)
  SELECT label, 'a' AS "column", a AS value FROM x UNION ALL SELECT label, 'b', b FROM x""")
def labelled_rows(s, d):
    k = F.col("p_partkey")
    label = F.when(k % 3 > 0, F.concat(F.lit("t"), k)).otherwise(F.concat(F.lit("Sum"), k))
    rows = X.read(s, d, "part").select(label.alias("label"), F.when(F.col("p_size") % 5 == 0, "-").otherwise(F.col("p_size").cast("string")).alias("a"), F.col("p_retailprice").cast("string").alias("b"))
    return Z.labelled_rows(rows, "label")


@query("week_calendar", """WITH w(season, start) AS (VALUES ('a', TIMESTAMP '2019-01-07 08:00:00'), ('b', TIMESTAMP '2019-07-01 08:00:00')) SELECT season, i::INT AS i, month(start + to_hours(i - 8))::INT AS month, hour(start + to_hours(i - 8))::INT AS hour FROM w, range(168) t(i)""")
def week_calendar(s, d):
    starts = s.createDataFrame([("a", "2019-01-07 08:00:00"), ("b", "2019-07-01 08:00:00")], "season string, start string")
    return Z.week_calendar(starts.withColumn("start", F.col("start").cast("timestamp")))


@query("gaps_in_series", X.sql(" SELECT region, t, seconds FROM (SELECT region, t, (epoch(t) - epoch(lag(t) OVER (PARTITION BY region ORDER BY t)))::BIGINT AS seconds FROM series) WHERE seconds <> 3600"))
def gaps_in_series(s, d):
    return Z.gaps(X.series(s, d), ["region"], "t").select("region", "t", "seconds")


@query("printed_values", "SELECT s_suppkey AS k, printf('%.1f', round_even(s_acctbal, 1) + 0.0) AS printed FROM supplier")
def printed_values(s, d):
    return Z.printed(X.read(s, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("printed")), ["printed"], 1)


@query("wide_demand", X.sql(" SELECT t, round(coalesce(sum(mw) FILTER (region = 0), 0), 5) AS \"0\", round(coalesce(sum(mw) FILTER (region = 4), 0), 5) AS \"4\" FROM series GROUP BY t"))
def wide_demand(s, d):
    out = Z.wide(X.series(s, d), "t", "region", "mw", [0, 4])
    return out.select("t", F.round("0", 5).alias("0"), F.round("4", 5).alias("4"))


@query("cells_by_label", X.sql(" SELECT (month(t) * 2 + hour(t) // 12)::INT AS cell, count(*)::BIGINT AS n FROM series GROUP BY 1"))
def cells_by_label(s, d):
    cells = s.range(288).select((F.col("id") % 12 + 1).cast("int").alias("month"), F.floor(F.col("id") / 12).cast("int").alias("hour"))
    cells = cells.withColumn("cell", (F.col("month") * 2 + F.floor(F.col("hour") / 12)).cast("int"))
    x = X.series(s, d).withColumn("month", F.month("t")).withColumn("hour", F.hour("t"))
    return C.encoded(x, cells.unionByName(cells)).groupBy("cell").agg(F.count("*").alias("n"))
