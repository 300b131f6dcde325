"""Queries of external loads, dictionaries and weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import external as Y
from . import fixtures as X
from .registry import query

LOADS = "ld AS (SELECT 'site' || s_suppkey % {n} AS name, CASE s_nationkey % 3 WHEN 0 THEN 'pge' WHEN 1 THEN 'sce' ELSE 'sdge' END AS utility, 32 + (s_suppkey % {n} * 37 % 1000) / 100.0::DOUBLE AS lat, -124 + (s_suppkey % {n} * 91 % 1000) / 100.0::DOUBLE + (s_suppkey % 2) AS lon, s_acctbal AS summer_load, 2 * s_acctbal AS winter_load FROM supplier)"


def _raw(s, d, n):
    k = F.col("s_suppkey") % n
    utility = F.element_at(F.array(F.lit(" PGE"), F.lit("Sce"), F.lit("SDGE ")), (F.col("s_nationkey") % 3 + 1).cast("int"))
    x = X.read(s, d, "supplier").select(F.concat(F.lit("site"), k).alias("name"), utility.alias("utility"), k.alias("k"), "s_suppkey", F.col("s_acctbal").cast("string").alias("summer_load"), (2 * F.col("s_acctbal")).cast("string").alias("winter_load"))
    x = X.places(x, "k")
    return x.select("name", "utility", F.col("lat").cast("string").alias("latitude"), (F.col("lon") + F.col("s_suppkey") % 2).cast("string").alias("long"), "summer_load", "winter_load")


@query("seasonal_loads", f"WITH {LOADS.format(n=1000000007)} SELECT name, utility, round(lat, 6) AS lat, round(lon, 6) AS lon, summer_load, winter_load FROM ld")
def seasonal_loads(s, d):
    return Y.seasonal_loads(_raw(s, d, 1_000_000_007)).select("name", "utility", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "summer_load", "winter_load")


@query("summed_loads", f"WITH {LOADS.format(n=21)} SELECT name, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon, round(sum(summer_load), 4) AS summer_load, round(sum(winter_load), 4) AS winter_load, count(*)::BIGINT AS merged FROM ld GROUP BY name, round(lat, 3), round(lon, 3)")
def summed_loads(s, d):
    out = Y.seasonal_loads(_raw(s, d, 21), "sum")
    return out.select("name", *[F.round(c, 6).alias(c) for c in ("lat", "lon")], *[F.round(c, 4).alias(c) for c in ("summer_load", "winter_load")], "merged")


def _shape_file(s):
    rows = s.range(24 * 6).select((F.col("id") % 24).alias("hour"), F.floor(F.col("id") / 24).alias("j"))
    return rows.select(F.element_at(F.array(*map(F.lit, ("PGE ", "sce", "Sdge"))), (F.col("j") % 3 + 1).cast("int")).alias("utility"), F.when(F.col("j") < 3, "Summer").otherwise(" winter").alias("season"), F.col("hour").cast("string").alias("hour"), (F.lit(1.0) + (F.col("hour") * 7 + F.col("j") * 5) % 11).cast("string").alias("shape"))


FILE = "sf AS (SELECT ['pge', 'sce', 'sdge'][j % 3 + 1] AS utility, (j < 3)::INT AS block, h::INT AS hour, (1.0 + (h * 7 + j * 5) % 11) / avg(1.0 + (h * 7 + j * 5) % 11) OVER (PARTITION BY j) AS shape FROM range(6) a(j), range(24) b(h))"


@query("seasonal_shapes", f"WITH {FILE} SELECT utility, block, hour, round(shape, 9) AS shape FROM sf")
def seasonal_shapes(s, d):
    return Y.seasonal_shapes(_shape_file(s)).select("utility", "block", "hour", F.round("shape", 9).alias("shape"))


@query("inverted_dictionary", """WITH d AS (SELECT CASE p_size % 3 WHEN 0 THEN 'pge' ELSE 'sce' END AS utility, 'src ' || p_partkey % 97 AS s, CASE WHEN p_partkey % 10 = 0 THEN '' ELSE lower(p_name) || ' ' || p_size END AS t FROM part),
  g AS (SELECT utility, CASE WHEN t = '' THEN s ELSE t END AS key, count(DISTINCT CASE WHEN t <> '' THEN s END)::BIGINT AS n, min(CASE WHEN t <> '' THEN s END) AS p FROM d GROUP BY ALL)
  SELECT utility, key, CASE WHEN n = 1 THEN p END AS place, n, CASE WHEN n = 0 THEN 'vetoed' WHEN n > 1 THEN 'ambiguous' ELSE 'ok' END AS status FROM g""")
def inverted_dictionary(s, d):
    k = F.col("p_partkey")
    rows = X.read(s, d, "part").select(F.when(F.col("p_size") % 3 == 0, " PGE").otherwise("sce").alias("utility"), F.concat(F.lit("SRC - "), k % 97).alias("source"), F.when(k % 10 == 0, " ").otherwise(F.concat_ws(" ", F.upper("p_name"), F.lit("Substation"), "p_size")).alias("target"))
    return Y.inverted_dictionary(rows)


@query("record_index", """SELECT p_partkey % 3 AS owner, lower(p_name) AS key, count(*)::BIGINT AS records, max(p_size) AS kv, count(DISTINCT (p_partkey % 50))::BIGINT AS places FROM part GROUP BY 1, 2""")
def record_index(s, d):
    k = F.col("p_partkey")
    rows = X.places(X.read(s, d, "part").withColumn("q", k % 50), "q").select((k % 3).alias("owner"), F.concat(F.lit("P.T. "), F.upper("p_name"), F.lit("  SUBSTATION")).alias("name"), "lat", "lon", F.col("p_size").alias("kv"))
    return Y.record_index(rows).select("owner", "key", "records", "kv", "places")


WEIGHTS = f"""{FILE}, lo AS (SELECT s_suppkey AS unit, ['pge', 'sce', 'other'][s_nationkey % 3 + 1] AS utility, s_nationkey AS county, block, abs(s_acctbal) * (1 + block) AS level FROM supplier, (VALUES (0), (1)) b(block)),
  ce AS (SELECT (24 * block + h)::INT AS cell, block, h::INT AS hour FROM (VALUES (0), (1)) b(block), range(24) c(h)),
  pr AS (SELECT l_suppkey AS unit, (month(l_shipdate) BETWEEN 5 AND 10)::INT * 24 + (l_orderkey % 24)::INT AS cell, avg(l_quantity) AS shape FROM lineitem GROUP BY ALL), ow AS (SELECT * FROM pr WHERE unit % 3 = 0 AND cell % 5 > 0),
  co AS (SELECT s_nationkey AS county, cell, avg(shape) AS shape FROM pr JOIN supplier ON s_suppkey = unit WHERE s_nationkey % 2 = 0 AND unit % 3 = 0 GROUP BY ALL), fl AS (SELECT cell, avg(shape) AS shape FROM pr WHERE cell < 40 GROUP BY cell),
  mt AS (SELECT lo.unit, lo.block, ce.cell, level, CASE WHEN ow.shape IS NOT NULL THEN 'own' WHEN sf.shape IS NOT NULL THEN 'file' WHEN co.shape IS NOT NULL THEN 'county' WHEN fl.shape IS NOT NULL THEN 'fleet' ELSE 'flat' END AS route, coalesce(ow.shape, sf.shape, co.shape, fl.shape, 1.0) AS s
    FROM lo JOIN ce USING (block) LEFT JOIN ow ON ow.unit = lo.unit AND ow.cell = ce.cell LEFT JOIN sf ON sf.utility = lo.utility AND sf.block = lo.block AND sf.hour = ce.hour LEFT JOIN co ON co.county = lo.county AND co.cell = ce.cell LEFT JOIN fl ON fl.cell = ce.cell),
  ll AS (SELECT *, level * s / avg(s) OVER (PARTITION BY unit, block) AS load FROM mt)"""


@query("weight_tables", f"WITH {WEIGHTS} SELECT unit, cell, route, round(load / sum(load) OVER (PARTITION BY cell), 9) AS share FROM ll")
def weight_tables(s, d):
    x = X.read(s, d, "supplier").withColumn("block", F.explode(F.array(F.lit(0), F.lit(1))))
    utility = F.element_at(F.array(*map(F.lit, ("pge", "sce", "other"))), (F.col("s_nationkey") % 3 + 1).cast("int"))
    loads = x.select(F.col("s_suppkey").alias("unit"), utility.alias("utility"), F.col("s_nationkey").alias("county"), "block", (F.abs("s_acctbal") * (1 + F.col("block"))).alias("level"))
    cells = s.range(48).select(F.col("id").cast("int").alias("cell"), F.floor(F.col("id") / 24).cast("int").alias("block"), (F.col("id") % 24).cast("int").alias("hour"))
    p = X.read(s, d, "lineitem")
    p = p.groupBy(F.col("l_suppkey").alias("unit"), (F.month("l_shipdate").between(5, 10).cast("int") * 24 + F.col("l_orderkey") % 24).cast("int").alias("cell")).agg(F.avg("l_quantity").alias("shape"))
    placed = p.join(X.read(s, d, "supplier").select(F.col("s_suppkey").alias("unit"), F.col("s_nationkey").alias("county")), "unit")
    county = placed.where("county % 2 = 0 AND unit % 3 = 0").groupBy("county", "cell").agg(F.avg("shape").alias("shape"))
    out = Y.weight_tables(loads, cells, p.where("unit % 3 = 0 AND cell % 5 > 0"), Y.seasonal_shapes(_shape_file(s)), county, p.where("cell < 40").groupBy("cell").agg(F.avg("shape").alias("shape")))
    return out.withColumn("share", F.round("share", 9))
