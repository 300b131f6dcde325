"""Queries of pools, cells, fallbacks, input checks and comparisons of demand."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scenarios as C
from ..operators import spatial as P
from ..operators import statistics as T
from ..operators import stochastic as E
from ..operators import weights as W
from . import fixtures as X
from .registry import query

KM = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"
NODES = "n AS (SELECT s_suppkey AS node, s_nationkey AS county, greatest(s_acctbal, 0) AS weight, s_suppkey % 3 <> 0 AS covered FROM supplier)"


def _nodes(s, d):
    return X.read(s, d, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("county"), F.greatest("s_acctbal", F.lit(0.0)).alias("weight"), (F.col("s_suppkey") % 3 != 0).alias("covered"))


@query("pool_shares", f"""WITH {NODES}, p AS (SELECT * FROM n QUALIFY avg(covered::INT) OVER (PARTITION BY county) >= 0.6 OR covered), t AS (SELECT count(*) AS c, sum((NOT covered)::INT) AS u, sum(CASE WHEN covered THEN weight ELSE 0 END) AS w FROM p)
  SELECT node, round(CASE WHEN covered THEN (1 - u / c) * weight / w ELSE 1.0::DOUBLE / c END, 9) AS share FROM p, t""")
def pool_shares(s, d):
    return C.pool_shares(_nodes(s, d), 0.6).select("node", F.round("share", 9).alias("share"))


@query("hold_shares", f"WITH {NODES} SELECT node, round(weight / sum(weight) OVER (), 9) AS share FROM n WHERE covered AND weight > 0")
def hold_shares(s, d):
    return C.hold_shares(_nodes(s, d).where("covered")).select("node", F.round("share", 9).alias("share"))


def _custom(s):
    hours = s.range(288).select((F.col("id") % 12 + 1).cast("int").alias("month"), F.floor(F.col("id") / 12).cast("int").alias("hour"))
    return hours.withColumn("cell", (F.floor((F.col("month") - 1) / 3) * 4 + F.floor(F.col("hour") / 6)).cast("int"))


@query("custom_cells", X.sql("SELECT ((month(t) - 1) // 3 * 4 + hour(t) // 6)::INT AS cell, count(*)::BIGINT AS n, round(sum(mw), 5) AS mw FROM series GROUP BY 1"))
def custom_cells(s, d):
    x = X.series(s, d).withColumn("month", F.month("t")).withColumn("hour", F.hour("t"))
    return C.encoded(x, _custom(s)).groupBy("cell").agg(F.count("*").alias("n"), F.round(F.sum("mw"), 5).alias("mw"))


@query("straddling_cells", "SELECT ((m - 1) // 3 * 4 + h // 6)::INT AS cell, count(DISTINCT h // 4)::BIGINT AS coarse FROM range(1, 13) a(m), range(24) b(h) GROUP BY 1 HAVING count(DISTINCT h // 4) <> 1")
def straddling_cells(s, d):
    return C.straddling(_custom(s), _custom(s).withColumn("cell", F.floor(F.col("hour") / 4)))


@query("resampled_days")
def resampled_days(s, d):
    x = X.series(s, d).where("region = 0").withColumn("hour", F.hour("t"))
    return C.resampled(E.standardised(x).select("t", "z"), x.select("t"), 2, 7)


SHAPES = ", loads AS (SELECT unit, month, avg((min_load + max_load) / 2) AS l FROM profiles GROUP BY ALL), shapes AS (SELECT unit, month AS cell, l / avg(l) OVER (PARTITION BY unit) AS shape FROM loads)"


@query("fallback_shapes", X.sql(f"""{SHAPES}, own AS (SELECT * FROM shapes WHERE unit % 3 <> 0), c AS (SELECT county, cell, avg(shape) AS c FROM own JOIN units USING (unit) GROUP BY ALL HAVING count(DISTINCT unit) >= 2),
  f AS (SELECT cell, avg(shape) AS f FROM own GROUP BY cell), g AS (SELECT u.unit, f.cell, CASE WHEN o.shape IS NOT NULL THEN 'own' WHEN c IS NOT NULL THEN 'county' ELSE 'fleet' END AS route, coalesce(o.shape, c, f) AS s
  FROM units u CROSS JOIN f LEFT JOIN own o ON o.unit = u.unit AND o.cell = f.cell LEFT JOIN c ON c.county = u.county AND c.cell = f.cell) SELECT unit, cell, route, round(s / avg(s) OVER (PARTITION BY unit), 6) AS shape FROM g"""))
def fallback_shapes(s, d):
    loads = W.average_load(X.profiles(s, d)).groupBy("unit", "month").agg(F.avg("avg_load").alias("l"))
    shapes = T.magnitude_and_shape(loads, "l").select("unit", F.col("month").alias("cell"), "shape")
    own = shapes.where("unit % 3 <> 0")
    return C.shapes_with_fallback(X.units(s, d), own, own, 2).withColumn("shape", F.round("shape", 6))


@query("envelope_problems", X.sql("""SELECT problem, count(*)::BIGINT AS n FROM (SELECT unnest(list_filter([CASE WHEN lo = hi THEN 'zero width' END, CASE WHEN lo < 3 THEN 'low' END,
  CASE WHEN hi > 45 THEN 'high' END], lambda x: x IS NOT NULL)) AS problem FROM (SELECT round(min_load, 6) AS lo, round(max_load, 6) AS hi FROM profiles)) GROUP BY problem"""))
def envelope_problems(s, d):
    low, high = F.round("min_load", 6), F.round("max_load", 6)
    return C.problems(X.profiles(s, d), {"zero width": low == high, "low": low < 3, "high": high > 45, "inverted": low > high})


@query("demand_divergence", """WITH a AS (SELECT l_partkey AS node, sum(l_quantity) AS mw FROM lineitem WHERE l_linenumber = 1 GROUP BY 1), b AS (SELECT l_partkey AS node, sum(l_quantity) AS mw FROM lineitem WHERE l_linenumber = 2 GROUP BY 1),
  j AS (SELECT coalesce(a.mw, 0) AS x, coalesce(b.mw, 0) AS y FROM a FULL JOIN b USING (node)), t AS (SELECT sum(x) AS sx, sum(y) AS sy FROM j)
  SELECT round(sum(abs(x / sx - y / sy)) / 2, 6) AS relocated, round(sqrt(avg((x - y) * (x - y))), 5) AS rmse, round(sqrt(avg((x - y) * (x - y))) / avg(x) FILTER (x > 0), 6) AS nrmse, round(corr(x, y), 6) AS pearson,
  round(count(*) FILTER (x > 0 AND y > 0) / count(*)::DOUBLE, 6) AS jaccard FROM j, t""")
def demand_divergence(s, d):
    x = X.read(s, d, "lineitem", "l_partkey", "l_quantity", "l_linenumber")
    a, b = (x.where(f"l_linenumber = {i}").groupBy(F.col("l_partkey").alias("node")).agg(F.sum("l_quantity").cast("double").alias("mw")) for i in (1, 2))
    return C.demand_divergence(a, b).select(*[F.round(c, n).alias(c) for c, n in (("relocated", 6), ("rmse", 5), ("nrmse", 6), ("pearson", 6), ("jaccard", 6))])


@query("median_peak_year", """WITH y AS (SELECT year(o_orderdate)::INT AS year, max(o_totalprice) AS peak FROM orders GROUP BY 1)
  SELECT year, round(peak, 2) AS peak FROM y QUALIFY row_number() OVER (ORDER BY peak, year) - 1 = count(*) OVER () // 2""")
def median_peak_year(s, d):
    x = X.read(s, d, "orders").select(F.col("o_orderdate").alias("t"), F.col("o_totalprice").alias("mw"))
    return C.median_peak_year(x).withColumn("peak", F.round("peak", 2))


@query("compared_names", """WITH a AS (SELECT DISTINCT p_name AS name FROM part WHERE p_size <= 3), b AS (SELECT DISTINCT p_name AS name FROM part WHERE p_size >= 48)
  SELECT coalesce(a.name, b.name) AS name, CASE WHEN b.name IS NULL THEN 'left' WHEN a.name IS NULL THEN 'right' ELSE 'both' END AS side FROM a FULL JOIN b ON a.name = b.name""")
def compared_names(s, d):
    x = X.read(s, d, "part").withColumnRenamed("p_name", "name")
    return C.compared_sets(x.where("p_size <= 3"), x.where("p_size >= 48"), ["name"])


@query("distance_bands", X.sql(f""", near AS (SELECT a.k, min({KM}) AS km FROM places a, spots b GROUP BY a.k)
  SELECT ((km >= 1)::INT + (km >= 5)::INT + (km >= 20)::INT + (km >= 50)::INT)::INT AS band, count(*)::BIGINT AS n, round(quantile_cont(km, 0.5), 6) AS median_km FROM near GROUP BY 1"""))
def distance_bands(s, d):
    left = X.places(X.read(s, d, "supplier").select(F.col("s_suppkey").alias("k")), "k")
    right = X.places(X.read(s, d, "part").select(F.col("p_partkey").alias("k")), "k")
    return C.distance_bands(P.k_nearest(left, right, 1), "km", (1, 5, 20, 50)).withColumn("median_km", F.round("median_km", 6))


@query("common_value", "WITH c AS (SELECT l_suppkey AS unit, l_returnflag AS flag, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2) SELECT unit, flag, n FROM c QUALIFY row_number() OVER (PARTITION BY unit ORDER BY n DESC, flag) = 1")
def common_value(s, d):
    return C.common_value(X.read(s, d, "lineitem").select(F.col("l_suppkey").alias("unit"), F.col("l_returnflag").alias("flag")), ["unit"], "flag")


@query("class_percentages", "SELECT p_brand AS brand, round(100 * count(*) FILTER (p_size < 17) / count(*)::DOUBLE, 6) AS small, round(100 * count(*) FILTER (p_size >= 17) / count(*)::DOUBLE, 6) AS large FROM part GROUP BY 1")
def class_percentages(s, d):
    share = lambda c: F.round(100 * F.avg(c.cast("double")), 6)
    return X.read(s, d, "part").groupBy(F.col("p_brand").alias("brand")).agg(share(F.col("p_size") < 17).alias("small"), share(F.col("p_size") >= 17).alias("large"))
