"""Queries of names, catchments, mappings and surfaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import allocation as A
from ..operators import matching as M
from ..operators import relational as R
from ..operators import spatial as P
from ..operators import surfaces as U
from . import fixtures as X
from .registry import query

KM = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"
PAIRS = f"pairs AS (SELECT a.k, b.k AS other, {KM} AS km FROM places a, spots b)"


def _parts(s, d):
    return X.read(s, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"), "p_brand", "p_size")


def _sides(s, d):
    left = X.places(X.read(s, d, "supplier").select(F.col("s_suppkey").alias("k")), "k")
    return left, X.places(_parts(s, d).select("k"), "k")


@query("fuzzy_names")
def fuzzy_names(s, d):
    parts = _parts(s, d)
    return M.fuzzy_join(parts.select("k", "name"), parts.select("name"))


@query("name_variants", r"""WITH v AS (SELECT p_partkey AS k, p_name AS name, r.rule, trim(regexp_replace(p_name, r.p, r.w, 'g')) AS variant FROM part, (VALUES (1, '[aeiou]', ''), (2, ' .*$', ''), (3, '^[^ ]* ', '')) r(rule, p, w))
  SELECT k, name, variant, min(rule)::INT AS rule FROM v WHERE variant <> name AND variant <> '' GROUP BY ALL""")
def name_variants(s, d):
    return M.name_variants(_parts(s, d).select("k", "name"), [("[aeiou]", ""), (" .*$", ""), ("^[^ ]* ", "")])


@query("name_cascade", """WITH i AS (SELECT 0 AS r, p_name AS key, p_brand AS place FROM part WHERE p_size <= 2 UNION ALL SELECT 1, split_part(p_name, ' ', 1), p_brand FROM part WHERE p_size = 50),
  x AS (SELECT r, key, count(DISTINCT place) AS n, min(place) AS place FROM i GROUP BY ALL),
  c AS (SELECT p_partkey AS k, r, n, place FROM part JOIN x ON key = CASE r WHEN 0 THEN p_name ELSE split_part(p_name, ' ', 1) END QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY r) = 1)
  SELECT p_partkey AS k, CASE WHEN n = 1 THEN place END AS place, CASE r WHEN 0 THEN 'name' WHEN 1 THEN 'first word' END AS route,
  CASE WHEN r IS NULL THEN 'unmatched' WHEN n > 1 THEN 'ambiguous' ELSE 'resolved' END AS status FROM part LEFT JOIN c ON c.k = p_partkey""")
def name_cascade(s, d):
    parts = _parts(s, d)
    word = F.split_part("name", F.lit(" "), F.lit(1))
    exact = parts.where("p_size <= 2").select(F.col("name").alias("key"), F.col("p_brand").alias("place"))
    loose = parts.where("p_size = 50").select(word.alias("key"), F.col("p_brand").alias("place"))
    return M.resolve_names(parts.select("k", "name"), [("name", F.col("name"), exact), ("first word", word, loose)]).select("k", "place", "route", "status")


@query("checked_edges", """WITH e AS (SELECT l_partkey % 300 AS node, l_suppkey AS unit, l_discount - 0.05 AS weight FROM lineitem)
  SELECT status, count(*)::BIGINT AS n FROM (SELECT CASE WHEN p.p_partkey IS NULL THEN 'unknown node' WHEN s.s_suppkey IS NULL THEN 'unknown unit' WHEN weight <= 0 THEN 'bad weight'
  WHEN count(*) OVER (PARTITION BY node, unit) > 1 THEN 'repeated' ELSE 'ok' END AS status FROM e LEFT JOIN (SELECT * FROM part WHERE p_size > 5) p ON p.p_partkey = node LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) s ON s.s_suppkey = unit) GROUP BY status""")
def checked_edges(s, d):
    edges = X.read(s, d, "lineitem").select((F.col("l_partkey") % 300).alias("node"), F.col("l_suppkey").alias("unit"), (F.col("l_discount") - 0.05).alias("weight"))
    units = X.units(s, d).where("level > 0")
    return M.checked_edges(edges, _parts(s, d).where("p_size > 5").withColumnRenamed("k", "node"), units).groupBy("status").agg(F.count("*").alias("n"))


@query("mapped_profiles", X.sql(f""", {PAIRS}, t AS (SELECT k, other, 1.0::DOUBLE / count(*) OVER (PARTITION BY k) AS share FROM (SELECT *, min(km) OVER (PARTITION BY k) AS d FROM pairs) WHERE km <= d + 1e-6)
  SELECT other, month, round(sum(max_load * share), 5) AS v FROM t JOIN profiles ON unit = k GROUP BY ALL"""))
def mapped_profiles(s, d):
    values = X.profiles(s, d).groupBy(F.col("unit").alias("k"), "month").agg(F.sum("max_load").alias("v"))
    for step in P.nearest_spots(*_sides(s, d)):
        values = M.apply_mapping(values, step.select("k", "other", "share"), ["month"]).withColumnRenamed("other", "k")
    return values.select(F.col("k").alias("other"), "month", F.round("v", 5).alias("v"))


@query("mutual_nearest", X.sql(f""", {PAIRS}, n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY round(km, 9), other) AS a, row_number() OVER (PARTITION BY other ORDER BY round(km, 9), k) AS b FROM pairs WHERE km <= 100)
  SELECT k, other, round(km, 6) AS km FROM n WHERE a = 1 AND b = 1"""))
def mutual_nearest(s, d):
    return P.mutual_nearest(*_sides(s, d), 100.0).withColumn("km", F.round("km", 6))


@query("nearest_of_class", X.sql(f""", {PAIRS} SELECT k, other, round(km, 6) AS km, k % 4 = other % 4 AS same FROM pairs
  QUALIFY row_number() OVER (PARTITION BY k ORDER BY (k % 4 <> other % 4), round(km, 9), other) = 1"""))
def nearest_of_class(s, d):
    left, right = (x.withColumn("class", F.col("k") % 4) for x in _sides(s, d))
    return P.nearest_of_class(left, right).select("k", "other", F.round("km", 6).alias("km"), "same")


@query("catchments")
def catchments(s, d):
    units = X.places(X.read(s, d, "supplier").select(F.col("s_nationkey").cast("long").alias("region"), F.col("s_suppkey").alias("k")), "k")
    return M.catchments(units, X.places(_parts(s, d).select((F.col("k") % 25).alias("region"), "k"), "k"))


@query("affine_fit", "SELECT -3.0::DOUBLE AS a, 0.5::DOUBLE AS b, -0.25::DOUBLE AS c, 40.0::DOUBLE AS d, 0.125::DOUBLE AS e, 2.0::DOUBLE AS f")
def affine_fit(s, d):
    x, y = F.col("k") * 17 % 101, F.col("k") * 29 % 103
    points = _parts(s, d).select(x.cast("double").alias("x"), y.cast("double").alias("y"), (-3 + 0.5 * x - 0.25 * y).alias("lon"), (40 + 0.125 * x + 2 * y).alias("lat"))
    (a, b, c), (e, f, g) = M.affine_fit(points)
    return s.createDataFrame([tuple(round(v, 6) for v in (a, b, c, e, f, g))], "a double, b double, c double, d double, e double, f double")


SURFACE = """, sv AS (SELECT unit, hour AS cell, avg((min_load + max_load) / 2) AS value FROM profiles WHERE month <= 6 GROUP BY ALL),
  en AS (SELECT hour(t)::INT AS cell, sum(mw) AS energy, min(mw) AS low, max(mw) AS high FROM series WHERE region = 0 GROUP BY 1),
  sh AS (SELECT unit, cell, value / (sum(value * energy) OVER p / sum(energy) OVER p) AS shape FROM sv JOIN en USING (cell) WINDOW p AS (PARTITION BY unit)),
  lv AS (SELECT s_suppkey AS node, 1.0::DOUBLE / count(*) OVER () AS share, s_suppkey % 3 <> 0 AS mapped FROM supplier),
  own AS (SELECT node, cell, share * shape AS s FROM lv JOIN sh ON unit = node WHERE mapped), rest AS (SELECT cell, sum(s) AS m FROM own GROUP BY cell),
  ss AS (SELECT * FROM own UNION ALL SELECT node, c.cell, (1 - coalesce(m, 0)) * share / sum(share) OVER (PARTITION BY c.cell) FROM lv CROSS JOIN (SELECT DISTINCT cell FROM sh) c LEFT JOIN rest ON rest.cell = c.cell WHERE NOT mapped)"""


def _surface(s, d):
    return X.profiles(s, d).where("month <= 6").groupBy("unit", F.col("hour").alias("cell")).agg(F.avg((F.col("min_load") + F.col("max_load")) / 2).alias("value"))


def _cells(s, d):
    return X.series(s, d).where("region = 0").groupBy(F.hour("t").alias("cell")).agg(F.sum("mw").alias("energy"), F.min("mw").alias("low"), F.max("mw").alias("high"))


def _shapes(s, d):
    return A.energy_normalised(_surface(s, d).withColumn("block", F.lit(0)), _cells(s, d)).select("unit", "cell", "block", "shape")


def _slack(s, d):
    nodes = X.read(s, d, "supplier").select(F.col("s_suppkey").alias("node"), (F.col("s_suppkey") % 3 != 0).alias("mapped"), F.lit(0).alias("block"))
    levels = nodes.crossJoin(F.broadcast(nodes.agg((1.0 / F.count("*")).alias("share"))))  # a single row
    return A.slack_shares(_shapes(s, d).withColumnRenamed("unit", "node"), levels)


@query("energy_shapes", X.sql(f"{SURFACE} SELECT unit, cell, round(shape, 6) AS shape FROM sh"))
def energy_shapes(s, d):
    return _shapes(s, d).select("unit", "cell", F.round("shape", 6).alias("shape"))


@query("slack_shares", X.sql(f"{SURFACE} SELECT node, cell, round(s, 7) AS s FROM ss"))
def slack_shares(s, d):
    return _slack(s, d).withColumn("s", F.round("s", 7))


@query("annual_and_peak", X.sql(f"{SURFACE} SELECT node, round(sum(energy * s), 4) AS energy, round(max(CASE WHEN s >= 0 THEN high * s ELSE low * s END), 4) AS peak FROM ss JOIN en USING (cell) GROUP BY node"))
def annual_and_peak(s, d):
    return U.annual_and_peak(_slack(s, d), _cells(s, d)).select("node", F.round("energy", 4).alias("energy"), F.round("peak", 4).alias("peak"))


@query("expanded_totals", X.sql(f"{SURFACE} SELECT node, round(sum(mw * s), 4) AS energy, count(*)::BIGINT AS hours FROM series JOIN ss ON cell = hour(t) WHERE region = 0 GROUP BY node"))
def expanded_totals(s, d):
    series = X.series(s, d).where("region = 0").withColumn("cell", F.hour("t"))
    return U.expanded(series, _slack(s, d)).groupBy("node").agg(F.round(F.sum("mw"), 4).alias("energy"), F.count("*").alias("hours"))


@query("filled_surface", X.sql("""{}, g AS (SELECT * FROM sv WHERE cell % 3 <> 0) SELECT u.unit, c.cell, round(coalesce(value, mean), 9) AS value, value IS NULL AS gap
  FROM (SELECT unit, avg(value) AS mean FROM g GROUP BY unit) u CROSS JOIN (SELECT DISTINCT cell FROM sv) c LEFT JOIN g ON g.unit = u.unit AND g.cell = c.cell""".format(SURFACE)))
def filled_surface(s, d):
    surface = _surface(s, d)
    return U.filled(surface.where("cell % 3 <> 0"), surface).withColumn("value", F.round("value", 9))


@query("without_common", X.sql(f"""{SURFACE}, a AS (SELECT unit, cell, shape / avg(shape) OVER (PARTITION BY cell) AS x FROM sh) SELECT unit, cell, round(x / avg(x) OVER (PARTITION BY unit), 6) AS shape FROM a"""))
def without_common(s, d):
    return U.without_common(_shapes(s, d).select("unit", "cell", "shape")).withColumn("shape", F.round("shape", 6))


@query("mass_moved", X.sql(f""", {PAIRS}, a AS (SELECT k, other FROM pairs QUALIFY row_number() OVER (PARTITION BY k ORDER BY round(km, 9), other) = 1),
  b AS (SELECT k, other FROM pairs QUALIFY row_number() OVER (PARTITION BY k ORDER BY (k % 4 <> other % 4), round(km, 9), other) = 1)
  SELECT a.k, (a.other <> b.other)::INT::DOUBLE AS moved FROM a JOIN b USING (k)"""))
def mass_moved(s, d):
    left, right = (x.withColumn("class", F.col("k") % 4) for x in _sides(s, d))
    one = F.lit(1.0).alias("share")
    near = P.k_nearest(left, right, 1)
    return U.mass_moved(near.select("k", "other", one), P.nearest_of_class(left, right).select("k", "other", one))
