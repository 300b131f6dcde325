"""Queries of coordinates, names and voltages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import spatial as P
from . import fixtures as X
from .registry import query

KM = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"
PAIRS = f"pairs AS (SELECT a.k, b.k AS other, {KM} AS km FROM places a, spots b)"


def _sides(s, d):
    left = X.places(X.read(s, d, "supplier").select(F.col("s_suppkey").alias("k")), "k")
    return left, X.places(X.read(s, d, "part").select(F.col("p_partkey").alias("k")), "k")


@query("within_distance", X.sql(f", {PAIRS} SELECT k, other, round(km, 6) AS km FROM pairs WHERE km <= 25"))
def within_distance(s, d):
    return P.within_km(*_sides(s, d), 25.0).withColumn("km", F.round("km", 6))


@query("nearest_ties", X.sql(f""", {PAIRS}, m AS (SELECT *, min(km) OVER (PARTITION BY k) AS d FROM pairs), t AS (SELECT k, other, km, 1.0::DOUBLE / count(*) OVER (PARTITION BY k) AS share FROM m WHERE km <= d + 1e-6)
  SELECT p.k, other, round(km, 6) AS km, round(share, 9) AS share FROM places p LEFT JOIN t ON t.k = p.k"""))
def nearest_ties(s, d):
    return P.nearest_with_ties(*_sides(s, d)).withColumn("km", F.round("km", 6)).withColumn("share", F.round("share", 9))


@query("k_nearest", X.sql(f", {PAIRS} SELECT k, other, round(km, 6) AS km, row_number() OVER (PARTITION BY k ORDER BY round(km, 9), other)::INT AS rank FROM pairs QUALIFY rank <= 3"))
def k_nearest(s, d):
    return P.k_nearest(*_sides(s, d), 3).withColumn("km", F.round("km", 6))


@query("voltage_classes", "SELECT p_partkey AS k, CASE WHEN p_size * 10 < 87.1 THEN 66 WHEN p_size * 10 < 162.6 THEN 115 WHEN p_size * 10 < 339.1 THEN 230 ELSE 500 END AS kv FROM part")
def voltage_classes(s, d):
    return X.read(s, d, "part").select(F.col("p_partkey").alias("k"), S.voltage_class(F.col("p_size") * 10).alias("kv"))


@query("normal_names", """SELECT p_partkey AS k, regexp_replace(regexp_replace(regexp_replace(lower(trim(p_name)), '\\s*\\(?p\\.?\\s*t\\.?\\)?\\s*$', ''), '\\bsub(station)?\\b', '', 'g'), '[^a-z0-9]', '', 'g') AS name FROM part""")
def normal_names(s, d):
    return X.read(s, d, "part").select(F.col("p_partkey").alias("k"), S.normal_name(F.col("p_name")).alias("name"))


@query("name_ambiguity", "SELECT lower(p_name) AS name, count(DISTINCT p_brand)::BIGINT AS n, count(DISTINCT p_brand) > 1 AS ambiguous FROM part GROUP BY 1")
def name_ambiguity(s, d):
    return X.read(s, d, "part").groupBy(F.lower("p_name").alias("name")).agg(F.countDistinct("p_brand").alias("n")).withColumn("ambiguous", F.col("n") > 1)


@query("json_fields", "SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k FROM events")
def json_fields(s, d):
    return X.read(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("point_in_polygon", "SELECT k, lon BETWEEN -123 AND -119 AND lat BETWEEN 33 AND 39 AS inside FROM (SELECT s_suppkey AS k, 32.0037 + (s_suppkey * 37 % 1000) / 100.0::DOUBLE AS lat, -124.0041 + (s_suppkey * 91 % 1000) / 100.0::DOUBLE AS lon FROM supplier)")
def point_in_polygon(s, d):
    left, _ = _sides(s, d)
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((-123, 33), (-119, 33), (-119, 39), (-123, 39))])
    return left.select("k", P.inside(F.col("lon") - 0.0041, F.col("lat") + 0.0037, ring).alias("inside"))
