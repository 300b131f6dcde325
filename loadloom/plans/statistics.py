"""Queries of tests, templates, folds and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import spatial as P
from ..operators import statistics as T
from ..operators import weights as W
from . import fixtures as X
from .registry import query

HOURLY = "hs AS (SELECT region, t, mw, hour(t)::INT AS hour FROM series)"


def _hourly(s, d):
    return X.series(s, d).withColumn("hour", F.hour("t"))


def _rounded(df, digits=6, *names):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("mann_whitney", X.sql(f""", {HOURLY}, r AS (SELECT hour, (region = 0)::INT AS own, rank() OVER (PARTITION BY hour ORDER BY mw) + (count(*) OVER (PARTITION BY hour, mw) - 1) / 2 AS r,
  count(*) OVER (PARTITION BY hour, mw) AS c FROM hs WHERE region < 2),
  g AS (SELECT hour, sum(own)::DOUBLE AS a, sum(1 - own)::DOUBLE AS b, sum(own * r) AS s, sum(c * c - 1)::DOUBLE AS t FROM r GROUP BY hour)
  SELECT hour, round(s - a * (a + 1) / 2, 6) AS u, round((s - a * (a + 1) / 2 - a * b / 2) / nullif(sqrt(a * b / 12 * (a + b + 1 - t / ((a + b) * (a + b - 1)))), 0), 6) AS z FROM g"""))
def mann_whitney(s, d):
    x = _hourly(s, d).where("region < 2").withColumn("own", F.col("region") == 0)
    return _rounded(T.mann_whitney(x, ["hour"], "mw", "own"), 6, "u", "z")


@query("variance_parts", X.sql(f""", {HOURLY}, m AS (SELECT *, avg(mw) OVER (PARTITION BY region, hour) AS m FROM hs)
  SELECT region, round(var_pop(mw), 5) AS total, round(var_pop(m), 5) AS "between", round(avg((mw - m) * (mw - m)), 5) AS "within" FROM m GROUP BY region"""))
def variance_parts(s, d):
    return _rounded(T.decompose_variance(_hourly(s, d), ["region"], ["hour"], "mw"), 5, "total", "between", "within")


@query("variance_explained", X.sql(f""", {HOURLY}, p AS (SELECT mw, 'hour' AS partition, hour::VARCHAR AS l FROM hs UNION ALL SELECT mw, 'half', (hour // 12)::VARCHAR FROM hs UNION ALL SELECT mw, 'region', region::VARCHAR FROM hs),
  m AS (SELECT *, avg(mw) OVER (PARTITION BY partition, l) AS m FROM p) SELECT partition, round(var_pop(m) / var_pop(mw), 6) AS explained FROM m GROUP BY partition"""))
def variance_explained(s, d):
    return _rounded(T.explained(_hourly(s, d), {"hour": F.col("hour"), "half": F.floor(F.col("hour") / 12), "region": F.col("region")}, "mw"), 6, "explained")


SHAPES = ", loads AS (SELECT unit, month, hour, (min_load + max_load) / 2 AS avg_load FROM profiles), shapes AS (SELECT *, avg(avg_load) OVER (PARTITION BY unit) AS magnitude, avg_load / avg(avg_load) OVER (PARTITION BY unit) AS shape FROM loads)"


def _shapes(s, d):
    return T.magnitude_and_shape(W.average_load(X.profiles(s, d)), "avg_load")


@query("magnitude_shape", X.sql(f"{SHAPES} SELECT unit, month, hour, round(magnitude, 6) AS magnitude, round(shape, 6) AS shape FROM shapes"))
def magnitude_shape(s, d):
    return _rounded(_shapes(s, d).select("unit", "month", "hour", "magnitude", "shape"), 6, "magnitude", "shape")


@query("group_template", X.sql(f"""{SHAPES}, d AS (SELECT * FROM shapes JOIN units USING (unit) WHERE unit % 4 <> 0),
  g AS (SELECT county, month, hour, avg(shape) AS g FROM d GROUP BY ALL HAVING count(DISTINCT unit) >= 3), f AS (SELECT month, hour, avg(shape) AS f FROM d GROUP BY ALL)
  SELECT u.unit, f.month, f.hour, round(coalesce(g, f), 6) AS shape, CASE WHEN g IS NULL THEN 'fleet' ELSE 'group' END AS route
  FROM units u CROSS JOIN f LEFT JOIN g ON g.county = u.county AND g.month = f.month AND g.hour = f.hour WHERE u.unit % 4 = 0"""))
def group_template(s, d):
    units = X.units(s, d).select("unit", "county")
    donors = _shapes(s, d).where("unit % 4 <> 0").join(units, "unit")
    return _rounded(T.group_template(donors, units.where("unit % 4 = 0"), "county", ["month", "hour"]), 6, "shape")


KM = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"


@query("neighbour_template", X.sql(f"""{SHAPES}, n AS (SELECT a.k, b.k AS other, {KM} AS km FROM places a, places b WHERE a.k % 4 = 0 AND b.k % 4 <> 0),
  t AS (SELECT k, other FROM n QUALIFY row_number() OVER (PARTITION BY k ORDER BY round(km, 9), other) <= 3)
  SELECT k AS unit, month, hour, round(avg(shape), 6) AS shape, count(*)::BIGINT AS donors FROM t JOIN shapes ON other = unit GROUP BY ALL"""))
def neighbour_template(s, d):
    at = X.places(X.read(s, d, "supplier").select(F.col("s_suppkey").alias("k")), "k")
    near = P.k_nearest(at.where("k % 4 = 0"), at.where("k % 4 <> 0"), 3)
    return _rounded(T.neighbour_template(_shapes(s, d), near, ["month", "hour"]), 6, "shape")


FOLDS = "f AS (SELECT *, (('0x' || substr(md5(unit::VARCHAR), 1, 8))::BIGINT % 5)::INT AS fold FROM loads)"


@query("group_folds", X.sql(f"{SHAPES}, {FOLDS} SELECT DISTINCT unit, fold FROM f"))
def group_folds(s, d):
    return T.group_folds(W.average_load(X.profiles(s, d)), "unit", 5).select("unit", "fold").distinct()


@query("cross_validated_means", X.sql(f"""{SHAPES}, {FOLDS}, p AS (SELECT a.unit, a.fold, a.month, a.hour, a.avg_load AS y, (SELECT avg(avg_load) FROM f b WHERE b.fold <> a.fold AND b.month = a.month AND b.hour = a.hour) AS c,
  (SELECT avg(avg_load) FROM f b WHERE b.fold <> a.fold) AS g FROM f a), e AS (SELECT fold, y, coalesce(c, g) AS p, g FROM p)
  SELECT fold, count(*)::BIGINT AS n, round(sqrt(avg((p - y) * (p - y))), 5) AS rmse, round(avg(abs(p - y)), 5) AS mae, round(avg(p - y), 5) AS bias, round(sum(abs(p - y)) / sum(abs(y)), 5) AS wape,
  round(1 - avg((p - y) * (p - y)) / var_pop(y), 5) AS r2, round(1 - sqrt(avg((p - y) * (p - y))) / sqrt(avg((g - y) * (g - y))), 5) AS skill FROM e GROUP BY fold"""))
def cross_validated_means(s, d):
    x = T.group_folds(W.average_load(X.profiles(s, d)), "unit", 5)
    done = T.scores(T.out_of_fold_means(x, ["month", "hour"], "avg_load"), ["fold"], "avg_load", "predicted", "baseline")
    return _rounded(done, 5, "rmse", "mae", "bias", "wape", "r2", "skill")


@query("rolling_origins", X.sql(f""", {HOURLY}, a AS (SELECT *, t::DATE - (SELECT min(t)::DATE FROM hs) AS day FROM hs), o(origin) AS (VALUES (10), (15), (20)), h(half_life) AS (VALUES (3.0::DOUBLE), (10.0)),
  fit AS (SELECT region, hour, origin, half_life, sum(pow(0.5, (origin - day) / half_life) * mw) / sum(pow(0.5, (origin - day) / half_life)) AS p FROM a, o, h WHERE day < origin GROUP BY ALL)
  SELECT origin, half_life, count(*)::BIGINT AS n, round(sqrt(avg((p - mw) * (p - mw))) / avg(mw), 6) AS rel_rmse, round(avg(p - mw), 5) AS bias
  FROM a JOIN fit USING (region, hour) WHERE day >= origin AND day < origin + 5 GROUP BY ALL"""))
def rolling_origins(s, d):
    found = T.rolling_origins(_hourly(s, d), (10, 15, 20), (3.0, 10.0), 5)
    return found.withColumn("rel_rmse", F.round("rel_rmse", 6)).withColumn("bias", F.round("bias", 5))


@query("regressions", X.sql(f", {HOURLY} SELECT region, round(regr_slope(mw, hour), 6) AS slope, round(regr_intercept(mw, hour), 6) AS intercept, round(regr_r2(mw, hour), 6) AS r2 FROM hs GROUP BY region"))
def regressions(s, d):
    by = _hourly(s, d).groupBy("region")
    return by.agg(*[F.round(f("mw", "hour"), 6).alias(n) for n, f in (("slope", F.regr_slope), ("intercept", F.regr_intercept), ("r2", F.regr_r2))])
