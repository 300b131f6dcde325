"""Queries of envelopes and stochastic generation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import relational as R
from ..operators import stochastic as E
from . import fixtures as X
from .registry import query

ENV = f"env AS (SELECT unit, month, hour, (min_load + max_load) / 2 AS mu, (max_load - min_load) / (2 * {S.Z90}) AS sigma, min_load = max_load AS zero FROM profiles)"


@query("envelope_fit", X.sql(f", {ENV} SELECT unit, month, hour, round(mu, 6) AS mu, round(sigma, 6) AS sigma, false AS missing, false AS inverted, zero AS zero_width FROM env"))
def envelope_fit(s, d):
    return E.fit_envelope(X.sql_profiles(s, d)).withColumn("mu", F.round("mu", 6)).withColumn("sigma", F.round("sigma", 6))


@query("envelope_coarsen", X.sql(f", {ENV} SELECT unit, month, round(avg(mu), 6) AS mu, round(sqrt(avg(sigma * sigma) + var_pop(mu)), 6) AS sigma FROM env GROUP BY ALL"))
def envelope_coarsen(s, d):
    return E.coarsen(E.fit_envelope(X.profiles(s, d)), ["month"]).select("unit", "month", F.round("mu", 6).alias("mu"), F.round("sigma", 6).alias("sigma"))


PERCENTILES = (0.1, 0.25, 0.5, 0.75, 0.9)


@query("envelope_percentiles", f"""WITH q AS (SELECT l_suppkey AS unit, quantile_cont(l_quantity, {list(PERCENTILES)}) AS v FROM lineitem GROUP BY 1), x AS (SELECT unit, unnest(v) AS load, unnest({list(PERCENTILES)}::DOUBLE[]) AS p FROM q),
  z AS (SELECT unit, load, {X.quantile_sql("p")} AS z FROM x) SELECT unit, round(regr_intercept(load, z), 6) AS mu, round(regr_slope(load, z), 6) AS sigma FROM z GROUP BY unit""")
def envelope_percentiles(s, d):
    x = X.read(s, d, "lineitem", "l_suppkey", "l_quantity").groupBy(F.col("l_suppkey").alias("unit"))
    ps = F.array(*map(F.lit, PERCENTILES))
    long = x.agg(F.percentile("l_quantity", ps).alias("v"))
    fitted = E.fit_percentiles(long.select("unit", F.posexplode("v").alias("i", "load")).withColumn("percentile", F.element_at(ps, F.col("i") + 1)))
    return fitted.select("unit", F.round("mu", 6).alias("mu"), F.round("sigma", 6).alias("sigma"))


HOURLY = "hs AS (SELECT region, t, mw, hour(t)::INT AS hour FROM series)"


def _hourly(s, d):
    return X.series(s, d).withColumn("hour", F.hour("t"))


@query("standardised_series", X.sql(f", {HOURLY} SELECT region, t, round((mw - avg(mw) OVER w) / nullif(stddev_samp(mw) OVER w, 0), 6) AS z FROM hs WINDOW w AS (PARTITION BY region, hour)"))
def standardised_series(s, d):
    return E.standardised(_hourly(s, d)).select("region", "t", F.round("z", 6).alias("z"))


CELLS = f""", {ENV}, {HOURLY}, y AS (SELECT hour, avg(mw) AS ybar, stddev_samp(mw) AS sd FROM hs GROUP BY hour), u AS (SELECT hour, sum(mu) AS mu, sum(sigma) AS sg FROM env GROUP BY hour),
  cells AS (SELECT hour, mu / ybar AS f, least(1.0, pow(mu / ybar * sd / nullif(sg, 0), 2)) AS rho FROM y JOIN u USING (hour))"""


@query("system_cells", X.sql(f"{CELLS} SELECT hour, round(f, 6) AS f, round(rho, 6) AS rho FROM cells"))
def system_cells(s, d):
    return E.system_cells(_hourly(s, d), E.fit_envelope(X.profiles(s, d))).select("hour", F.round("f", 6).alias("f"), F.round("rho", 6).alias("rho"))


DRAWN = f"""{CELLS}, eh AS (SELECT unit, hour, avg(mu) AS mu, sqrt(avg(sigma * sigma) + var_pop(mu)) AS sigma FROM env GROUP BY ALL), zs AS (SELECT region, t, hour, (mw - avg(mw) OVER w) / nullif(stddev_samp(mw) OVER w, 0) AS z FROM hs WINDOW w AS (PARTITION BY region, hour)),
  us AS (SELECT region, unit, hour, z, rho, mu, sigma, {X.uniform_sql("'7|0'", "unit", "strftime(t, '{when}')")} AS u FROM zs JOIN cells USING (hour) JOIN eh USING (hour)), ws AS (SELECT *, sqrt(rho) * z + sqrt(1 - rho) * ({X.quantile_sql("u")}) AS w FROM us)"""


@query("generate_draw", X.sql(DRAWN.replace("{when}", "%Y-%m-%d") + " SELECT region, unit, hour, round(avg(mu + sigma * w), 6) AS mean_mw, count(*)::BIGINT AS n_hours FROM ws GROUP BY ALL"))
def generate_draw(s, d):
    """Cell means of one draw for each region; the hourly rows are never kept."""
    env = E.coarsen(E.fit_envelope(X.profiles(s, d)), ["hour"])
    hourly = _hourly(s, d)
    drawn = E.generate(env, E.standardised(hourly), E.system_cells(hourly, E.fit_envelope(X.profiles(s, d))), 7, 0)
    return drawn.groupBy("region", "unit", "hour").agg(F.round(F.avg("load"), 6).alias("mean_mw"), F.count("*").alias("n_hours"))


@query("decay_moments", X.sql(f""", {HOURLY}, w AS (SELECT *, pow(0.5, date_diff('day', t::DATE, (SELECT max(t)::DATE FROM hs)) / 10.0::DOUBLE) AS w FROM hs),
  m AS (SELECT region, hour, sum(w) AS w, sum(w * mw) AS wy, sum(w * mw * mw) AS wyy, sum(w * w) AS ww FROM w GROUP BY ALL)
  SELECT region, hour, round(wy / w, 5) AS mean, round(w * w / ww, 5) AS n_eff FROM m"""))
def decay_moments(s, d):
    h = _hourly(s, d)
    last = h.agg(F.max(F.to_date("t")).alias("_last"))
    aged = h.crossJoin(last).withColumn("w", F.pow(F.lit(0.5), F.datediff("_last", F.to_date("t")) / 10.0))
    return R.weighted_moments(aged, ["region", "hour"], "mw", "w").select("region", "hour", F.round("mean", 5).alias("mean"), F.round("n_eff", 5).alias("n_eff"))


@query("complete_days", X.sql(f", {HOURLY} SELECT region, t::DATE::VARCHAR AS day, count(*)::BIGINT AS hours FROM hs GROUP BY ALL HAVING count(*) = 24"))
def complete_days(s, d):
    return _hourly(s, d).groupBy("region", F.to_date("t").cast("string").alias("day")).agg(F.count("*").alias("hours")).where("hours = 24")


@query("hash_draws", "SELECT s_suppkey AS unit, round((('0x' || substr(md5('7|0|' || s_suppkey), 1, 13))::BIGINT + 0.5) / 4503599627370496.0::DOUBLE, 9) AS u FROM supplier")
def hash_draws(s, d):
    return X.read(s, d, "supplier").select(F.col("s_suppkey").alias("unit"), F.round(S.hash_uniform(F.lit("7"), F.lit("0"), F.col("s_suppkey").cast("string")), 9).alias("u"))
