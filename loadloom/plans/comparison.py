"""Queries that compare and check series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relational as R
from . import fixtures as X
from .registry import query

TWO = "two AS (SELECT a.t, a.mw AS x, b.mw AS y, hour(a.t)::INT AS hour FROM series a JOIN series b ON a.t = b.t AND a.region = 0 AND b.region = 1)"


def _two(s, d):
    x = X.series(s, d)
    a = x.where("region = 0").select("t", F.col("mw").alias("x"))
    return a.join(x.where("region = 1").select("t", F.col("mw").alias("y")), "t").withColumn("hour", F.hour("t"))


@query("agreement", X.sql(f""", {TWO} SELECT count(*)::BIGINT AS n, round(sqrt(avg((x - y) * (x - y))), 6) AS rmse, round(avg(abs(x - y)), 6) AS mae, round(avg(x - y), 6) AS bias,
  round(sum(abs(x - y)) / sum(abs(y)), 6) AS wape, round(corr(x, y), 6) AS pearson, round(quantile_cont(abs(x - y), 0.5), 6) AS median_ae FROM two"""))
def agreement(s, d):
    e = F.col("x") - F.col("y")
    return _two(s, d).agg(
        F.count("*").alias("n"), F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"), F.round(F.avg(F.abs(e)), 6).alias("mae"), F.round(F.avg(e), 6).alias("bias"),
        F.round(F.sum(F.abs(e)) / F.sum(F.abs("y")), 6).alias("wape"), F.round(F.corr("x", "y"), 6).alias("pearson"), F.round(F.percentile(F.abs(e), 0.5), 6).alias("median_ae"),
    )


@query("spearman", X.sql(f""", {TWO}, r AS (SELECT hour, rank() OVER (PARTITION BY hour ORDER BY x) + (count(*) OVER (PARTITION BY hour, x) - 1) / 2 AS a,
  rank() OVER (PARTITION BY hour ORDER BY y) + (count(*) OVER (PARTITION BY hour, y) - 1) / 2 AS b FROM two) SELECT hour, round(corr(a, b), 6) AS rho FROM r GROUP BY hour"""))
def spearman(s, d):
    ranked = R.average_rank(R.average_rank(_two(s, d), ["hour"], "x", "a"), ["hour"], "y", "b")
    return ranked.groupBy("hour").agg(F.round(F.corr("a", "b"), 6).alias("rho"))


@query("divergence", X.sql(f", {TWO}, s AS (SELECT hour, sum(x) AS x, sum(y) AS y FROM two GROUP BY hour) SELECT round(sum(abs(x / (SELECT sum(x) FROM s) - y / (SELECT sum(y) FROM s))) / 2, 9) AS relocated FROM s"))
def divergence(s, d):
    h = _two(s, d).groupBy("hour").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    total = h.agg(F.sum("x").alias("_x"), F.sum("y").alias("_y"))
    return h.crossJoin(total).agg(F.round(F.sum(F.abs(F.col("x") / F.col("_x") - F.col("y") / F.col("_y"))) / 2, 9).alias("relocated"))


@query("missing_hours", X.sql(""", hours AS (SELECT DISTINCT t FROM series), g AS (SELECT region, hours.t FROM (SELECT DISTINCT region FROM series), hours)
  SELECT region, t FROM g WHERE NOT EXISTS (FROM series s WHERE s.region = g.region AND s.t = g.t)"""))
def missing_hours(s, d):
    x = X.series(s, d)
    grid = x.select("t").distinct().crossJoin(F.broadcast(x.select("region").distinct()))  # five regions
    return grid.join(x, ["region", "t"], "left_anti").select("region", "t")


@query("runs_above_mean", X.sql(""", f AS (SELECT region, t, mw > avg(mw) OVER (PARTITION BY region) AS up FROM series),
  c AS (SELECT *, CASE WHEN up IS DISTINCT FROM lag(up) OVER w THEN 1 ELSE 0 END AS new FROM f WINDOW w AS (PARTITION BY region ORDER BY t)),
  r AS (SELECT *, sum(new) OVER (PARTITION BY region ORDER BY t) AS run FROM c)
  SELECT region, run::BIGINT AS run, up, count(*)::BIGINT AS hours, min(t) AS begins FROM r GROUP BY ALL"""))
def runs_above_mean(s, d):
    from pyspark.sql import Window

    x = X.series(s, d).withColumn("up", F.col("mw") > F.avg("mw").over(Window.partitionBy("region")))
    return R.islands(x, ["region"], "t", F.col("up")).groupBy("region", "run", "up").agg(F.count("*").alias("hours"), F.min("t").alias("begins"))


@query("daily_peaks", X.sql("SELECT region, t::DATE::VARCHAR AS day, hour(t)::INT AS hour FROM series QUALIFY row_number() OVER (PARTITION BY region, t::DATE ORDER BY mw DESC, t) = 1"))
def daily_peaks(s, d):
    x = X.series(s, d).withColumn("day", F.to_date("t"))
    return R.first_by(x, ["region", "day"], F.desc("mw"), F.asc("t")).select("region", F.col("day").cast("string").alias("day"), F.hour("t").alias("hour"))


@query("welch_terms", X.sql(f""", {TWO} SELECT hour, round((avg(x) - avg(y)) / nullif(sqrt(var_samp(x) / count(*) + var_samp(y) / count(*)), 0), 6) AS welch_t,
  round(avg(x - y) / nullif(stddev_samp(x - y) / sqrt(count(*)), 0), 6) AS paired_t FROM two GROUP BY hour"""))
def welch_terms(s, d):
    n, e = F.count("*"), F.col("x") - F.col("y")
    return _two(s, d).groupBy("hour").agg(
        F.round((F.avg("x") - F.avg("y")) / F.nullif(F.sqrt(F.var_samp("x") / n + F.var_samp("y") / n), F.lit(0.0)), 6).alias("welch_t"),
        F.round(F.avg(e) / F.nullif(F.stddev_samp(e) / F.sqrt(n), F.lit(0.0)), 6).alias("paired_t"),
    )


@query("pivot_regions", X.sql("SELECT t, round(sum(mw) FILTER (region = 0), 5) AS r0, round(sum(mw) FILTER (region = 1), 5) AS r1, round(sum(mw) FILTER (region = 2), 5) AS r2 FROM series GROUP BY t"))
def pivot_regions(s, d):
    wide = X.series(s, d).groupBy("t").pivot("region", [0, 1, 2]).agg(F.sum("mw"))
    return wide.select("t", *[F.round(str(i), 5).alias(f"r{i}") for i in range(3)])


@query("interchange_balance", X.sql(f", {TWO} SELECT hour, round(sum(x - y), 5) AS net FROM two GROUP BY hour"))
def interchange_balance(s, d):
    return _two(s, d).groupBy("hour").agg(F.round(F.sum(F.col("x") - F.col("y")), 5).alias("net"))
