"""Queries of tests, summaries, comparisons of results and donors by features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import normal_cdf
from ..operators import statistics as T
from ..operators import testing as Q
from ..operators import weights as W
from . import fixtures as X
from .registry import query

HS = "hs AS (SELECT region, t, mw, hour(t)::INT AS hour FROM series)"


def _hourly(s, d):
    return X.series(s, d).withColumn("hour", F.hour("t"))


def _rounded(df, digits, *names):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("one_sample_t", X.sql(f", {HS} SELECT region, count(*)::BIGINT AS n, round(avg(mw), 6) AS mean, round((avg(mw) - 300) / (stddev_samp(mw) / sqrt(count(*))), 6) AS t, (count(*) - 1)::DOUBLE AS df FROM hs GROUP BY region"))
def one_sample_t(s, d):
    return _rounded(Q.one_sample_t(X.series(s, d), ["region"], "mw", 300.0).drop("p"), 6, "mean", "t")


PARTS = ", {hs}, m AS (SELECT hour, count(*) FILTER (region = 0) AS n1, count(*) FILTER (region <> 0) AS n2, avg(mw) FILTER (region = 0) AS m1, avg(mw) FILTER (region <> 0) AS m2, var_samp(mw) FILTER (region = 0) AS v1, var_samp(mw) FILTER (region <> 0) AS v2 FROM hs GROUP BY hour)".replace("{hs}", HS)


@query("student_t", X.sql(f"{PARTS} SELECT hour, round(m1 - m2, 6) AS difference, round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)), 6) AS t, (n1 + n2 - 2)::DOUBLE AS df FROM m"))
def student_t(s, d):
    return _rounded(Q.two_sample_t(_hourly(s, d).withColumn("own", F.col("region") == 0), ["hour"], "mw", "own").drop("p"), 6, "difference", "t")


@query("welch_t", X.sql(f"{PARTS} SELECT hour, round(m1 - m2, 6) AS difference, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) AS t, round(pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)), 5) AS df FROM m"))
def welch_t(s, d):
    found = Q.two_sample_t(_hourly(s, d).withColumn("own", F.col("region") == 0), ["hour"], "mw", "own", False).drop("p")
    return _rounded(_rounded(found, 6, "difference", "t"), 5, "df")


@query("test_probabilities")
def test_probabilities(s, d):
    """Two-sided p-values; Student's distribution is not in SQL, and is tested against known values."""
    return Q.two_sample_t(_hourly(s, d).withColumn("own", F.col("region") == 0), ["hour"], "mw", "own", False)


@query("ols_errors", """WITH x AS (SELECT p_size::DOUBLE AS a, p_retailprice AS y FROM part), m AS (SELECT count(*) AS n, regr_slope(y, a) AS b, regr_intercept(y, a) AS i, regr_sxx(y, a) AS sxx, regr_syy(y, a) AS syy, regr_sxy(y, a) AS sxy, avg(a) AS ma FROM x), e AS (SELECT *, (syy - b * sxy) / (n - 2) AS v FROM m)
  SELECT 'a' AS term, round(b, 5) AS coefficient, round(sqrt(v / sxx), 5) AS error, round(b / sqrt(v / sxx), 4) AS t FROM e UNION ALL SELECT 'intercept', round(i, 3), round(sqrt(v * (1.0 / n + ma * ma / sxx)), 4), round(i / sqrt(v * (1.0 / n + ma * ma / sxx)), 2) FROM e""")
def ols_errors(s, d):
    x = X.read(s, d, "part").select(F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("y"))
    rows = [(term, round(b, 3 if term == "intercept" else 5), round(e, 4 if term == "intercept" else 5), round(t, 2 if term == "intercept" else 4)) for term, b, e, t, _ in Q.ols_summary(x, ["a"], "y")]
    return s.createDataFrame(rows, "term string, coefficient double, error double, t double")


@query("compared_results", X.sql(""", a AS (SELECT t, region AS zone, mw - 400 AS v FROM series), b AS (SELECT t, region AS zone, (mw - 400) * (1 + region / 10.0) AS v FROM series), j AS (SELECT t, a.v AS x, b.v AS y FROM a JOIN b USING (t, zone)), h AS (SELECT t, sum(x) AS x, sum(y) AS y FROM j GROUP BY t)
  SELECT round(50 * sum(abs(x - y)) / sum(abs(x)), 6) AS movement_pct, round(100 * sqrt(avg((x - y) * (x - y))) / avg(abs(x)), 6) AS nrmse_pct, round(sum(x), 3) AS total_base, round(sum(y), 3) AS total_run,
  (SELECT count(*) FROM h WHERE x > 1e-6)::BIGINT AS hours_base, (SELECT count(*) FROM h WHERE y > 1e-6)::BIGINT AS hours_run FROM j"""))
def compared_results(s, d):
    base = X.series(s, d).select("t", F.col("region").alias("zone"), (F.col("mw") - 400).alias("v"))
    run = base.withColumn("v", F.col("v") * (1 + F.col("zone") / 10))
    return _rounded(_rounded(Q.compared_results(base, run), 6, "movement_pct", "nrmse_pct"), 3, "total_base", "total_run")


@query("compared_costs", "SELECT p_brand || p_type AS component, round(sum(p_size), 4)::DOUBLE AS base, round(sum(p_size) * 1.5, 4)::DOUBLE AS run, 50.0::DOUBLE AS delta_pct FROM part WHERE p_type <> 'PROMO' GROUP BY ALL")
def compared_costs(s, d):
    cost = F.sum("p_size").cast("double")
    x = X.read(s, d, "part").groupBy(F.concat("p_brand", "p_type").alias("component"), "p_type").agg(cost.alias("c"))
    text = lambda c: F.when(F.col("p_type") == "PROMO", "-").otherwise(c.cast("string")).alias("cost")
    return Q.compared_costs(x.select("component", text(F.col("c"))), x.select("component", text(F.col("c") * 1.5)))


@query("grouped_files", """WITH f AS (SELECT 'sc' || p_partkey % 40 AS scenario, 's' || p_size % 4 AS season, md5(string_agg(p_brand, '' ORDER BY p_partkey)) AS digest FROM part WHERE p_partkey < 400 GROUP BY ALL)
  SELECT scenario, season, digest, min(scenario) OVER (PARTITION BY season, digest) AS same_as FROM f""")
def grouped_files(s, d):
    p = X.read(s, d, "part").where("p_partkey < 400")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_brand"))), lambda x: x["p_brand"]), "")
    files = p.groupBy((F.col("p_partkey") % 40).alias("a"), (F.col("p_size") % 4).alias("b")).agg(text.alias("content"))
    return Q.grouped_files(files.select(F.concat(F.lit("tree/sc"), "a", F.lit("/s"), "b", F.lit("/Demand.csv")).alias("path"), "content"))


@query("leaking_groups", "SELECT p_brand AS g, count(DISTINCT p_partkey % 3)::BIGINT AS folds FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey % 3) > 1")
def leaking_groups(s, d):
    x = X.read(s, d, "part").select(F.col("p_brand").alias("g"), (F.col("p_partkey") % 3).alias("fold"))
    return Q.leaks(T.group_folds(x.drop("fold"), "g", 3), "g", "fold").unionByName(Q.leaks(x, "g", "fold"))


FEATURES = """ft AS (SELECT s_suppkey AS unit, CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE s_acctbal END AS a, s_nationkey::DOUBLE AS b FROM supplier), dn AS (SELECT * FROM ft WHERE unit % 4 <> 0), md AS (SELECT quantile_cont(a, 0.5) AS qa, quantile_cont(b, 0.5) AS qb FROM dn),
  st AS (SELECT avg(coalesce(a, qa)) AS ma, stddev_pop(coalesce(a, qa)) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM dn, md), z AS (SELECT unit, (coalesce(a, qa) - ma) / sa AS x, (b - mb) / sb AS y FROM ft, md, st),
  nb AS (SELECT u.unit, n.unit AS donor, sqrt(pow(u.x - n.x, 2) + pow(u.y - n.y, 2)) AS distance FROM z u, z n WHERE u.unit % 4 = 0 AND n.unit % 4 <> 0), k AS (SELECT unit, donor, distance, row_number() OVER (PARTITION BY unit ORDER BY round(distance, 9), donor)::INT AS rank FROM nb QUALIFY rank <= 5)"""


def _neighbours(s, d):
    x = X.read(s, d, "supplier").select(F.col("s_suppkey").alias("unit"), F.when(F.col("s_suppkey") % 9 != 0, F.col("s_acctbal")).alias("a"), F.col("s_nationkey").cast("double").alias("b"))
    return Q.feature_neighbours(x.where("unit % 4 = 0"), x.where("unit % 4 <> 0"), Q.imputable(["a", "b"], ["peak"]), 5)


@query("feature_neighbours", f"WITH {FEATURES} SELECT unit, donor, round(distance, 6) AS distance, rank FROM k")
def feature_neighbours(s, d):
    return _neighbours(s, d).withColumn("distance", F.round("distance", 6))


SHAPES = "loads AS (SELECT unit, month, hour, (min_load + max_load) / 2 AS l FROM profiles), sh AS (SELECT *, avg(l) OVER (PARTITION BY unit) AS magnitude, l / avg(l) OVER (PARTITION BY unit) AS shape FROM loads)"


def _shapes(s, d):
    return T.magnitude_and_shape(W.average_load(X.profiles(s, d)), "avg_load")


@query("neighbour_magnitudes", X.sql(f", {SHAPES}, {FEATURES}, mg AS (SELECT DISTINCT unit, magnitude FROM sh) SELECT k.unit, round(quantile_cont(magnitude, 0.5), 6) AS magnitude FROM k JOIN mg ON mg.unit = donor GROUP BY k.unit"))
def neighbour_magnitudes(s, d):
    return _rounded(Q.neighbour_magnitude(_neighbours(s, d), _shapes(s, d).groupBy("unit").agg(F.max("magnitude").alias("magnitude"))), 6, "magnitude")


@query("shape_scores", X.sql(f""", {SHAPES}, {FEATURES}, tp AS (SELECT k.unit, month, hour, avg(shape) AS p FROM k JOIN sh ON sh.unit = donor GROUP BY ALL)
  SELECT sh.unit, round(corr(shape, p), 6) AS r, round(sqrt(avg((p - shape) * (p - shape))), 6) AS rmse, count(*)::BIGINT AS n FROM sh JOIN tp USING (unit, month, hour) GROUP BY sh.unit"""))
def shape_scores(s, d):
    shapes = _shapes(s, d).select("unit", "month", "hour", "shape")
    told = T.neighbour_template(shapes, _neighbours(s, d).select(F.col("unit").alias("k"), F.col("donor").alias("other")), ["month", "hour"])
    return _rounded(Q.shape_scores(shapes, told.select("unit", "month", "hour", "shape"), ["month", "hour"]), 6, "r", "rmse")


@query("segment_scores", X.sql(f""", {SHAPES}, p AS (SELECT unit, month, hour, l, avg(l) OVER (PARTITION BY hour) AS p FROM sh)
  SELECT month, round(sqrt(avg((p - l) * (p - l))), 6) AS rmse, round(avg(p - l), 6) AS bias, round(arg_max(p - l, struct_pack(a := l, b := p)), 6) AS peak_error FROM p GROUP BY month"""))
def segment_scores(s, d):
    x = W.average_load(X.profiles(s, d))
    told = x.join(x.groupBy("hour").agg(F.avg("avg_load").alias("p")), "hour")
    return _rounded(Q.segment_scores(told, ["month"], "avg_load", "p"), 6, "rmse", "bias", "peak_error")


@query("drawn_options")
def drawn_options(s, d):
    """Settings of a randomised search; md5 decides, and the test compares them with a plain sort."""
    drawn = Q.drawn_options({"penalty": [0.01, 0.1, 1.0, 10.0], "mix": [0.0, 0.5, 1.0]}, 5, 7)
    return s.createDataFrame([(i, o["penalty"], o["mix"]) for i, o in enumerate(drawn)], "i int, penalty double, mix double")


@query("resampled_means", X.sql(""", u AS (SELECT region, draw, (('0x' || substr(md5('7|' || draw || '|' || strftime(t, '%Y-%m-%d')), 1, 13))::BIGINT + 0.5) / 4503599627370496.0::DOUBLE AS u, mw FROM series, range(1, 21) g(draw)),
  m AS (SELECT region, draw, sum(-ln(u) * mw) / sum(-ln(u)) AS m FROM u GROUP BY ALL) SELECT region, round(avg(m), 5) AS mean, round(stddev_samp(m), 5) AS se FROM m GROUP BY region"""))
def resampled_means(s, d):
    return _rounded(Q.resampled_mean(X.series(s, d).withColumn("day", F.date_format("t", "yyyy-MM-dd")), ["region"], "mw", 20, 7, "day"), 5, "mean", "se")


ERF = "CASE WHEN x > 0 THEN 1 - q ELSE q END"


@query("normal_tail", """WITH z AS (SELECT s_suppkey AS k, s_acctbal / 3000 AS x FROM supplier), a AS (SELECT k, x, abs(x) AS a FROM z),
  q AS (SELECT k, x, exp(-a * a / 2) * ((((((3.52624965998911e-02::DOUBLE * a + 0.700383064443688) * a + 6.37396220353165) * a + 33.912866078383) * a + 112.079291497871) * a + 221.213596169931) * a + 220.206867912376)
    / (((((((8.83883476483184e-02::DOUBLE * a + 1.75566716318264) * a + 16.064177579207) * a + 86.7807322029461) * a + 296.564248779674) * a + 637.333633378831) * a + 793.826512519948) * a + 440.413735824752) AS q FROM a)
  SELECT k, round(CASE WHEN x > 0 THEN 1 - q ELSE q END, 10) AS p FROM q""")
def normal_tail(s, d):
    return X.read(s, d, "supplier").select(F.col("s_suppkey").alias("k"), F.round(normal_cdf(F.col("s_acctbal") / 3000), 10).alias("p"))
