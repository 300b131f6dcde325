"""Queries of sigma, checks of draws, placement, periods and reports of reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import periods
from ..functions import scalar as S
from ..operators import envelopes as V
from ..operators import placement as L
from ..operators import reports as K
from ..operators import scenarios as C
from ..operators import spatial as P
from ..operators import stochastic as E
from . import fixtures as X
from . import stochastic
from .registry import query

KM = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"
MU = "m AS (SELECT unit, hour AS cell, avg((min_load + max_load) / 2) AS mu FROM profiles GROUP BY ALL), sy AS (SELECT hour(t)::INT AS cell, avg(mw) AS f, stddev_samp(mw) AS sd FROM series GROUP BY 1)"


def rounded(df, **digits):
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


def _mu(s, d):
    return E.coarsen(E.fit_envelope(X.profiles(s, d)), ["hour"]).select("unit", F.col("hour").alias("cell"), "mu")


def _system(s, d):
    return X.series(s, d).groupBy(F.hour("t").alias("cell")).agg(F.avg("mw").alias("f"), F.stddev_samp("mw").alias("sd"))


@query("sigma_across_units", X.sql(f", {MU} SELECT unit, cell, round(stddev_samp(mu) OVER (PARTITION BY cell), 6) AS sigma FROM m"))
def sigma_across_units(s, d):
    return rounded(V.with_sigma(_mu(s, d), "input-crosssec").select("unit", "cell", "sigma"), sigma=6)


@query("sigma_pinned", X.sql(f", {MU} SELECT unit, cell, round(f * sd / count(*) OVER (PARTITION BY cell) / sqrt(0.231), 4) AS sigma FROM m LEFT JOIN sy USING (cell)"))
def sigma_pinned(s, d):
    return rounded(V.with_sigma(_mu(s, d), "pinned-rho", system=_system(s, d)).select("unit", "cell", "sigma"), sigma=4)


@query("sigma_of_size", X.sql(f", {MU} SELECT unit, cell, round(abs(0.32 * mu), 6) AS cv, 2.5::DOUBLE AS flat FROM m"))
def sigma_of_size(s, d):
    flat = V.with_sigma(_mu(s, d), "scalar", 2.5).withColumnRenamed("sigma", "flat")
    return rounded(V.with_sigma(flat, "proportional-cv", 0.32).select("unit", "cell", F.col("sigma").alias("cv"), "flat"), cv=6)


@query("sigma_floor", X.sql(f", {MU} SELECT cell, count(*)::BIGINT AS n, round(any_value(f * sd) / count(*), 4) AS floor FROM m JOIN sy USING (cell) GROUP BY cell"))
def sigma_floor(s, d):
    return rounded(V.sigma_floor(_mu(s, d), _system(s, d)), floor=4)


@query("below_zero", X.sql(f", {MU}, sg AS (SELECT unit, cell, mu, stddev_samp(mu) OVER (PARTITION BY cell) AS sigma FROM m) SELECT unit, cell, round(CASE WHEN sigma > 0 AND mu / sigma < 7 THEN {X.cdf_sql('(-mu / sigma)')} WHEN sigma > 0 THEN 0 WHEN sigma = 0 THEN (mu < 0)::INT END::DOUBLE, 8) AS p_negative FROM sg"))
def below_zero(s, d):
    """P(load < 0) of each unit and hour."""
    return rounded(V.below_zero(V.with_sigma(_mu(s, d), "input-crosssec")).select("unit", "cell", "p_negative"), p_negative=8)


SIBLINGS = f""", mb AS (SELECT unit AS base, hour AS cell, avg((min_load + max_load) / 2) AS mu, 0.3 * abs(avg((min_load + max_load) / 2)) AS sigma FROM profiles GROUP BY ALL), nd AS (SELECT p_partkey AS node, p_partkey % 10 + 1 AS base, p_size / 50.0::DOUBLE AS k FROM part),
  zs AS (SELECT region, t, hour(t)::INT AS cell, (mw - avg(mw) OVER w) / nullif(stddev_samp(mw) OVER w, 0) AS z FROM series WINDOW w AS (PARTITION BY region, hour(t))), dy AS (SELECT region, cell, strftime(t, '%Y-%m-%d') AS day, count(*) AS n, sum(z) AS z FROM zs GROUP BY ALL),
  dn AS (SELECT DISTINCT node, day FROM nd, dy), ep AS (SELECT node, day, {X.uniform_sql("'7|sibling'", "node", "day")} AS u FROM dn), eq AS (SELECT node, day, {X.quantile_sql("u")} AS e FROM ep),
  no AS (SELECT region, node, cell, sum(n * e) / sum(n) AS e, sum(z) / sum(n) AS z FROM eq JOIN dy USING (day) GROUP BY ALL)"""


@query("sibling_draws", X.sql(f"{SIBLINGS} SELECT region, node, nd.base, mb.cell, round(coalesce(k * mu + sqrt(abs(k)) * sigma * (sqrt(0.25) * z + sqrt(0.75) * e), k * mu), 6) AS mean FROM nd JOIN mb USING (base) CROSS JOIN (SELECT DISTINCT region FROM zs) r LEFT JOIN no USING (region, node, cell)"))
def sibling_draws(s, d):
    base = V.with_sigma(_mu(s, d), "proportional-cv", 0.3).withColumnRenamed("unit", "base")
    nodes = X.read(s, d, "part").select(F.col("p_partkey").alias("node"), (F.col("p_partkey") % 10 + 1).alias("base"), (F.col("p_size") / 50).alias("k"))
    z = E.standardised(X.series(s, d).withColumn("hour", F.hour("t"))).select("region", "t", F.col("hour").alias("cell"), "z")
    return V.sibling_draws(base, nodes, z, z.select("cell").distinct().withColumn("rho", F.lit(0.25)), 7, "quadrature", ["region"]).withColumn("mean", F.round("mean", 6))


WANTED = "w AS (SELECT t, hour(t)::INT AS cell, avg(mw) AS fy FROM series GROUP BY t), si AS (SELECT region AS draw, t, hour(t)::INT AS cell, mw AS total FROM series)"


def _totals(s, d):
    x = X.series(s, d).select(F.col("region").alias("draw"), "t", F.hour("t").alias("cell"), F.col("mw").alias("total"))
    return x, x.groupBy("t", "cell").agg(F.avg("total").alias("fy"))


@query("total_checks", X.sql(f""", {WANTED}, a AS (SELECT cell, quantile_cont(fy, 0.1) AS a1, quantile_cont(fy, 0.9) AS a9 FROM w GROUP BY 1), b AS (SELECT cell, quantile_cont(total, 0.1) AS b1, quantile_cont(total, 0.9) AS b9 FROM si GROUP BY 1)
  SELECT cell, round(100 * (b1 - a1) / a1, 5) AS error_q10, round(100 * (b9 - a9) / a9, 5) AS error_q90 FROM a JOIN b USING (cell)"""))
def total_checks(s, d):
    return rounded(V.total_checks(*_totals(s, d)).select("cell", "error_q10", "error_q90"), error_q10=5, error_q90=5)


@query("tracking", X.sql(f""", {WANTED}, h AS (SELECT t, avg(total) AS m FROM si WHERE draw < 3 GROUP BY t)
  SELECT round(100 * sqrt(avg(pow((m - fy) / fy, 2))), 5) AS rel_rmse, round(100 * avg((m - fy) / fy), 5) AS bias, count(*)::BIGINT AS n FROM h JOIN w USING (t)"""))
def tracking(s, d):
    simulated, wanted = _totals(s, d)
    return rounded(V.tracking(simulated.where("draw < 3"), wanted), rel_rmse=5, bias=5)


def _recovery(s, d):
    env = X.profiles(s, d).select("unit", F.col("month").alias("cell"), "min_load", "max_load").groupBy("unit", "cell").agg(F.avg("min_load").alias("min_load"), F.avg("max_load").alias("max_load"))
    drawn = X.read(s, d, "lineitem", "l_suppkey", "l_shipdate", "l_quantity").select(F.col("l_suppkey").alias("unit"), F.month("l_shipdate").alias("cell"), F.col("l_quantity").cast("double").alias("load"))
    return V.recovery(env, drawn)


RECOVERED = """, e AS (SELECT unit, month AS cell, avg(min_load) AS lo, avg(max_load) AS hi FROM profiles GROUP BY ALL), g AS (SELECT l_suppkey AS unit, month(l_shipdate)::INT AS cell,
  quantile_cont(l_quantity, 0.1) AS q1, quantile_cont(l_quantity, 0.9) AS q9 FROM lineitem GROUP BY ALL), x AS (SELECT unit, cell, abs(q1 - lo) / (hi - lo) AS e1, abs(q9 - hi) / (hi - lo) AS e9 FROM e JOIN g USING (unit, cell) WHERE lo <> hi)"""


@query("envelope_recovery", X.sql(f"{RECOVERED} SELECT unit, cell, round(e1, 5) AS error_q10, round(e9, 5) AS error_q90 FROM x"))
def envelope_recovery(s, d):
    return rounded(_recovery(s, d), error_q10=5, error_q90=5)


@query("recovery_by_unit", X.sql(f"""{RECOVERED} SELECT unit, count(*)::BIGINT AS n, round(quantile_cont(e1, 0.5), 5) AS q10_median, round(quantile_cont(e1, 0.95), 5) AS q10_p95,
  round(quantile_cont(e9, 0.5), 5) AS q90_median, round(quantile_cont(e9, 0.95), 5) AS q90_p95 FROM x GROUP BY unit"""))
def recovery_by_unit(s, d):
    return rounded(V.recovery_summary(_recovery(s, d), ["unit"]), q10_median=5, q10_p95=5, q90_median=5, q90_p95=5)


@query("annualised", """WITH n AS (SELECT year(o_orderdate) AS year, count(*) AS n FROM orders GROUP BY 1), l AS (SELECT max(n) AS most FROM n), f AS (SELECT year FROM n, l WHERE n >= most * 0.8),
  d AS (SELECT o_custkey % 5 AS draw, sum(o_totalprice) AS mwh FROM orders WHERE year(o_orderdate) IN (FROM f) GROUP BY 1) SELECT round(avg(mwh) / 1e6 / (SELECT count(*) FROM f), 6) AS twh, count(*)::BIGINT AS draws FROM d""")
def annualised(s, d):
    x = X.read(s, d, "orders", "o_orderdate", "o_custkey", "o_totalprice")
    annual = x.groupBy((F.col("o_custkey") % 5).alias("draw"), F.year("o_orderdate").alias("year")).agg(F.sum("o_totalprice").cast("double").alias("mwh"))
    most = x.groupBy(F.year("o_orderdate").alias("year")).count().agg(F.max("count")).first()[0]
    return rounded(V.annualised(annual, x.select(F.col("o_orderdate").alias("t")), most * 0.8), twh=6)


def _named(s, d, where="true"):
    parts = X.places(X.read(s, d, "part").where(where).withColumn("k", F.col("p_partkey")), "k")
    return parts.select("k", F.col("p_brand").alias("name"), "lat", "lon", (F.col("p_size") * 10.0).alias("voltage"), F.col("p_retailprice").cast("double").alias("mw"))


@query("co_located")
def co_located(s, d):
    return L.co_located(_named(s, d), ["mw"], 25.0)


SPOTS = "a AS (SELECT s_suppkey AS k, 'Brand#' || (s_suppkey % 5 + 1) || (s_suppkey % 4 + 1) AS key, 32 + (s_suppkey * 37 % 1000) / 100.0::DOUBLE AS lat, -124 + (s_suppkey * 91 % 1000) / 100.0::DOUBLE AS lon FROM supplier)"


def _asked(s, d):
    x = X.read(s, d, "supplier", "s_suppkey")
    key = F.concat(F.lit("Brand#"), F.col("s_suppkey") % 5 + 1, F.col("s_suppkey") % 4 + 1)
    return X.places(x.select(F.col("s_suppkey").alias("k"), key.alias("key")), "k")


@query("nearer_by_far", f"""WITH {SPOTS}, b AS (SELECT p_brand AS key, p_partkey AS place, 32 + (p_partkey * 37 % 1000) / 100.0::DOUBLE AS lat, -124 + (p_partkey * 91 % 1000) / 100.0::DOUBLE AS lon FROM part),
  p AS (SELECT a.k, place, {KM} AS km FROM a JOIN b USING (key)), r AS (SELECT *, row_number() OVER w AS n, lead(km) OVER w AS next FROM p WINDOW w AS (PARTITION BY k ORDER BY km, place))
  SELECT k, place, round(km, 6) AS km, round(next, 6) AS runner_up_km FROM r WHERE n = 1 AND km <= 100 AND (next IS NULL OR next >= 2 * km)""")
def nearer_by_far(s, d):
    candidates = _named(s, d, "true").select(F.col("name").alias("key"), F.col("k").alias("place"), "lat", "lon")
    return rounded(L.nearer_by_far(_asked(s, d), candidates, 100.0), km=6, runner_up_km=6)


@query("place_names")
def place_names(s, d):
    asked = _asked(s, d).withColumn("owner", F.when(F.col("k") % 3 == 0, F.concat(F.lit("owner"), F.col("k") % 5))).withColumn("lat", F.when(F.col("k") % 7 != 0, F.col("lat")))
    parts = X.read(s, d, "part", "p_partkey", "p_brand", "p_size").select(F.col("p_brand").alias("key"), F.col("p_partkey").alias("place"), F.concat(F.lit("owner"), F.col("p_partkey") % 5).alias("owner"), "p_size")
    one = lambda where: X.places(parts.where(where).groupBy("key").agg(F.min("place").alias("place")), "place")
    return L.place_names(asked, X.places(parts.where("p_size <= 2"), "place"), one("p_size = 3").select("key", "place"), one("p_size > 3"), 100.0, 400.0)


@query("areas")
def areas(s, d):
    """Areas of points within four squares, else the nearest."""
    ring = lambda x, y: F.array(*[F.struct(F.lit(float(x + i)).alias("x"), F.lit(float(y + j)).alias("y")) for i, j in ((0, 0), (2, 0), (2, 2), (0, 2))])
    squares = s.range(1).select(F.explode(F.array(*[F.struct(F.lit(i).alias("area"), ring(x, y).alias("ring")) for i, (x, y) in enumerate(((-123, 33), (-119, 33), (-123, 38), (-119, 38)))])).alias("a")).select("a.*")
    points = X.places(X.read(s, d, "supplier").select(F.col("s_suppkey").alias("k")), "k")
    return L.area_of(points, squares, P.inside)


@query("requested_hours", """SELECT o_orderkey, year(o_orderdate)::INT AS model_year, h::INT AS hour FROM (SELECT *, (dayofyear(o_orderdate) - 1) * 24 + o_orderkey % 24 + 1 AS h FROM orders)
  WHERE (year(o_orderdate) = 1993 AND h >= 31 * 24 + 1) OR year(o_orderdate) = 1994 OR (year(o_orderdate) = 1995 AND h <= 181 * 24)""")
def requested_hours(s, d):
    hour = (F.dayofyear("o_orderdate") - 1) * 24 + F.col("o_orderkey") % 24 + 1
    x = X.read(s, d, "orders", "o_orderkey", "o_orderdate").select("o_orderkey", F.year("o_orderdate").alias("model_year"), F.lit(2012).alias("weather_year"), hour.cast("int").alias("hour"))
    planned = periods.jobs("1993-02-01:1995-06-30", "2012", range(1992, 1999), [2011, 2012])
    return periods.selected_hours(x, periods.job_table(s, planned)).select("o_orderkey", "model_year", "hour")


def _pair(s, d):
    x = X.series(s, d).withColumn("key", F.col("region") % 2)
    a, b = x.where("region < 2"), x.where("region IN (2, 3)")
    keep = lambda df: df.select("key", "t", "mw", F.when(F.hour("t") % 5 > 0, F.floor("mw").cast("double")).alias("part"))
    return keep(a), keep(b)


@query("source_agreement", X.sql("""SELECT a.region AS key, metric, count(*)::BIGINT AS n, round(corr(x, y), 6) AS corr, round(avg(abs(x - y)), 5) AS mae, round(quantile_cont(abs(x - y), 0.5), 5) AS median_ae,
  count(*) FILTER (abs(x - y) > 200)::BIGINT AS n_large, false AS shifted FROM series a JOIN series b ON b.region = a.region + 2 AND a.t = b.t, (VALUES ('mw'), ('part')) v(metric),
  LATERAL (SELECT CASE WHEN metric = 'mw' THEN a.mw WHEN hour(a.t) % 5 > 0 THEN floor(a.mw) END AS x, CASE WHEN metric = 'mw' THEN b.mw WHEN hour(b.t) % 5 > 0 THEN floor(b.mw) END AS y)
  WHERE a.region < 2 AND x IS NOT NULL AND y IS NOT NULL GROUP BY ALL"""))
def source_agreement(s, d):
    a, b = _pair(s, d)
    return rounded(K.agreement(a, b, ["key"], ["mw", "part"], 200.0), corr=6, mae=5, median_ae=5)


@query("null_anatomy", X.sql(""", x AS (SELECT region, t, hour(t) % 5 = 0 OR (region = 1 AND day(t) < 4) AS gap FROM series), c AS (SELECT *, CASE WHEN gap IS DISTINCT FROM lag(gap) OVER w THEN 1 ELSE 0 END AS new FROM x WINDOW w AS (PARTITION BY region ORDER BY t)),
  r AS (SELECT *, sum(new) OVER (PARTITION BY region ORDER BY t) AS run FROM c), g AS (SELECT region, run, gap, count(*) AS n, min(t) AS a, max(t) AS b FROM r GROUP BY ALL),
  o AS (SELECT region, sum(n)::BIGINT AS rows, (sum(n) FILTER (gap))::BIGINT AS nulls, max(n) FILTER (gap) AS longest, min(a) AS f, max(b) AS l, min(a) FILTER (gap) AS first_null, max(b) FILTER (gap) AS last_null FROM g GROUP BY region)
  SELECT region, 'mw' AS metric, rows, nulls, longest, first_null, last_null, CASE WHEN epoch(last_null - f) / greatest(epoch(l - f), 3600) < 0.25 THEN 'early' WHEN epoch(first_null - f) / greatest(epoch(l - f), 3600) > 0.75 THEN 'recent'
  WHEN longest >= 720 THEN 'long run' WHEN nulls / rows::DOUBLE > 0.5 THEN 'majority' ELSE 'scattered' END AS location FROM o WHERE nulls > 0"""))
def null_anatomy(s, d):
    gap = (F.hour("t") % 5 == 0) | ((F.col("region") == 1) & (F.dayofmonth("t") < 4))
    return K.null_anatomy(X.series(s, d).withColumn("mw", F.when(~gap, F.col("mw"))), ["region"], ["mw"])


@query("shape_invariance", X.sql(""", m AS (SELECT *, mw / avg(mw) OVER (PARTITION BY region) AS shape FROM series), o AS (SELECT t, avg(shape) AS mean FROM m GROUP BY t)
  SELECT region, round(corr(shape, mean), 6) AS corr, count(*)::BIGINT AS n FROM m JOIN o USING (t) GROUP BY region"""))
def shape_invariance(s, d):
    return rounded(K.shape_invariance(X.series(s, d), "region", "mw"), corr=6)


@query("share_variation", X.sql(""", x AS (SELECT region % 2 AS zone, region, t, mw / sum(mw) OVER (PARTITION BY region % 2, t) AS share FROM series)
  SELECT zone, region, round(avg(share), 6) AS share, round(stddev_pop(share) / avg(share), 6) AS cv FROM x GROUP BY ALL"""))
def share_variation(s, d):
    return rounded(K.share_variation(X.series(s, d).withColumn("zone", F.col("region") % 2), "zone", "region", "mw"), share=6, cv=6)


MET = "met AS (SELECT a.t, a.mw AS x, b.mw AS y, 0 AS key FROM series a JOIN series b ON a.t = b.t AND a.region = 0 AND b.region = 1)"


def _met(s, d):
    x = X.series(s, d)
    return x.where("region = 0").select("t", F.col("mw").alias("x")).join(x.where("region = 1").select("t", F.col("mw").alias("y")), "t").withColumn("key", F.lit(0))


@query("worst_hours", X.sql(f", {MET} SELECT key, year(t)::INT AS year, row_number() OVER (PARTITION BY year(t) ORDER BY abs(x - y) DESC, t)::INT AS rank, t, round(x - y, 5) AS diff FROM met QUALIFY rank <= 10"))
def worst_hours(s, d):
    return rounded(K.worst_by_year(_met(s, d), ["key"], 10), diff=5)


@query("annual_differences", X.sql(f", {MET} SELECT key, year(t)::INT AS year, count(*)::BIGINT AS hours, round(sum(x) - sum(y), 4) AS diff, round(100 * (sum(x) - sum(y)) / sum(y), 6) AS percent FROM met GROUP BY ALL"))
def annual_differences(s, d):
    return rounded(K.annual_totals(_met(s, d), ["key"]).drop("x", "y"), diff=4, percent=6)


@query("two_hops", """WITH a AS (SELECT p_partkey AS id, min(p_name) AS name FROM part WHERE p_size > 10 GROUP BY 1), b AS (SELECT p_name AS name, min(p_brand) AS place FROM part WHERE p_size > 45 GROUP BY 1)
  SELECT l_orderkey, l_linenumber, place, (CASE WHEN a.name IS NULL THEN 0 WHEN place IS NULL THEN 1 ELSE 2 END)::INT AS hop FROM lineitem LEFT JOIN a ON a.id = l_partkey LEFT JOIN b ON b.name = a.name""")
def two_hops(s, d):
    parts = X.read(s, d, "part")
    loads = X.read(s, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey").withColumnRenamed("l_partkey", "id")
    names = parts.where("p_size > 10").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return K.two_hops(loads, names, parts.where("p_size > 45").select(F.col("p_name").alias("name"), F.col("p_brand").alias("place"))).select("l_orderkey", "l_linenumber", "place", "hop")


@query("vintages", """WITH x AS (SELECT CASE WHEN year(l_shipdate) <= 1994 THEN 'old' WHEN year(l_shipdate) >= 1997 THEN 'new' END AS side, l_suppkey AS unit, (l_orderkey % 24)::INT AS hour, avg(l_quantity) AS load FROM lineitem GROUP BY ALL),
  p AS (SELECT side, unit, hour AS peak FROM x WHERE side IS NOT NULL QUALIFY row_number() OVER (PARTITION BY side, unit ORDER BY round(load, 6) DESC, hour) = 1), m AS (SELECT side, unit, avg(round(load, 6)) AS mean FROM x WHERE side IS NOT NULL GROUP BY ALL),
  j AS (SELECT * FROM p JOIN m USING (side, unit)), o AS (SELECT * FROM j WHERE side = 'old'), n AS (SELECT * FROM j WHERE side = 'new')
  SELECT coalesce(o.unit, n.unit) AS unit, CASE WHEN o.unit IS NULL THEN 'new' WHEN n.unit IS NULL THEN 'old' ELSE 'both' END AS vintage, o.peak AS peak_old, n.peak AS peak_new, ((n.peak - o.peak + 36) % 24 - 12)::INT AS shift, round(100 * (n.mean - o.mean) / o.mean, 4) AS change
  FROM o FULL JOIN n ON o.unit = n.unit""")
def vintages(s, d):
    x = X.read(s, d, "lineitem", "l_suppkey", "l_orderkey", "l_shipdate", "l_quantity")
    side = F.when(F.year("l_shipdate") <= 1994, 1).when(F.year("l_shipdate") >= 1997, 2)
    loads = x.groupBy(side.alias("vintage"), F.col("l_suppkey").alias("unit"), (F.col("l_orderkey") % 24).cast("int").alias("hour")).agg(F.round(F.avg("l_quantity").cast("double"), 6).alias("load"))
    return rounded(K.vintages(loads, F.col("vintage") == 1, F.col("vintage") == 2), change=4)


@query("uniform_draw", X.sql(stochastic.DRAWN.replace("{when}", "%Y-%m-%d %H") + f""" SELECT region, unit, hour, round(avg(mu + sigma * {S.Z90 / 0.8!r}::DOUBLE * (2 * ({X.cdf_sql("w")}) - 1)), 6) AS mean_mw, count(*)::BIGINT AS n_hours FROM ws GROUP BY ALL"""))
def uniform_draw(s, d):
    """Cell means of one draw of the uniform family for each region, with noise by the hour."""
    env = E.coarsen(E.fit_envelope(X.profiles(s, d)), ["hour"])
    hourly = X.series(s, d).withColumn("hour", F.hour("t"))
    drawn = E.generate(env, E.standardised(hourly), E.system_cells(hourly, E.fit_envelope(X.profiles(s, d))), 7, 0, "uniform", True)
    return drawn.groupBy("region", "unit", "hour").agg(F.round(F.avg("load"), 6).alias("mean_mw"), F.count("*").alias("n_hours"))


@query("normal_cdf", f"SELECT s_suppkey AS k, round({X.cdf_sql('((s_suppkey % 800) / 100.0::DOUBLE - 4)')}, 10) AS p FROM supplier")
def normal_cdf(s, d):
    return X.read(s, d, "supplier", "s_suppkey").select(F.col("s_suppkey").alias("k"), F.round(S.normal_cdf((F.col("s_suppkey") % 800) / 100.0 - 4), 10).alias("p"))


@query("coordinate_overrides", """SELECT p_partkey AS k, CASE WHEN p_size > 25 THEN p_size + 0.5::DOUBLE ELSE o.lat END AS lat, CASE WHEN p_size > 25 THEN 'own' WHEN o.lat IS NOT NULL THEN 'override' ELSE 'none' END AS coordinates
  FROM part LEFT JOIN (SELECT p_brand AS owner, p_name AS name, min(p_partkey)::DOUBLE AS lat FROM part WHERE p_size <= 5 GROUP BY ALL) o ON o.owner = p_brand AND o.name = p_name""")
def coordinate_overrides(s, d):
    x = X.read(s, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("owner"), F.col("p_name").alias("name"), "p_size")
    own = F.when(F.col("p_size") > 25, F.col("p_size") + 0.5)
    given = x.where("p_size <= 5").groupBy("owner", "name").agg(F.min("k").cast("double").alias("lat")).withColumn("lon", F.col("lat"))
    return L.overridden(x.withColumns({"lat": own, "lon": own}), given).select("k", "lat", "coordinates")


@query("overlaid_target", X.sql(""", a AS (SELECT t, mw FROM series WHERE region = 0), b AS (SELECT t, sum(mw) AS mw FROM series WHERE region IN (1, 2) GROUP BY t), c AS (SELECT t, mw FROM series WHERE region = 3)
  SELECT a.t, round(1.25::DOUBLE * a.mw + coalesce(b.mw, 0) - coalesce(c.mw, 0), 5) AS mw FROM a LEFT JOIN b USING (t) LEFT JOIN c USING (t)"""))
def overlaid_target(s, d):
    x = X.series(s, d)
    part = lambda where: x.where(where).select("t", "mw")
    return rounded(C.overlaid(part("region = 0"), 1.25, part("region IN (1, 2)"), part("region = 3"), ["t"]), mw=5)
