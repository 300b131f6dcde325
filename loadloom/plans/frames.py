"""Queries of joins, groupings and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import frames as J
from ..operators import relational as R
from ..operators import statistics as T
from ..operators import weights as W
from . import fixtures as X
from .registry import query


def _events(s, d):
    return X.read(s, d, "events", "event_id", "ts", "user_id", "event_type", "value")


def _daily(s, d):
    """A series of several years: order totals by day and status."""
    o = X.read(s, d, "orders", "o_orderdate", "o_orderstatus", "o_totalprice")
    return o.groupBy(F.col("o_orderstatus").alias("region"), F.col("o_orderdate").alias("t")).agg(F.sum("o_totalprice").alias("mw"))


DAILY = "daily AS (SELECT o_orderstatus AS region, o_orderdate AS t, sum(o_totalprice) AS mw FROM orders GROUP BY ALL)"


@query("as_of_join", """WITH e AS (SELECT * FROM events WHERE event_type = 'error'), v AS (SELECT user_id, ts, max(value) AS last FROM events WHERE event_type = 'click' GROUP BY ALL)
  SELECT e.event_id, v.last FROM e ASOF LEFT JOIN v ON e.user_id = v.user_id AND e.ts >= v.ts""")
def as_of_join(s, d):
    e = _events(s, d)
    return J.as_of(e.where("event_type = 'error'").select("event_id", "user_id", "ts"), e.where("event_type = 'click'").select("user_id", "ts", "value"), ["user_id"], "ts", "value", "last").select("event_id", "last")


@query("interval_join", """WITH i AS (SELECT event_id AS i, ts AS a, ts + INTERVAL 90 MINUTE AS b FROM events WHERE event_id % 50 = 0) SELECT event_id, i FROM events JOIN i ON ts >= a AND ts < b""")
def interval_join(s, d):
    e = _events(s, d)
    i = e.where("event_id % 50 = 0").select(F.col("event_id").alias("i"), F.col("ts").alias("a"), (F.col("ts") + F.expr("INTERVAL 90 MINUTES")).alias("b"))
    return J.within_intervals(e.select("event_id", "ts"), i, "ts", "a", "b", 5400).select("event_id", "i")


LOADS = ", loads AS (SELECT unit, month, hour, (min_load + max_load) / 2 AS avg_load FROM profiles)"


@query("cyclic_neighbours", X.sql(f"""{LOADS}, m AS (SELECT unit, hour, round(avg(avg_load), 6) AS load FROM loads GROUP BY ALL)
  SELECT m.unit, m.hour, m.load, a.load AS load_lag1, b.load AS load_lead2 FROM m LEFT JOIN m a ON a.unit = m.unit AND a.hour = (m.hour + 23) % 24 LEFT JOIN m b ON b.unit = m.unit AND b.hour = (m.hour + 2) % 24"""))
def cyclic_neighbours(s, d):
    m = W.aggregate_to_level(W.average_load(X.profiles(s, d)), "hourly").select("unit", "hour", F.round("avg_load", 6).alias("load"))
    return J.neighbours_in_cycle(m, ["unit"], "hour", 24, "load", (-1, 2))


@query("looked_up", "SELECT s_suppkey AS k, n_name AS name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_nationkey < 20")
def looked_up(s, d):
    table = X.read(s, d, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("name"))
    return J.looked_up(X.read(s, d, "supplier"), table, ["s_nationkey"]).select(F.col("s_suppkey").alias("k"), "name")


@query("years_by_vintage", """WITH y AS (SELECT year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month, sum(o_totalprice) AS mw FROM orders GROUP BY ALL), v AS (SELECT year(l_shipdate)::INT AS vintage, month(l_shipdate)::INT AS month, sum(l_quantity) AS q FROM lineitem GROUP BY ALL)
  SELECT year, vintage, month, round(mw / q, 4) AS ratio FROM y JOIN v USING (month)""")
def years_by_vintage(s, d):
    y = X.read(s, d, "orders").groupBy(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg(F.sum("o_totalprice").alias("mw"))
    v = X.read(s, d, "lineitem").groupBy(F.year("l_shipdate").alias("vintage"), F.month("l_shipdate").alias("month")).agg(F.sum("l_quantity").alias("q"))
    return J.by_month(y, v).select("year", "vintage", "month", F.round(F.col("mw") / F.col("q"), 4).alias("ratio"))


@query("trailing_years", f"""WITH {DAILY}, y AS (SELECT year(t) AS y FROM daily GROUP BY 1 HAVING count(mw) >= 200 ORDER BY 1 DESC LIMIT 2)
  SELECT region, year(t)::INT AS year, count(*)::BIGINT AS n, round(sum(mw), 2) AS mw FROM daily WHERE year(t) IN (FROM y) GROUP BY ALL""")
def trailing_years(s, d):
    kept = J.trailing_years(_daily(s, d), 2, 200)
    return kept.groupBy("region", F.year("t").alias("year")).agg(F.count("*").alias("n"), F.round(F.sum("mw"), 2).alias("mw"))


@query("totals_as_rows", X.sql(", t AS (SELECT t, region::VARCHAR AS region, mw FROM series UNION ALL SELECT t, 'south', sum(mw) FROM series WHERE region IN (0, 1) GROUP BY t UNION ALL SELECT t, 'total', sum(mw) FROM series GROUP BY t) SELECT t, region, round(mw, 5) AS mw FROM t"))
def totals_as_rows(s, d):
    return J.with_totals(X.series(s, d), "region", "mw", ["t"], {"south": (0, 1), "total": ()}).withColumn("mw", F.round("mw", 5))


@query("latest_vintage", "SELECT unit, month, year, q FROM (SELECT l_suppkey AS unit, month(l_shipdate)::INT AS month, year(l_shipdate)::INT AS year, round(sum(l_quantity), 4) AS q FROM lineitem GROUP BY ALL) QUALIFY year = max(year) OVER (PARTITION BY unit, month)")
def latest_vintage(s, d):
    v = X.read(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("unit"), F.month("l_shipdate").alias("month"), F.year("l_shipdate").alias("year")).agg(F.round(F.sum("l_quantity"), 4).alias("q"))
    return J.latest(v, ["unit", "month"], "year")


@query("coincident_sums", X.sql(f"{LOADS} SELECT region, month, hour, round(sum(avg_load), 4) AS mw, count(*)::BIGINT AS units FROM loads JOIN units USING (unit) GROUP BY ALL"))
def coincident_sums(s, d):
    joined = W.average_load(X.profiles(s, d)).join(X.units(s, d).select("unit", "region"), "unit")
    return joined.groupBy("region", "month", "hour").agg(F.round(F.sum("avg_load"), 4).alias("mw"), F.count("*").alias("units"))


@query("climatology", f"""WITH {DAILY}, k AS (SELECT region, month(t)::INT AS month, t, mw FROM daily), y AS (SELECT region, month, year(t) AS y, avg(mw) AS m FROM k GROUP BY ALL), e AS (SELECT region, month, t::DATE AS y, avg(mw) AS m FROM k GROUP BY ALL),
  a AS (SELECT region, month, round(quantile_cont(m, 0.1), 3) AS year_p10, round(quantile_cont(m, 0.9), 3) AS year_p90, round(min(m), 3) AS year_min, round(max(m), 3) AS year_max FROM y GROUP BY ALL),
  b AS (SELECT region, month, round(quantile_cont(m, 0.1), 3) AS day_p10, round(quantile_cont(m, 0.9), 3) AS day_p90, round(min(m), 3) AS day_min, round(max(m), 3) AS day_max FROM e GROUP BY ALL) SELECT * FROM a JOIN b USING (region, month)""")
def climatology(s, d):
    found = J.climatology(_daily(s, d).withColumn("month", F.month("t")), ["region", "month"])
    return found.select("region", "month", *[F.round(c, 3).alias(c) for c in found.columns[2:]])


@query("listed_names", "SELECT p_brand AS brand, string_agg(DISTINCT p_type, ', ' ORDER BY p_type) AS types FROM part GROUP BY 1")
def listed_names(s, d):
    return J.listed(X.read(s, d, "part").withColumnRenamed("p_brand", "brand"), ["brand"], "p_type", "types")


@query("margins", """SELECT CASE WHEN grouping(p_type) = 1 THEN 'All' ELSE p_type END AS "row", CASE WHEN grouping(p_size % 4) = 1 THEN 'All' ELSE (p_size % 4)::VARCHAR END AS "column", count(*)::BIGINT AS n FROM part GROUP BY CUBE (p_type, p_size % 4)""")
def margins(s, d):
    return J.margins(X.read(s, d, "part").withColumn("rest", F.col("p_size") % 4), "p_type", "rest")


@query("level_rollup", X.sql(f"{LOADS} SELECT coalesce(region, -1) AS region, coalesce(county, -1) AS county, coalesce(month, -1) AS month, round(sum(avg_load), 3) AS mw FROM loads JOIN units USING (unit) GROUP BY ROLLUP (region, county, month)"))
def level_rollup(s, d):
    joined = W.average_load(X.profiles(s, d)).join(X.units(s, d), "unit")
    return joined.rollup("region", "county", "month").agg(F.round(F.sum("avg_load"), 3).alias("mw")).fillna(-1, ["region", "county", "month"])


@query("scaled_to_annual", f"""WITH {DAILY}, f AS (SELECT region, y, 1e6 * (1 + y % 3) / e AS f FROM (SELECT region, year(t) AS y, sum(mw) AS e FROM daily WHERE year(t) < 2000 GROUP BY ALL))
  SELECT d.region, t, round(mw * coalesce(f, 1), 4) AS mw FROM daily d LEFT JOIN f ON f.region = d.region AND f.y = year(t)""")
def scaled_to_annual(s, d):
    daily = _daily(s, d)
    targets = daily.select("region", F.year("t").alias("year")).where("year < 2000").distinct().withColumn("energy", 1e6 * (1 + F.col("year") % 3))
    return J.scaled_to_annual(daily, targets, ["region"]).select("region", "t", F.round("mw", 4).alias("mw"))


@query("hours_of_year", f"WITH {DAILY} SELECT region, t, row_number() OVER (PARTITION BY region, year(t) ORDER BY t)::INT AS hour_of_year FROM daily WHERE NOT (month(t) = 2 AND day(t) = 29)")
def hours_of_year(s, d):
    return J.hours_of_year(_daily(s, d), ["region"]).select("region", "t", "hour_of_year")


@query("rolling_windows", X.sql(""" SELECT region, t, round(avg(mw) OVER (PARTITION BY region ORDER BY t RANGE BETWEEN INTERVAL 5 HOUR PRECEDING AND CURRENT ROW), 6) AS mean, ntile(4) OVER (PARTITION BY region ORDER BY mw, t)::INT AS quartile,
  round(cume_dist() OVER (PARTITION BY region ORDER BY mw), 9) AS part FROM series"""))
def rolling_windows(s, d):
    return J.rolling(X.series(s, d), ["region"], "t", "mw", 6).select("region", "t", F.round("mean", 6).alias("mean"), "quartile", F.round("part", 9).alias("part"))


@query("wide_and_long", X.sql(f"{LOADS} SELECT unit, month, hour, round(avg_load, 6) AS avg_load FROM loads"))
def wide_and_long(s, d):
    long = W.average_load(X.profiles(s, d)).select("unit", "month", "hour", F.round("avg_load", 6).alias("avg_load"))
    wide = J.to_columns(long, ["unit", "month"], "hour", "avg_load", range(24), "hour_")
    return J.to_rows(wide, ["unit", "month"], "hour_", "hour", "avg_load")


@query("common_range", f"WITH {DAILY}, e AS (SELECT max(a) AS a, min(b) AS b FROM (SELECT min(t) AS a, max(t) AS b FROM daily GROUP BY region)) SELECT region, count(*)::BIGINT AS n, round(sum(mw), 2) AS mw FROM daily, e WHERE t BETWEEN a AND b GROUP BY region")
def common_range(s, d):
    return J.trimmed_to_common(_daily(s, d), "region").groupBy("region").agg(F.count("*").alias("n"), F.round(F.sum("mw"), 2).alias("mw"))


@query("peaks_with_total", X.sql(", t AS (SELECT t, region::VARCHAR AS region, mw FROM series UNION ALL SELECT t, 'all', sum(mw) FROM series GROUP BY t) SELECT region, t::DATE AS day, hour(t)::INT AS hour, round(mw, 5) AS mw FROM t QUALIFY row_number() OVER (PARTITION BY region, t::DATE ORDER BY mw DESC, t) = 1"))
def peaks_with_total(s, d):
    return J.peak_by_day(X.series(s, d), "region", "all").withColumn("mw", F.round("mw", 5))


@query("composite_columns", X.sql(""" SELECT t, round(coalesce(sum(mw) FILTER (region = 0), 0) + coalesce(sum(mw) FILTER (region = 1), 0), 5) AS south, round(coalesce(sum(mw) FILTER (region = 3), 0) + coalesce(sum(mw) FILTER (region = 4), 0), 5) AS north FROM series GROUP BY t"""))
def composite_columns(s, d):
    wide = J.to_columns(X.series(s, d), ["t"], "region", "mw", range(5), "r")
    out = J.composites(wide, {"south": ["r0", "r1"], "north": ["r3", "r4"]})
    return out.select("t", F.round("south", 5).alias("south"), F.round("north", 5).alias("north"))


@query("deviations", X.sql(""" , w AS (SELECT t, sum(mw) FILTER (region = 0) AS a, sum(mw) FILTER (region = 1) AS b FROM series GROUP BY t)
  SELECT hour(t)::INT AS hour, round(sqrt(avg((b - a) * (b - a))) / nullif(avg(a), 0), 6) AS rel_rmse, round(avg(b - a) / nullif(avg(a), 0), 6) AS bias FROM w GROUP BY 1"""))
def deviations(s, d):
    wide = J.to_columns(X.series(s, d), ["t"], "region", "mw", range(2), "r").withColumn("hour", F.hour("t"))
    return J.deviations(wide, ["hour"], "r0", "r1").select("hour", F.round("rel_rmse", 6).alias("rel_rmse"), F.round("bias", 6).alias("bias"))


@query("unused_columns", "SELECT * FROM (VALUES ('p_retailprice'), ('p_type')) t(\"column\")")
def unused_columns(s, d):
    raw = X.read(s, d, "part")
    clean = raw.select(F.col("p_partkey").alias("node"), "p_name", "p_brand", "p_size")
    return s.createDataFrame([(c,) for c in J.unused_columns(raw, clean, {"p_partkey": "node"})], "column string")


@query("rolled_up", """WITH c AS (SELECT p_brand, p_type, count(*) AS n, min(p_partkey) AS f FROM part GROUP BY ALL), t AS (SELECT p_brand AS brand, sum(p_size)::BIGINT AS size, round(sum(p_retailprice), 4) AS price, count(*)::BIGINT AS n FROM part GROUP BY 1)
  SELECT t.*, p_type FROM t JOIN (SELECT p_brand, p_type FROM c QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, f) = 1) m ON m.p_brand = brand""")
def rolled_up(s, d):
    p = X.read(s, d, "part").select(F.col("p_brand").alias("brand"), "p_type", "p_partkey", F.col("p_size").cast("long").alias("size"), F.col("p_retailprice").alias("price"))
    return J.dominant(p, ["brand"], ["size", "price"], "p_type", "p_partkey").withColumn("price", F.round("price", 4))


@query("override_checks", """WITH o AS (SELECT s_suppkey AS k, 32 + (s_suppkey * 37 % 1000) / 100.0::DOUBLE + (s_suppkey % 7 = 0)::INT * 0.5 AS lat, -124 + (s_suppkey * 91 % 1000) / 100.0::DOUBLE AS lon FROM supplier UNION ALL SELECT 3, 60, -120 UNION ALL SELECT -5, 35, -120),
  j AS (SELECT o.k, o.lat, o.lon, p.k AS known, (SELECT count(*) FROM o x WHERE x.k = o.k) AS n, 32 + (o.k * 37 % 1000) / 100.0::DOUBLE AS site FROM o LEFT JOIN supplier ON s_suppkey = o.k LEFT JOIN (SELECT s_suppkey AS k FROM supplier) p ON p.k = o.k)
  SELECT k, 'repeated' AS problem FROM j WHERE n > 1 UNION ALL SELECT k, 'outside' FROM j WHERE lat NOT BETWEEN 32 AND 42 OR lon NOT BETWEEN -125 AND -114 UNION ALL SELECT k, 'unknown' FROM j WHERE known IS NULL UNION ALL SELECT k, 'far' FROM j WHERE known IS NOT NULL AND abs(lat - site) * 111.19 > 25""")
def override_checks(s, d):
    sites = X.places(X.read(s, d, "supplier").select(F.col("s_suppkey").alias("k")), "k")
    moved = sites.withColumn("lat", F.col("lat") + F.when(F.col("k") % 7 == 0, 0.5).otherwise(0.0))
    extra = s.createDataFrame([(3, 60.0, -120.0), (-5, 35.0, -120.0)], "k long, lat double, lon double")
    km = S.haversine_km(F.col("lat"), F.col("lon"), F.col("site_lat"), F.col("site_lon"))
    return J.checked_overrides(moved.unionByName(extra), sites, (32, 42, -125, -114), 25.0, km)


@query("moments_by_cell", X.sql(""", a AS (SELECT region, month(t) * 100 + hour(t) AS cell, mw, pow(0.5, ((SELECT max(t) FROM series)::DATE - t::DATE) / 10.0::DOUBLE) AS w FROM series), m AS (SELECT region, cell, sum(w) AS w, sum(w * mw) AS y, sum(w * mw * mw) AS yy, sum(w * w) AS ww FROM a GROUP BY ALL)
  SELECT region, cell::INT AS cell, round(y / w, 6) AS mean, round(CASE WHEN w * w / ww > 1.000001 THEN sqrt(greatest(yy / w - (y / w) * (y / w), 0) * (w * w / ww) / (w * w / ww - 1)) END, 4) AS sd, round(w * w / ww, 6) AS n_eff FROM m"""))
def moments_by_cell(s, d):
    x = X.series(s, d)
    last = x.agg(F.max(F.to_date("t")).alias("_last"))
    x = x.crossJoin(F.broadcast(last)).withColumn("w", F.pow(F.lit(0.5), F.datediff("_last", "t") / 10.0)).withColumn("cell", (F.month("t") * 100 + F.hour("t")).cast("int"))
    return R.weighted_moments(x, ["region", "cell"], "mw", "w").select("region", "cell", F.round("mean", 6).alias("mean"), F.round("sd", 4).alias("sd"), F.round("n_eff", 6).alias("n_eff"))


SPLITS = {"months": "month", "quarters": "(month - 1) // 3", "seasons": "(month % 12) // 3", "thirds": "(month - 1) // 4", "halves": "(month BETWEEN 4 AND 9)::INT", "year": "0"}


@query("season_partitions", X.sql(f"{LOADS}, p AS (" + " UNION ALL ".join(f"SELECT '{n}' AS partition, ({e})::VARCHAR AS l, avg_load AS v FROM loads" for n, e in SPLITS.items()) + "), m AS (SELECT *, avg(v) OVER (PARTITION BY partition, l) AS m FROM p) SELECT partition, round(var_pop(m) / var_pop(v), 6) AS explained FROM m GROUP BY partition"))
def season_partitions(s, d):
    m = F.col("month")
    parts = {"months": m, "quarters": F.floor((m - 1) / 3), "seasons": S.season(m), "thirds": F.floor((m - 1) / 4), "halves": S.half_year(m), "year": F.lit(0)}
    return T.explained(W.average_load(X.profiles(s, d)), parts, "avg_load").withColumn("explained", F.round("explained", 6))
