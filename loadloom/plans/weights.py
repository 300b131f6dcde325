"""Queries of profiles, cells, weights and disaggregation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import relational as R
from ..operators import weights as W
from . import fixtures as X
from .registry import query

AVG = "loads AS (SELECT *, (min_load + max_load) / 2 AS avg_load FROM profiles)"


def _loads(s, d):
    return W.average_load(X.profiles(s, d))


@query("profile_load", X.sql(f", {AVG} SELECT unit, month, hour, round(avg_load, 6) AS avg_load FROM loads"))
def profile_load(s, d):
    return _loads(s, d).select("unit", "month", "hour", F.round("avg_load", 6).alias("avg_load"))


for level, keys in W.LEVELS.items():
    columns = "".join(f"{k}, " for k in keys)

    @query(f"level_{level}", X.sql(f", {AVG} SELECT unit, {columns} round(avg(avg_load), 5) AS avg_load FROM loads GROUP BY ALL"))
    def level_query(s, d, level=level, keys=keys):
        return W.aggregate_to_level(_loads(s, d), level).select("unit", *keys, F.round("avg_load", 5).alias("avg_load"))


WEIGHTS = f""", {AVG}, w AS (SELECT region, unit, month, hour, CASE WHEN sum(greatest(avg_load, 0)) OVER p > 0
  THEN greatest(avg_load, 0) / sum(greatest(avg_load, 0)) OVER p ELSE 1.0 / count(*) OVER p END AS weight
  FROM loads JOIN units USING (unit) WINDOW p AS (PARTITION BY region, month, hour))"""


@query("weights_monthhour", X.sql(f"{WEIGHTS} SELECT region, unit, month, hour, round(weight, 10) AS weight FROM w"))
def weights_monthhour(s, d):
    return W.single_stage(_loads(s, d), X.units(s, d)).select("region", "unit", "month", "hour", F.round("weight", 10).alias("weight"))


@query("weights_conserve", X.sql(f"{WEIGHTS} SELECT region, month, hour, round(sum(weight), 9) AS total, count(*)::BIGINT AS n FROM w GROUP BY ALL"))
def weights_conserve(s, d):
    return W.single_stage(_loads(s, d), X.units(s, d)).groupBy("region", "month", "hour").agg(F.round(F.sum("weight"), 9).alias("total"), F.count("*").alias("n"))


@query("flagship_disaggregate", X.sql(f"""{WEIGHTS} SELECT s.region, unit, month(t)::INT AS month, hour(t)::INT AS hour, round(sum(mw * weight), 7) AS load
  FROM series s JOIN w ON w.region = s.region AND w.month = month(t) AND w.hour = hour(t) GROUP BY ALL"""))
def flagship_disaggregate(s, d):
    """Every region's series over its units, by cell; the sum is taken below the join, as its keys are the join's."""
    dealt = W.disaggregate_by(X.series(s, d), W.single_stage(_loads(s, d), X.units(s, d)), month=F.month("t"), hour=F.hour("t"))
    return dealt.select("region", "unit", "month", "hour", F.round("energy", 7).alias("load"))


@query("hourly_loads", X.sql(f"""{WEIGHTS} SELECT s.region, unit, t, round(mw * weight, 7) AS load
  FROM series s JOIN w ON w.region = s.region AND w.month = month(t) AND w.hour = hour(t)"""))
def hourly_loads(s, d):
    """The same hour by hour."""
    hourly = W.disaggregate(X.series(s, d), W.single_stage(_loads(s, d), X.units(s, d)))
    return hourly.select("region", "unit", "t", F.round("load", 7).alias("load"))


@query("disaggregate_totals", X.sql(f"""{WEIGHTS} SELECT s.region, unit, round(sum(mw * weight), 3) AS energy
  FROM series s JOIN w ON w.region = s.region AND w.month = month(t) AND w.hour = hour(t) GROUP BY ALL"""))
def disaggregate_totals(s, d):
    return W.disaggregate_totals(X.series(s, d), W.single_stage(_loads(s, d), X.units(s, d))).select("region", "unit", F.round("energy", 3).alias("energy"))


@query("county_fractions", X.sql("""SELECT region, county, round(l / sum(l) OVER (PARTITION BY region), 9) AS fraction
  FROM (SELECT region, county, sum(greatest(level, 0)) AS l FROM units GROUP BY ALL)"""))
def county_fractions(s, d):
    return W.county_fractions(X.units(s, d)).select("region", "county", F.round("fraction", 9).alias("fraction"))


@query("chain_weights", X.sql(f""", {AVG}, c AS (SELECT region, county, l / sum(l) OVER (PARTITION BY region) AS fraction
    FROM (SELECT region, county, sum(greatest(level, 0)) AS l FROM units GROUP BY ALL)),
  o AS (SELECT county, month, hour, unit, greatest(avg_load, 0) / nullif(sum(greatest(avg_load, 0)) OVER (PARTITION BY county, month, hour), 0) AS own
    FROM loads JOIN units USING (unit)),
  g AS (SELECT c.*, month, hour FROM c, (SELECT DISTINCT month, hour FROM loads))
  SELECT region, county, month, hour, unit::VARCHAR AS name, round(fraction * own, 10) AS weight FROM o JOIN c USING (county)
  UNION ALL SELECT region, county, month, hour, 'SYNTHETIC_' || county, round(fraction, 10) FROM g
    WHERE NOT EXISTS (FROM o WHERE o.county = g.county AND o.month = g.month AND o.hour = g.hour)"""))
def chain_weights(s, d):
    u = X.units(s, d)
    return W.chain(_loads(s, d), u, W.county_fractions(u)).select("region", "county", "month", "hour", "name", F.round("weight", 10).alias("weight"))


@query("cell_codes", """SELECT l_orderkey, l_linenumber, ((month(l_shipdate) - 1) * 24 + l_orderkey % 24)::INT AS cell, ((month(l_shipdate) % 12) // 3)::INT AS season,
  (month(l_shipdate) BETWEEN 4 AND 9)::INT AS half, CASE WHEN month(l_shipdate) BETWEEN 3 AND 10 THEN ((l_orderkey + 23) % 24) ELSE l_orderkey % 24 END::INT AS standard_hour FROM lineitem""")
def cell_codes(s, d):
    m, h = F.month("l_shipdate"), (F.col("l_orderkey") % 24).cast("int")
    return X.read(s, d, "lineitem").select("l_orderkey", "l_linenumber", S.cell(m, h).alias("cell"), S.season(m).alias("season"), S.half_year(m).alias("half"), S.wall_clock_to_standard(m, h).alias("standard_hour"))


@query("unit_ranks", X.sql(f", {AVG} SELECT unit, month, rank() OVER (PARTITION BY month ORDER BY a DESC)::INT AS rank FROM (SELECT unit, month, round(avg(avg_load), 6) AS a FROM loads GROUP BY ALL)"))
def unit_ranks(s, d):
    monthly = W.aggregate_to_level(_loads(s, d), "monthly").withColumn("a", F.round("avg_load", 6))
    return R.min_rank(monthly, ["month"], "a").select("unit", "month", "rank")


@query("level_grouping_sets", X.sql(f""", {AVG} SELECT unit, coalesce(month, -1) AS month, coalesce(hour, -1) AS hour, round(avg(avg_load), 5) AS avg_load, count(*)::BIGINT AS n FROM loads
  GROUP BY GROUPING SETS ((unit), (unit, month), (unit, hour))"""))
def level_grouping_sets(s, d):
    u, m, h = F.col("unit"), F.col("month"), F.col("hour")
    return _loads(s, d).groupingSets([[u], [u, m], [u, h]], u, m, h).agg(F.round(F.avg("avg_load"), 5).alias("avg_load"), F.count("*").alias("n")).fillna(-1, ["month", "hour"])


@query("peak_hour", X.sql(f", {AVG} SELECT unit, month, hour FROM loads QUALIFY row_number() OVER (PARTITION BY unit, month ORDER BY avg_load DESC, hour) = 1"))
def peak_hour(s, d):
    return R.first_by(W.average_load(X.sql_profiles(s, d)), ["unit", "month"], F.desc("avg_load"), F.asc("hour")).select("unit", "month", "hour")
