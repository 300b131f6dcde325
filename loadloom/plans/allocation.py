"""Queries of levels, allocation and rounding."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import allocation as A
from ..operators import relational as R
from . import fixtures as X
from .registry import query

NODES = "nodes AS (SELECT p_partkey AS node, p_brand AS base, (p_size - 8)::DOUBLE AS level, (p_partkey % 2)::INT AS block FROM part)"


def _nodes(s, d):
    return X.read(s, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("base"), (F.col("p_size") - 8).cast("double").alias("level"), (F.col("p_partkey") % 2).cast("int").alias("block"))


LEVEL_SQL = {
    "net-base": """x AS (SELECT *, CASE WHEN sum(greatest(level, 0)) OVER b > 0 THEN greatest(level, 0) * greatest(sum(level) OVER b, 0) / sum(greatest(level, 0)) OVER b ELSE 0 END AS l
      FROM nodes WINDOW b AS (PARTITION BY block, base))""",
    "zero": "x AS (SELECT *, greatest(level, 0) AS l FROM nodes)",
    "participate": "x AS (SELECT *, level AS l FROM nodes)",
}
for mode, text in LEVEL_SQL.items():

    @query(f"level_shares_{mode.replace('-', '_')}", f"WITH {NODES}, {text} SELECT node, block, round(l / sum(l) OVER (PARTITION BY block), 9) AS share FROM x")
    def level_shares(s, d, mode=mode):
        return A.level_shares(_nodes(s, d), mode).select("node", "block", F.round("share", 9).alias("share"))


@query("net_to_gross", f"WITH {NODES} SELECT base, round(abs(sum(level)) / nullif(sum(abs(level)), 0), 9) AS kappa FROM nodes GROUP BY base")
def net_to_gross(s, d):
    return _nodes(s, d).groupBy("base").agg(F.round(F.abs(F.sum("level")) / F.nullif(F.sum(F.abs("level")), F.lit(0.0)), 9).alias("kappa"))


SIGNED = """x AS (SELECT s_nationkey AS k, s_suppkey AS o, s_acctbal / 7 AS v FROM supplier), u AS (SELECT *, floor(v * 10)::BIGINT AS u, v * 10 - floor(v * 10) AS r FROM x),
  g AS (SELECT *, round_even({target} * 10, 0)::BIGINT - sum(u) OVER p AS gap, row_number() OVER (PARTITION BY k ORDER BY r DESC, o) AS up, row_number() OVER (PARTITION BY k ORDER BY {has} DESC, r, o) AS down FROM u WINDOW p AS (PARTITION BY k))
  SELECT k, o, (u + CASE WHEN up <= gap THEN 1 WHEN gap < 0 AND {has} AND down <= -gap THEN -1 ELSE 0 END) / 10.0::DOUBLE AS printed FROM g"""


def _balances(s, d, absolute):
    v = F.col("s_acctbal") / 7
    return X.read(s, d, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("o"), (F.abs(v) if absolute else v).alias("v"))


@query("largest_remainder", "WITH " + SIGNED.format(target="sum(v) OVER p", has="(u >= 1)").replace("s_acctbal / 7", "abs(s_acctbal / 7)"))
def largest_remainder(s, d):
    return R.round_to_printed(_balances(s, d, True), ["k"], "v", "o", 1).select("k", "o", "printed")


@query("signed_remainder", "WITH " + SIGNED.format(target="(sum(v) OVER p - 0.1)", has="true"))
def signed_remainder(s, d):
    target = F.sum("v").over(Window.partitionBy("k")) - 0.1
    return R.round_to_printed(_balances(s, d, False), ["k"], "v", "o", 1, target, allow_negative=True).select("k", "o", "printed")


@query("taken_back", "WITH " + SIGNED.format(target="(sum(v) OVER p - 0.05 * count(*) OVER p)", has="(u >= 1)").replace("s_acctbal / 7", "abs(s_acctbal / 7)"))
def taken_back(s, d):
    by = Window.partitionBy("k")
    return R.round_to_printed(_balances(s, d, True), ["k"], "v", "o", 1, F.sum("v").over(by) - 0.05 * F.count("*").over(by)).select("k", "o", "printed")


COVER = """n AS (SELECT s_suppkey AS node, s_nationkey AS county, greatest(s_acctbal, 0) AS weight, s_suppkey % 3 <> 0 AS covered FROM supplier),
  c AS (SELECT county, count(*) / (sum(count(*)) OVER ())::DOUBLE AS fraction FROM n GROUP BY county),
  q AS (SELECT *, count(*) OVER p AS cn, sum((NOT covered)::INT) OVER p AS u, sum(CASE WHEN covered THEN weight ELSE 0 END) OVER p AS t FROM n JOIN c USING (county) WINDOW p AS (PARTITION BY county))"""


@query("county_first_shares", f"""WITH {COVER} SELECT node, county, round(fraction * CASE WHEN t <= 0 THEN 1.0 / cn WHEN covered THEN (1 - u / cn) * weight / t
  ELSE (CASE WHEN t > 0 THEN u / cn ELSE 1 END) / u END, 9) AS share FROM q""")
def county_first_shares(s, d):
    n = X.read(s, d, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("county"), F.greatest("s_acctbal", F.lit(0.0)).alias("weight"), (F.col("s_suppkey") % 3 != 0).alias("covered"))
    total = n.agg(F.count("*").alias("_all"))
    c = n.groupBy("county").agg(F.count("*").alias("_n")).crossJoin(total).select("county", (F.col("_n") / F.col("_all")).alias("fraction"))
    return A.county_first(n, c).select("node", "county", F.round("share", 9).alias("share"))


DEMAND = "demand AS (SELECT t, region AS zone, mw FROM series), shares(zone, share) AS (VALUES (0, 0.5), (1, 0.3), (2, 0.2))"
for hold in (False, True):

    @query(f"rescale_{'hold' if hold else 'full'}", X.sql(f""", {DEMAND}, tot AS (SELECT t, sum(mw) AS total FROM demand {'WHERE zone < 3' if hold else ''} GROUP BY t)
      SELECT t, zone, round(total * share, 5) AS mw FROM tot, shares UNION ALL SELECT t, zone, {'round(mw, 5)' if hold else '0.0'} FROM demand WHERE zone >= 3"""))
    def rescaled(s, d, hold=hold):
        demand = X.series(s, d).withColumnRenamed("region", "zone")
        shares = s.createDataFrame([(0, 0.5), (1, 0.3), (2, 0.2)], "zone int, share double")
        return A.rescale(demand, shares, hold).withColumn("mw", F.round("mw", 5))


@query("county_fixed_alpha", f"""WITH {COVER} SELECT node, county, round(fraction * CASE WHEN t <= 0 THEN 1.0 / cn WHEN covered THEN (1 - CASE WHEN u > 0 THEN 0.25 ELSE 0 END) * weight / t
  ELSE (CASE WHEN t > 0 THEN 0.25 ELSE 1 END) / u END, 9) AS share FROM q""")
def county_fixed_alpha(s, d):
    n = X.read(s, d, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("county"), F.greatest("s_acctbal", F.lit(0.0)).alias("weight"), (F.col("s_suppkey") % 3 != 0).alias("covered"))
    total = n.agg(F.count("*").alias("_all"))
    c = n.groupBy("county").agg(F.count("*").alias("_n")).crossJoin(total).select("county", (F.col("_n") / F.col("_all")).alias("fraction"))
    return A.county_first(n, c, 0.25).select("node", "county", F.round("share", 9).alias("share"))


CELL_POOLS = """n AS (SELECT s_suppkey AS node, s_nationkey AS county, s_suppkey % 3 <> 0 AS covered, 1.0::DOUBLE / count(*) OVER () AS share FROM supplier), w AS (SELECT l_suppkey AS node, month(l_shipdate)::INT AS cell, sum(l_quantity) * (l_suppkey % 5 > 0)::INT AS weight FROM lineitem WHERE l_orderkey % 3 = 0 GROUP BY l_suppkey, 2),
  c AS (SELECT unnest(range(1, 13))::INT AS cell), b AS (SELECT node, county, cell, share FROM n, c WHERE NOT covered), p AS (SELECT county, sum(CASE WHEN covered THEN share ELSE 0 END) AS pool, sum((NOT covered)::INT) AS bare FROM n GROUP BY county),
  o AS (SELECT n.node, county, c.cell, coalesce(weight, 0) AS weight FROM n CROSS JOIN c LEFT JOIN w ON w.node = n.node AND w.cell = c.cell WHERE covered), t AS (SELECT county, cell, sum(weight) AS w FROM o GROUP BY ALL),
  u AS (SELECT node, cell, share FROM b UNION ALL SELECT node, cell, pool * weight / w FROM o JOIN t USING (county, cell) JOIN p USING (county) WHERE w > 0 UNION ALL SELECT node, cell, pool / bare FROM b JOIN t USING (county, cell) JOIN p USING (county) WHERE w <= 0),
  v AS (SELECT node, cell, sum(share) AS share FROM u GROUP BY ALL HAVING sum(share) > 0), x AS (SELECT node, cell, share / sum(share) OVER (PARTITION BY cell) AS share FROM v)"""


def _by_cell(s, d):
    n = X.read(s, d, "supplier")
    total = n.agg(F.count("*").alias("_all"))
    pools = n.crossJoin(total).select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("county"), (F.col("s_suppkey") % 3 != 0).alias("covered"), (1 / F.col("_all")).alias("share"))
    w = X.read(s, d, "lineitem").where("l_orderkey % 3 = 0").groupBy(F.col("l_suppkey").alias("node"), F.month("l_shipdate").alias("cell")).agg(F.sum("l_quantity").alias("q"))
    w = w.select("node", "cell", (F.col("q") * (F.col("node") % 5 > 0).cast("int")).alias("weight"))
    return A.shares_by_cell(pools, w, s.range(1, 13).select(F.col("id").cast("int").alias("cell")))


@query("shares_by_cell", f"WITH {CELL_POOLS} SELECT node, cell, round(share, 9) AS share FROM x")
def shares_by_cell(s, d):
    return _by_cell(s, d).withColumn("share", F.round("share", 9))


HOURS = "h AS (SELECT t, region AS zone, mw, (hour(t) % 12 + 1)::INT AS cell FROM series)"
for hold in (False, True):

    @query(f"rescale_cells_{'hold' if hold else 'full'}", X.sql(f""", {CELL_POOLS.replace("w AS (", "w AS (")}, {HOURS}, z AS (SELECT cell, (node % 3)::INT AS zone, sum(share) AS share FROM x GROUP BY ALL),
      tot AS (SELECT t, cell, sum(mw) AS total FROM h {'WHERE zone < 3' if hold else ''} GROUP BY ALL)
      SELECT t, zone, round(total * share, 5) AS mw FROM tot JOIN z USING (cell) UNION ALL SELECT t, zone, {'round(mw, 5)' if hold else '0.0'} FROM h WHERE zone >= 3"""))
    def rescaled_by_cell(s, d, hold=hold):
        shares = _by_cell(s, d).groupBy("cell", (F.col("node") % 3).cast("int").alias("zone")).agg(F.sum("share").alias("share"))
        demand = X.series(s, d).withColumnRenamed("region", "zone")
        cells = demand.select("t", (F.hour("t") % 12 + 1).alias("cell")).distinct()
        return A.rescale(demand, shares, hold, cells).withColumn("mw", F.round("mw", 5))
