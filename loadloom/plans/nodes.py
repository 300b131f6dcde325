"""Queries of candidate nodes and maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import nodes as D
from ..operators import spatial as P
from . import fixtures as X
from .registry import query


def _buses(s, d):
    p = X.read(s, d, "part")
    kind = F.expr("CASE p_size % 4 WHEN 0 THEN \" 'AddedNode' \" ELSE \"'Substation' \" END")
    return X.places(p.withColumn("k", F.col("p_partkey")), "k").select(F.col("k").alias("bus"), kind.alias("Type"), F.expr("CASE WHEN p_size % 7 = 0 THEN \"'IMPORT'\" END").alias("Import"), (F.col("p_size") * 10.0).alias("kV"), F.col("p_brand").alias("brand"))


@query("candidate_nodes", "SELECT p_partkey AS bus, 'Substation' AS kind FROM part WHERE p_size % 4 <> 0 AND p_size % 7 <> 0 AND p_brand <> 'Brand#3' AND p_size * 10 = 110")
def candidate_nodes(s, d):
    return D.candidates(_buses(s, d), [("kV", "110.0")]).where("brand <> 'Brand#3'").select("bus", F.col("Type").alias("kind"))


def _wide(s, d):
    e = X.series(s, d)
    return e.groupBy("t").pivot("region", list(range(5))).agg(F.sum("mw")).select("t", *[F.coalesce(F.col(str(i)), F.lit(0.0)).alias(f"Demand_z{i}") for i in range(5)], F.lit(0.0).alias("Demand_z5"))


@query("demand_totals", X.sql(" SELECT region::VARCHAR AS node, round(sum(abs(mw)), 4) AS total FROM series GROUP BY region UNION ALL SELECT '5', 0"))
def demand_totals(s, d):
    return D.demand_totals(_wide(s, d), "Demand_z").withColumn("total", F.round("total", 4))


@query("loaded_nodes", "SELECT unnest(range(5))::BIGINT AS bus")
def loaded_nodes(s, d):
    return D.with_demand(s.range(8).withColumnRenamed("id", "bus"), D.demand_totals(_wide(s, d), "Demand_z"), "bus")


SHARES = "m(k, other, share) AS (VALUES (0, 'a', 0.5::DOUBLE), (0, 'b', 0.5), (1, 'b', 1.0), (3, 'c', 0.25), (3, 'a', 0.75))"


@query("wide_to_nodes", X.sql(f", {SHARES} SELECT t, other, round(sum(mw * share), 6) AS v FROM series JOIN m ON k = region GROUP BY ALL"))
def wide_to_nodes(s, d):
    mapping = s.createDataFrame([(0, "a", 0.5), (0, "b", 0.5), (1, "b", 1.0), (3, "c", 0.25), (3, "a", 0.75)], "k int, other string, share double")
    wide = X.series(s, d).groupBy("t").pivot("region", list(range(5))).agg(F.sum("mw"))
    return D.apply_wide(wide, mapping, ["t"]).withColumn("v", F.round("v", 6))


@query("value_columns", "SELECT * FROM (VALUES ('l_quantity'), ('l_extendedprice'), ('l_discount'), ('l_tax')) t(name)")
def value_columns(s, d):
    x = X.read(s, d, "lineitem")
    return s.createDataFrame([(c,) for c in D.value_columns(x, ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"])], "name string")


PLACED = "pn AS (SELECT p_partkey AS other, p_size % 30 AS county, 32 + (p_partkey * 37 % 1000) / 100.0::DOUBLE AS lat, -124 + (p_partkey * 91 % 1000) / 100.0::DOUBLE AS lon FROM part WHERE p_size % 30 < 20)"
CENTRES = "cu AS (SELECT n_nationkey AS k, n_nationkey AS county, 33 + n_nationkey / 4.0::DOUBLE AS lat, -123 + n_nationkey / 5.0::DOUBLE AS lon FROM nation)"
KM = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2))))"


@query("split_in_county", f"""WITH {PLACED}, {CENTRES}, i AS (SELECT k, other, 1.0::DOUBLE / count(*) OVER (PARTITION BY k) AS share, 'county' AS method FROM cu JOIN pn USING (county)),
  f AS (SELECT k, other, 1.0::DOUBLE AS share, 'middle' AS method FROM cu, pn WHERE cu.county NOT IN (SELECT county FROM pn) QUALIFY row_number() OVER (PARTITION BY k ORDER BY {KM.format(a='cu.', b='pn.')}, other) = 1)
  SELECT k, other, round(share, 9) AS share, method FROM i UNION ALL SELECT k, other, share, method FROM f""")
def split_in_county(s, d):
    nodes = X.places(X.read(s, d, "part").withColumn("other", F.col("p_partkey")), "other").select("other", (F.col("p_size") % 30).alias("county"), "lat", "lon").where("county < 20")
    n = F.col("n_nationkey")
    units = X.read(s, d, "nation").select(n.alias("k"), n.alias("county"), (33 + n / 4).alias("lat"), (-123 + n / 5).alias("lon"))
    km = S.haversine_km(F.col("lat"), F.col("lon"), F.col("node_lat"), F.col("node_lon"))
    return D.split_in_county(units, nodes, km).withColumn("share", F.round("share", 9))


TOP = """nn AS (SELECT p_partkey AS node, p_partkey % 25 AS county, p_size % 3 = 0 AS covered, greatest(p_size - 20, 0)::DOUBLE AS weight FROM part), ee AS (SELECT *, unnest([2030, 2035]) AS year FROM (SELECT s_nationkey AS county, sum(greatest(s_acctbal, 0)) AS wanted, 0.4 * sum(abs(s_acctbal)) AS given FROM supplier GROUP BY 1)),
  q AS (SELECT county, count(*) AS n, sum((NOT covered)::INT) AS bare, sum(CASE WHEN NOT covered THEN weight ELSE 0 END) AS w FROM nn GROUP BY county), u AS (SELECT s_nationkey AS county, count(*) AS u FROM supplier GROUP BY 1), t AS (SELECT * FROM q JOIN u USING (county) WHERE u / n::DOUBLE < 0.06 AND bare > 0)"""
for weight in (None, "weight"):
    part = "1.0 / bare" if weight is None else "CASE WHEN w > 0 THEN weight / w ELSE 1.0 / bare END"

    @query(f"topped_up_{'evenly' if weight is None else 'by_weight'}", f"WITH {TOP} SELECT node, county::INT AS county, year, round((wanted - given) * {part}, 5) AS topup FROM nn JOIN t USING (county) JOIN ee USING (county) WHERE NOT covered AND wanted > given")
    def topped_up(s, d, weight=weight):
        nodes = X.read(s, d, "part").select(F.col("p_partkey").alias("node"), (F.col("p_partkey") % 25).cast("int").alias("county"), (F.col("p_size") % 3 == 0).alias("covered"), F.greatest(F.col("p_size") - 20, F.lit(0)).cast("double").alias("weight"))
        units = X.read(s, d, "supplier").select(F.col("s_nationkey").alias("county"), "s_acctbal")
        energies = units.groupBy("county").agg(F.sum(F.greatest("s_acctbal", F.lit(0.0))).alias("wanted"), (0.4 * F.sum(F.abs("s_acctbal"))).alias("given")).withColumn("year", F.explode(F.array(F.lit(2030), F.lit(2035))))
        return D.topped_up(nodes, units, energies, 0.06, weight).withColumn("topup", F.round("topup", 5))


PAIRS = f"""un AS (SELECT s_suppkey AS unit, s_nationkey % 3 AS owner, 'n' || s_suppkey % 400 AS name, 32 + (s_suppkey * 37 % 1000) / 100.0::DOUBLE AS lat, -124 + (s_suppkey * 91 % 1000) / 100.0::DOUBLE AS lon FROM supplier),
  no AS (SELECT p_partkey AS node, p_partkey % 3 AS owner, 'n' || p_partkey % 500 AS name, p_size / 100.0::DOUBLE AS record_km, 32 + (p_partkey * 37 % 1000) / 100.0::DOUBLE AS lat, -124 + (p_partkey * 91 % 1000) / 100.0::DOUBLE AS lon FROM part),
  named AS (SELECT *, CASE WHEN unit % 400 % 7 = 0 THEN 'n' || (unit % 400 + 1) WHEN unit % 400 % 5 <> 0 THEN name END AS record FROM un),
  pr AS (SELECT unit, node, km FROM (SELECT unit, node, {KM.format(a='a.', b='b.')} AS km FROM named a JOIN no b ON a.owner = b.owner AND a.record = b.name WHERE record_km <= 0.25) WHERE km <= 400 QUALIFY row_number() OVER (PARTITION BY node ORDER BY km, unit) = 1)"""


def _pairs(s, d):
    k = F.col("s_suppkey")
    units = X.places(X.read(s, d, "supplier").withColumn("unit", k), "unit").select("unit", (F.col("s_nationkey") % 3).alias("owner"), F.concat(F.lit("n"), k % 400).alias("name"), "lat", "lon")
    p = F.col("p_partkey")
    nodes = X.places(X.read(s, d, "part").withColumn("node", p), "node").select("node", (p % 3).cast("int").alias("owner"), F.concat(F.lit("n"), p % 500).alias("name"), (F.col("p_size") / 100).alias("record_km"), F.col("lat").alias("node_lat"), F.col("lon").alias("node_lon"))
    every = s.range(400).crossJoin(s.range(3).select(F.col("id").cast("int").alias("owner")))
    records = every.where("id % 5 <> 0").select("owner", F.concat(F.lit("n"), "id").alias("name"))
    dictionary = every.where("id % 7 = 0").select("owner", F.concat(F.lit("n"), "id").alias("name"), F.concat(F.lit("n"), F.col("id") + 1).alias("record"))
    km = S.haversine_km(F.col("lat"), F.col("lon"), F.col("node_lat"), F.col("node_lon"))
    return D.identity_pairs(units, nodes, records, dictionary, km, 0.25, 400.0), units, nodes


@query("identity_pairs", f"WITH {PAIRS} SELECT unit, node, round(km, 6) AS km FROM pr")
def identity_pairs(s, d):
    return _pairs(s, d)[0].withColumn("km", F.round("km", 6))


NEAR = f"ne AS (SELECT unit, node, 1.0::DOUBLE AS share, {KM.format(a='a.', b='b.')} AS km FROM un a, no b QUALIFY row_number() OVER (PARTITION BY unit ORDER BY km, node) = 1), mp AS (SELECT unit, node, 1.0::DOUBLE / count(*) OVER (PARTITION BY unit) AS share, km, 'name' AS method FROM pr UNION ALL SELECT unit, node, share, km, 'nearest' FROM ne WHERE unit NOT IN (SELECT unit FROM pr))"


def _mapping(s, d):
    pairs, units, nodes = _pairs(s, d)
    left = units.select(F.col("unit").alias("k"), "lat", "lon")
    right = nodes.select(F.col("node").alias("k"), F.col("node_lat").alias("lat"), F.col("node_lon").alias("lon"))
    nearest = P.k_nearest(left, right, 1).select(F.col("k").alias("unit"), F.col("other").alias("node"), F.lit(1.0).alias("share"), "km")
    return D.pairs_then_nearest(pairs, nearest)


@query("pairs_then_nearest", f"WITH {PAIRS}, {NEAR} SELECT unit, node, round(share, 9) AS share, round(km, 6) AS km, method FROM mp")
def pairs_then_nearest(s, d):
    return _mapping(s, d).withColumn("share", F.round("share", 9)).withColumn("km", F.round("km", 6))


@query("map_summary", f"""WITH {PAIRS}, {NEAR} SELECT count(DISTINCT node)::BIGINT AS nodes, count(*)::BIGINT AS "rows", round(quantile_cont(km, 0.5), 6) AS median_km, round(quantile_cont(km, 0.95), 6) AS p95_km, round(max(km), 6) AS max_km, round(100 * avg((km > 1)::INT), 6) AS over_1_km, round(100 * avg((km > 10)::INT), 6) AS over_10_km,
  (SELECT max(n) FROM (SELECT count(*) AS n FROM mp GROUP BY unit))::BIGINT AS largest, count(DISTINCT unit)::BIGINT AS units FROM mp""")
def map_summary(s, d):
    out = D.map_summary(_mapping(s, d))
    return out.withColumns({c: F.round(c, 6) for c in ("median_km", "p95_km", "max_km", "over_1_km", "over_10_km")})


HIGH = "iv AS (SELECT p_partkey % 3 AS owner, 'n' || p_partkey % 500 AS name, max(p_size * 10.0::DOUBLE) AS kv FROM part WHERE p_size % 3 = 0 GROUP BY ALL), hs AS (SELECT unit, CASE WHEN unit % 4 = 0 THEN 66.0::DOUBLE ELSE kv END AS kv, CASE WHEN unit % 4 = 0 THEN 'own' WHEN kv IS NOT NULL THEN 'inventory' ELSE 'none' END AS kv_source FROM un LEFT JOIN iv USING (owner, name))"


def _high(s, d):
    _, units, nodes = _pairs(s, d)
    inventory = X.read(s, d, "part").where("p_size % 3 = 0").select((F.col("p_partkey") % 3).cast("int").alias("owner"), F.concat(F.lit("n"), F.col("p_partkey") % 500).alias("name"), (F.col("p_size") * 10.0).alias("kv"))
    return D.high_side(units, inventory, F.when(F.col("unit") % 4 == 0, 66.0))


@query("high_side_voltages", f"WITH {PAIRS}, {HIGH} SELECT unit, kv, kv_source FROM hs")
def high_side_voltages(s, d):
    return _high(s, d).select("unit", F.col("kv").cast("double").alias("kv"), "kv_source")


CLASS = "CASE WHEN {0} < 87.1 THEN 66 WHEN {0} < 162.6 THEN 115 WHEN {0} < 339.1 THEN 230 WHEN {0} IS NOT NULL THEN 500 END"


@query("voltage_agreement", f"""WITH {PAIRS}, {NEAR}, {HIGH}, jn AS (SELECT method, hs.kv AS u, p_size * 10.0::DOUBLE AS n FROM mp LEFT JOIN hs USING (unit) LEFT JOIN part ON p_partkey = node)
  SELECT method, count(*)::BIGINT AS "rows", sum((u IS NOT NULL AND n IS NOT NULL)::INT)::BIGINT AS compared, sum(coalesce(u = n, false)::INT)::BIGINT AS equal, sum(coalesce({CLASS.format('u')} = {CLASS.format('n')}, false)::INT)::BIGINT AS same_class FROM jn GROUP BY method""")
def voltage_agreement(s, d):
    nodes = X.read(s, d, "part").select(F.col("p_partkey").alias("node"), (F.col("p_size") * 10.0).cast("double").alias("kv"))
    out = D.voltage_agreement(_mapping(s, d), _high(s, d).withColumn("kv", F.col("kv").cast("double")), nodes, S.voltage_class)
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("compared", "equal", "same_class")})
