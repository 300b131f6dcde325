"""Queries of node tables, target cells, composite shapes and calibrated cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import allocation as A
from ..operators import proportional as P
from ..operators import stochastic as E
from ..operators import weights as W
from . import fixtures as X
from .registry import query


def _raw(s, d):
    p = X.read(s, d, "part")
    return p.select(F.format_string(" n%d ", "p_partkey").alias("node_id"), F.concat("p_brand", F.lit(" ")).alias("base_id"), F.format_string(" %d.5", F.col("p_size") - 12).alias("winter_load"), (F.col("p_size") - 9).cast("string").alias("summer_load"), F.col("p_partkey").cast("string").alias("lat"))


WINTER = "CASE WHEN p_size < 12 THEN (p_size - 12) - 0.5 ELSE (p_size - 12) + 0.5 END::DOUBLE"
TABLE = f"nt AS (SELECT 'n' || p_partkey AS node_id, p_brand AS base_id, '' AS subname, {WINTER.replace('(p_size - 12) - 0.5', '(p_size - 12) - 0.5')} AS winter_load, (p_size - 9)::DOUBLE AS summer_load FROM part)"


@query("node_table", f"WITH {TABLE} SELECT * FROM nt")
def node_table(s, d):
    return P.node_table(_raw(s, d)).select("node_id", "base_id", "subname", "winter_load", "summer_load")


BLOCKS = f"{TABLE}, b AS (SELECT node_id AS node, base_id AS base, 0 AS block, winter_load AS level FROM nt UNION ALL SELECT node_id, base_id, 1, summer_load FROM nt)"


def _levels(s, d):
    nodes = P.node_table(_raw(s, d)).select(F.col("node_id").alias("node"), F.col("base_id").alias("base"), "winter_load", "summer_load")
    return P.by_block(nodes, F.col("winter_load"), F.col("summer_load")).select("node", "base", "block", "level")


@query("cancellation", f"WITH {BLOCKS} SELECT base, block, round(coalesce(abs(sum(level)) / nullif(sum(abs(level)), 0), 0), 9) AS kappa FROM b GROUP BY ALL")
def cancellation(s, d):
    return P.net_to_gross(_levels(s, d), ["base", "block"], "level").withColumn("kappa", F.round("kappa", 9))


NET = "l AS (SELECT *, CASE WHEN sum(greatest(level, 0)) OVER w > 0 THEN greatest(level, 0) * greatest(sum(level) OVER w, 0) / sum(greatest(level, 0)) OVER w ELSE 0 END AS l FROM b WINDOW w AS (PARTITION BY block, base)), sh AS (SELECT node, base, block, l / sum(l) OVER (PARTITION BY block) AS share FROM l)"


@query("block_shares", f"WITH {BLOCKS}, {NET} SELECT node, block, round(share, 9) AS share FROM sh")
def block_shares(s, d):
    return A.level_shares(_levels(s, d), "net-base", 0.2).select("node", "block", F.round("share", 9).alias("share"))


CELLS = "tc AS (SELECT hour(o_orderdate + to_hours(o_orderkey % 24))::INT + 24 * (month(o_orderdate) BETWEEN 5 AND 10)::INT AS cell, (month(o_orderdate) BETWEEN 5 AND 10)::INT AS block, sum(o_totalprice) AS energy, count(*)::BIGINT AS hours, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY ALL)"


def _target(s, d):
    o = X.read(s, d, "orders").select((F.col("o_orderkey") % 24).cast("int").alias("hour"), F.month("o_orderdate").between(5, 10).cast("int").alias("block"), F.col("o_totalprice").alias("mw"))
    return P.target_cells(o, F.col("hour") + 24 * F.col("block"), F.col("block"))


@query("target_cells", f"WITH {CELLS} SELECT cell, block, round(energy, 2) AS energy, hours, low, high FROM tc")
def target_cells(s, d):
    return _target(s, d).select("cell", "block", F.round("energy", 2).alias("energy"), "hours", "low", "high")


SURFACE = "sf AS (SELECT unit, cell, block, v - 20 * (unit % 11 = 0)::INT AS value FROM (SELECT l_suppkey AS unit, (l_orderkey % 24)::INT + 24 * (month(l_shipdate) BETWEEN 5 AND 10)::INT AS cell, (month(l_shipdate) BETWEEN 5 AND 10)::INT AS block, avg(l_quantity) AS v FROM lineitem GROUP BY ALL))"
EDGES = "ed AS (SELECT DISTINCT p_brand AS base, p_partkey % (SELECT count(*) FROM supplier) AS unit, 1.0 + p_partkey % 2 AS weight FROM part WHERE p_partkey % 40 = 0)"


def _surface(s, d):
    x = X.read(s, d, "lineitem").withColumn("block", F.month("l_shipdate").between(5, 10).cast("int"))
    x = x.groupBy(F.col("l_suppkey").alias("unit"), ((F.col("l_orderkey") % 24).cast("int") + 24 * F.col("block")).alias("cell"), "block").agg(F.avg("l_quantity").alias("v"))
    return x.select("unit", "cell", "block", (F.col("v") - 20 * (F.col("unit") % 11 == 0).cast("int")).alias("value"))


def _edges(s, d):
    n = X.read(s, d, "supplier").count()
    p = X.read(s, d, "part").where("p_partkey % 40 = 0")
    return p.select(F.col("p_brand").alias("base"), (F.col("p_partkey") % n).alias("unit"), (1.0 + F.col("p_partkey") % 2).alias("weight"), F.lit("ok").alias("status")).distinct()


@query("base_envelopes", f"WITH {SURFACE}, {EDGES} SELECT base, cell, round(sum(weight * value), 6) AS value, count(*)::BIGINT AS units FROM sf JOIN ed USING (unit) GROUP BY ALL")
def base_envelopes(s, d):
    return P.base_envelope(_surface(s, d), _edges(s, d)).withColumn("value", F.round("value", 6))


SHAPES = f"""{BLOCKS}, {NET}, {CELLS}, {SURFACE}, {EDGES}, be AS (SELECT base, cell, sum(weight * value) AS value FROM sf JOIN ed USING (unit) GROUP BY ALL), j AS (SELECT base, cell, block, value, energy FROM be JOIN tc USING (cell)),
  m AS (SELECT base, block, CASE WHEN sum(abs(value * energy)) > 0 AND abs(sum(value * energy)) >= 0.2 * sum(abs(value * energy)) THEN sum(value * energy) / sum(energy) END AS mean FROM j GROUP BY ALL),
  bs AS (SELECT base, cell, block, CASE WHEN mean IS NULL THEN 1 ELSE value / mean END AS shape FROM j JOIN m USING (base, block)),
  ns AS (SELECT node, cell, bs.block, shape FROM nt JOIN bs ON base = base_id JOIN (SELECT DISTINCT node FROM b) x ON x.node = node_id),
  lv AS (SELECT *, base IN (SELECT base FROM be) AND base <> 'Brand#1' AS mapped FROM sh)"""


def _shaped(s, d):
    """Shapes by node and cell, and levels with whether they are mapped."""
    cells = _target(s, d)
    base = P.base_envelope(_surface(s, d), _edges(s, d)).withColumnRenamed("base", "unit")
    shapes = A.energy_normalised(base, cells.select("cell", "block", "energy"), 0.2).select(F.col("unit").alias("base"), "cell", "block", "shape")
    levels = A.level_shares(_levels(s, d), "net-base", 0.2)
    known = base.select(F.col("unit").alias("base")).distinct().where("base <> 'Brand#1'").withColumn("mapped", F.lit(True))
    levels = levels.join(known, "base", "left").withColumn("mapped", F.coalesce("mapped", F.lit(False)))
    return P.for_siblings(shapes, levels.select("node", "base").distinct()).select("node", "cell", "block", "shape"), levels, cells


@query("sibling_shapes", f"WITH {SHAPES} SELECT node, cell, round(shape, 7) AS shape FROM ns")
def sibling_shapes(s, d):
    return _shaped(s, d)[0].select("node", "cell", F.round("shape", 7).alias("shape"))


@query("slack_and_energy", f"""WITH {SHAPES}, own AS (SELECT node, cell, lv.block, share * shape AS s FROM lv JOIN ns USING (node, block) WHERE mapped), le AS (SELECT cell, block, sum(s) AS m FROM own GROUP BY ALL),
  u AS (SELECT block, sum(share) AS u FROM lv WHERE NOT mapped GROUP BY block), al AS (SELECT node, cell, s FROM own UNION ALL SELECT node, le.cell, share * (1 - m) / u FROM lv JOIN le USING (block) JOIN u USING (block) WHERE NOT mapped)
  SELECT node, block, round(sum(s * energy / e), 7) AS share FROM al JOIN tc USING (cell) JOIN (SELECT block, sum(energy) AS e FROM tc GROUP BY block) USING (block) GROUP BY ALL""")
def slack_and_energy(s, d):
    """With slack every node has exactly its level's share of a block's energy."""
    shapes, levels, cells = _shaped(s, d)
    return P.realised_shares(A.slack_shares(shapes, levels), cells).withColumn("share", F.round("share", 7))


@query("renormalised_shares", f"""WITH {SHAPES}, al AS (SELECT node, cell, lv.block, share * shape AS s FROM lv JOIN ns USING (node, block) WHERE mapped UNION ALL SELECT node, cell, lv.block, share FROM lv JOIN (SELECT DISTINCT cell, block FROM ns) USING (block) WHERE NOT mapped)
  SELECT node, cell, round(s / sum(s) OVER (PARTITION BY cell), 8) AS s FROM al""")
def renormalised_shares(s, d):
    shapes, levels, _ = _shaped(s, d)
    return A.renormalised_shares(shapes, levels, 0.05).withColumn("s", F.round("s", 8))


@query("safe_names", f"""SELECT p_partkey AS node, 'z' || CASE WHEN row_number() OVER (ORDER BY p_partkey) > 9999 THEN (row_number() OVER (ORDER BY p_partkey))::VARCHAR ELSE lpad((row_number() OVER (ORDER BY p_partkey))::VARCHAR, 4, '0') END AS "column" FROM part""")
def safe_names(s, d):
    return P.safe_names(X.read(s, d, "part").select(F.col("p_partkey").alias("node")), "node").select("node", "column")


MONTHHOURS = f"""se AS (SELECT month(o_orderdate)::INT * 100 + (o_orderkey % 24)::INT AS cell, o_orderdate AS t, o_totalprice AS mw FROM orders), en AS (SELECT month * 100 + hour AS cell, (min_load + max_load) / 2 AS mu, (max_load - min_load) / (2 * {S.Z90}) AS sigma FROM profiles),
  un AS (SELECT cell, sum(mu) AS sum_mu, sum(sigma) AS sum_sigma FROM en GROUP BY cell)"""


def _monthhours(s, d):
    series = X.read(s, d, "orders").select((F.month("o_orderdate") * 100 + F.col("o_orderkey") % 24).cast("int").alias("cell"), F.col("o_orderdate").alias("t"), F.col("o_totalprice").alias("mw"))
    env = E.fit_envelope(X.profiles(s, d)).withColumn("cell", F.col("month") * 100 + F.col("hour"))
    return series, env


ROUNDED = {"sum_mu": 4, "sum_sigma": 4, "ybar": 7, "sd": 3, "n_obs": 5, "implied_f": 9, "f_star": 9, "shape_s": 8, "rho": 8}
PICKED = "cell, " + ", ".join(f"round({c}, {n}) AS {c}" for c, n in ROUNDED.items())
CALIBRATED = "c AS (SELECT *, sum(sum_mu * n_obs) OVER () / sum(ybar * n_obs) OVER () AS f_star, sum_mu / ybar AS implied_f FROM un JOIN mo USING (cell)), f AS (SELECT *, implied_f / f_star AS shape_s, least(1, pow(implied_f * sd / nullif(sum_sigma, 0), 2)) AS rho FROM c)"


@query("calibrated_cells", X.sql(f", {MONTHHOURS}, mo AS (SELECT cell, avg(mw) AS ybar, stddev_samp(mw) AS sd, count(*)::DOUBLE AS n_obs FROM se GROUP BY cell), {CALIBRATED} SELECT {PICKED} FROM f"))
def calibrated_cells(s, d):
    return P.system_cells(*_monthhours(s, d)).select("cell", *[F.round(c, n).alias(c) for c, n in ROUNDED.items()])


@query("calibrated_cells_decay", X.sql(f""", {MONTHHOURS}, ag AS (SELECT *, pow(0.5, ((SELECT max(t) FROM se)::DATE - t::DATE) / 365.0::DOUBLE) AS w FROM se),
  su AS (SELECT cell, sum(w) AS s, sum(w * mw) AS y, sum(w * mw * mw) AS yy, sum(w * w) AS ww FROM ag GROUP BY cell), mo AS (SELECT cell, y / s AS ybar, CASE WHEN s * s / ww > 1.000001 THEN sqrt(greatest(0, yy / s - (y / s) * (y / s)) * (s * s / ww) / (s * s / ww - 1)) END AS sd, s * s / ww AS n_obs FROM su),
  {CALIBRATED} SELECT {PICKED} FROM f"""))
def calibrated_cells_decay(s, d):
    series, env = _monthhours(s, d)
    last = series.agg(F.max("t").alias("_last"))
    series = series.crossJoin(F.broadcast(last))
    return P.system_cells(series, env, F.pow(F.lit(0.5), F.datediff("_last", "t") / 365.0)).select("cell", *[F.round(c, n).alias(c) for c, n in ROUNDED.items()])


@query("grid_of_years", """WITH p AS (SELECT year(o_orderdate)::INT AS year, dayofyear(o_orderdate)::INT AS hour_of_year, sum(o_totalprice) AS mw FROM orders GROUP BY ALL), t AS (SELECT year, sum(mw) AS e FROM p WHERE year IN (1996, 1997) GROUP BY year), e(y, energy) AS (VALUES (2030, 1e6), (2035, 2e6))
  SELECT y::INT AS model_year, year AS weather_year, hour_of_year, round(mw * energy / e, 4) AS mw FROM p JOIN t USING (year), e""")
def grid_of_years(s, d):
    profile = X.read(s, d, "orders").groupBy(F.year("o_orderdate").alias("year"), F.dayofyear("o_orderdate").alias("hour_of_year")).agg(F.sum("o_totalprice").alias("mw"))
    energies = s.createDataFrame([(2030, 1e6), (2035, 2e6), (2040, 3e6)], "year int, energy double")
    return P.grid_of_years((2030, 2035), (1996, 1997), energies, profile).withColumn("mw", F.round("mw", 4))


@query("level_matrix", X.sql(", loads AS (SELECT unit, month, hour, (min_load + max_load) / 2 AS v FROM profiles), a AS (SELECT unit, hour, avg(v) AS v FROM loads GROUP BY ALL), b AS (SELECT unit, month, avg(v) AS v FROM loads GROUP BY ALL), m AS (SELECT unnest(range(1, 13))::INT AS month), h AS (SELECT unnest(range(24))::INT AS hour) SELECT unit, month, hour, 'hourly' AS level, round(v, 5) AS v FROM a, m UNION ALL SELECT unit, month, hour, 'monthly', round(v, 5) FROM b, h"))
def level_matrix(s, d):
    loads = W.average_load(X.profiles(s, d))
    made = [W.broadcast_to_cells(W.aggregate_to_level(loads, level), level, "avg_load").withColumn("level", F.lit(level)) for level in ("hourly", "monthly")]
    return made[0].unionByName(made[1]).select("unit", "month", "hour", "level", F.round("avg_load", 5).alias("v"))


@query("monthly_energy", X.sql(", loads AS (SELECT unit, month, hour, (min_load + max_load) / 2 AS avg_load FROM profiles), w AS (SELECT region, unit, month, hour, CASE WHEN sum(greatest(avg_load, 0)) OVER p > 0 THEN greatest(avg_load, 0) / sum(greatest(avg_load, 0)) OVER p ELSE 1.0 / count(*) OVER p END AS weight FROM loads JOIN units USING (unit) WINDOW p AS (PARTITION BY region, month, hour)) SELECT s.region, unit, year(t)::INT AS year, month(t)::INT AS month, round(sum(mw * weight), 3) AS energy FROM series s JOIN w ON w.region = s.region AND w.month = month(t) AND w.hour = hour(t) GROUP BY ALL"))
def monthly_energy(s, d):
    weights = W.single_stage(W.average_load(X.profiles(s, d)), X.units(s, d))
    return W.disaggregate_by(X.series(s, d), weights, year=F.year("t"), month=F.month("t")).select("region", "unit", "year", "month", F.round("energy", 3).alias("energy"))
