"""Candidate nodes of a network, what is mapped to them, and its summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unquoted(df: DataFrame) -> DataFrame:
    """Text columns without the blanks and quotes that stand around their values."""
    return df.withColumns({c: F.trim(F.regexp_replace(F.trim(c), r"^'+|'+$", "")) for c, kind in df.dtypes if kind == "string"})


def candidates(nodes: DataFrame, filters: Sequence[tuple[str, str]] = (), defaults: bool = True) -> DataFrame:
    """Nodes that load may be mapped to: substations that are no imports, unless a filter (column, value) says otherwise, and what the
    filters leave."""
    out = unquoted(nodes)
    if defaults:
        if "Type" in out.columns and "Type" not in {c for c, _ in filters}:
            out = out.where("Type = 'Substation'")
        if "Import" in out.columns:
            out = out.where("Import IS NULL OR Import <> 'IMPORT'")
    for column, value in filters:
        out = out.where(F.col(column).cast("string") == value)
    return out


def demand_totals(wide: DataFrame, prefix: str) -> DataFrame:
    """``node`` and the sum of the absolute values of its column in a wide table of demand: one pass, one row, then long."""
    columns = [c for c in wide.columns if c.startswith(prefix)]
    sums = wide.agg(*[F.sum(F.abs(c)).alias(c) for c in columns])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c[len(prefix) :]).alias("node"), F.col(c).cast("double").alias("total")) for c in columns])).alias("x")).select("x.*")


def with_demand(nodes: DataFrame, totals: DataFrame, key: str) -> DataFrame:
    """Nodes that carry load at some hour."""
    loaded = totals.where("total > 0").select(F.col("node").alias("_node"))
    return nodes.join(loaded, F.col(key).cast("string") == F.col("_node"), "left_semi")


def value_columns(df: DataFrame, keys: Sequence[str]) -> list[str]:
    """Numeric columns that are neither keys nor parts of a date."""
    kinds = ("double", "float", "int", "bigint", "smallint", "tinyint")
    return [c for c, kind in df.dtypes if (kind in kinds or kind.startswith("decimal")) and c not in keys and c.lower() not in ("year", "month", "day", "hour", "hour_pst")]


def apply_wide(wide: DataFrame, mapping: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Columns of units (k) as rows of nodes (other): the product of the table and the mapping's matrix of shares, long."""
    columns = [c for c in wide.columns if c not in keys]
    long = wide.unpivot(list(keys), columns, "k", "v").where("v IS NOT NULL")
    shares = mapping.where("other IS NOT NULL").select(F.col("k").cast("string").alias("k"), "other", "share")
    return long.join(shares, "k").groupBy(*keys, "other").agg(F.sum(F.col("v") * F.col("share")).alias("v"))


def split_in_county(units: DataFrame, nodes: DataFrame, km: Column) -> DataFrame:
    """Units without a place of their own (k, county, lat, lon of the county's middle) on the nodes (other, county, lat, lon): evenly over
    those of the county, or on the one nearest to its middle.

    Only counties without a node meet all nodes; ``km`` is the distance between lat, lon and node_lat, node_lon."""
    n = nodes.groupBy("county").agg(F.count("*").alias("_n"))
    inside = units.join(n, "county").join(nodes.select("county", "other"), "county").select("k", "other", (1.0 / F.col("_n")).alias("share"), F.lit("county").alias("method"))
    bare = units.join(n, "county", "left_anti")
    far = bare.crossJoin(nodes.select("other", F.col("lat").alias("node_lat"), F.col("lon").alias("node_lon"))).withColumn("_km", km)
    nearest = far.groupBy("k").agg(F.min(F.struct("_km", "other")).alias("_b")).select("k", F.col("_b.other").alias("other"), F.lit(1.0).alias("share"), F.lit("middle").alias("method"))
    return inside.unionByName(nearest)


def topped_up(nodes: DataFrame, units: DataFrame, energies: DataFrame, ratio: float, weight: str | None = None) -> DataFrame:
    """What counties lack, on their uncovered nodes, by year.

    ``nodes``: node, county, covered and a weight; ``units``: a row a unit, with county; ``energies``: county, year, wanted, given.
    Counties take part that have units, but fewer than ``ratio`` for each node.  The shortfall is split evenly, or by ``weight``
    (evenly where no uncovered node has any)."""
    places = nodes.groupBy("county").agg(F.count("*").alias("_nodes"), F.sum((~F.col("covered")).cast("int")).alias("_bare"), F.sum(F.when(~F.col("covered"), F.col(weight) if weight else F.lit(0.0)).otherwise(0.0)).alias("_w"))
    sites = units.groupBy("county").agg(F.count("*").alias("_units"))
    taking = places.join(sites, "county").where((F.col("_units") / F.col("_nodes") < ratio) & (F.col("_bare") > 0))
    short = energies.join(taking, "county").withColumn("_short", F.col("wanted") - F.col("given")).where("_short > 0")
    bare = nodes.where(~F.col("covered"))
    part = F.when(F.col("_w") > 0, F.col(weight) / F.when(F.col("_w") > 0, F.col("_w"))).otherwise(1 / F.col("_bare")) if weight else 1 / F.col("_bare")
    return bare.join(short, "county").select("node", "county", "year", (F.col("_short") * part).alias("topup"))


def identity_pairs(units: DataFrame, nodes: DataFrame, records: DataFrame, dictionary: DataFrame, km: Column, near_km: float, sane_km: float) -> DataFrame:
    """Unit and node that share a record of an inventory: ``unit``, ``node``, ``km``.

    ``units``: unit, owner, name, lat, lon; ``nodes``: node, owner, name (of the nearest record), record_km, node_lat, node_lon;
    ``records``: owner, name; ``dictionary``: owner, name, record.  A unit's record is the dictionary's, else that of its own name where
    its owner has it; a node's counts within ``near_km``.  Pairs farther apart than ``sane_km`` only share a name; of several units that
    claim a node the nearest has it (then the first by name)."""
    own = records.select("owner", "name").distinct().withColumn("_own", F.col("name"))
    said = dictionary.groupBy("owner", "name").agg(F.min("record").alias("_said"))
    named = units.join(said, ["owner", "name"], "left").join(own, ["owner", "name"], "left").withColumn("_record", F.coalesce("_said", "_own")).where("_record IS NOT NULL")
    at = nodes.where(F.col("record_km") <= near_km).select("node", F.col("owner").alias("_o"), F.col("name").alias("_n"), "node_lat", "node_lon")
    met = named.join(at, (F.col("owner") == F.col("_o")) & (F.col("_record") == F.col("_n"))).withColumn("km", km).where(F.col("km") <= sane_km)
    return met.groupBy("node").agg(F.min(F.struct("km", "unit")).alias("_b")).select(F.col("_b.unit").alias("unit"), "node", F.col("_b.km").alias("km"))


def pairs_then_nearest(pairs: DataFrame, nearest: DataFrame) -> DataFrame:
    """Units that have pairs are shared evenly over them; the others keep their rows of ``nearest`` (unit, node, share, km)."""
    n = F.count("*").over(Window.partitionBy("unit"))
    own = pairs.select("unit", "node", (1.0 / n).alias("share"), "km", F.lit("name").alias("method"))
    rest = nearest.join(pairs.select("unit").distinct(), "unit", "left_anti").select("unit", "node", "share", "km", F.lit("nearest").alias("method"))
    return own.unionByName(rest)


def map_summary(mapping: DataFrame) -> DataFrame:
    """One row on a map (unit, node, km): units, nodes, rows, distances and the largest catchment."""
    sizes = mapping.groupBy("unit").agg(F.count("node").alias("_n"))
    largest = sizes.agg(F.max("_n").alias("largest"), F.count("*").alias("units"))
    over = lambda km: (100 * F.avg((F.col("km") > km).cast("double")))
    rows = mapping.agg(
        F.countDistinct("node").alias("nodes"), F.count("*").alias("rows"), F.percentile("km", 0.5).alias("median_km"), F.percentile("km", 0.95).alias("p95_km"),
        F.max("km").alias("max_km"), over(1.0).alias("over_1_km"), over(10.0).alias("over_10_km"),
    )
    return rows.crossJoin(largest)  # single rows


def high_side(units: DataFrame, inventory: DataFrame, token: Column) -> DataFrame:
    """``kv`` and ``kv_source`` of units (unit, owner, name): the voltage of their own (``token``), else the greatest of the inventory
    (owner, name, kv); the rows stay as many."""
    known = inventory.groupBy("owner", "name").agg(F.max("kv").alias("_kv"))
    out = units.join(known, ["owner", "name"], "left").withColumn("_token", token)
    source = F.when(F.col("_token").isNotNull(), "own").when(F.col("_kv").isNotNull(), "inventory").otherwise("none")
    return out.withColumn("kv", F.coalesce("_token", "_kv")).withColumn("kv_source", source).drop("_kv", "_token")


def voltage_agreement(mapping: DataFrame, units: DataFrame, nodes: DataFrame, classed) -> DataFrame:
    """How many mapped rows have the same voltage on both sides, exactly and by class, and how many can be compared."""
    met = mapping.join(units.select("unit", F.col("kv").alias("_u")), "unit", "left").join(nodes.select("node", F.col("kv").alias("_n")), "node", "left")
    both = F.col("_u").isNotNull() & F.col("_n").isNotNull()
    one = lambda c: F.sum((both & c).cast("long"))
    return met.groupBy("method").agg(F.count("*").alias("rows"), F.sum(both.cast("long")).alias("compared"), one(F.col("_u") == F.col("_n")).alias("equal"), one(classed(F.col("_u")) == classed(F.col("_n"))).alias("same_class"))
