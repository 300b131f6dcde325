"""Allocation to nodes: levels, slack, counties first, conserving rescaling and rounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def refuse(bad: Column, message: str) -> Column:
    """True where nothing is wrong; raises an error where something is."""
    return F.when(bad, F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True))


def level_shares(nodes: DataFrame, negative: str = "net-base", least_net: float = 0.0, negative_base: str = "zero") -> DataFrame:
    """Shares of signed levels within a block (columns block, base, node, level).

    net-base: a base's negative levels are set off against its positive ones, and a base that nets below zero has nothing
    (``negative_base`` "refuse": raises an error); zero: negative levels count as nothing; participate: they keep their sign;
    refuse: they raise an error.  So do null levels, a block that nets to nothing, and one whose net is less than
    ``least_net`` of its gross.  Sums are taken by base and block and joined, so that no block has to fit in a task."""
    level = F.col("level")
    out = nodes.where(refuse(level.isNull() | F.isnan(level), "a level is missing"))
    if negative == "refuse":
        out = out.where(refuse(level < 0, "negative level")).withColumn("_l", level)
    elif negative == "zero":
        out = out.withColumn("_l", F.greatest(level, F.lit(0.0)))
    elif negative == "participate":
        out = out.withColumn("_l", level)
    elif negative == "net-base":
        bases = out.groupBy("block", "base").agg(F.sum("level").alias("_net"), F.sum(F.greatest(level, F.lit(0.0))).alias("_plus"))
        if negative_base == "refuse":
            bases = bases.where(refuse(F.col("_net") < 0, "a base nets below zero"))
        kept = F.greatest(level, F.lit(0.0)) * F.greatest("_net", F.lit(0.0)) / F.when(F.col("_plus") > 0, F.col("_plus"))
        out = out.join(bases, ["block", "base"]).withColumn("_l", F.coalesce(kept, F.lit(0.0))).drop("_net", "_plus")
    else:
        raise ValueError(f"unknown way with negative levels: {negative}")
    totals = out.groupBy("block").agg(F.sum("_l").alias("_t"), F.sum(F.abs("_l")).alias("_g"))
    totals = totals.where(refuse(~(F.col("_t") > 0), "the levels of a block net to nothing")).where(refuse(F.col("_t") < least_net * F.col("_g"), "the levels of a block cancel"))
    return out.join(totals, "block").withColumn("share", F.col("_l") / F.col("_t")).drop("_l", "_t", "_g")


def energy_normalised(surface: DataFrame, energy: DataFrame, least_net: float = 0.2) -> DataFrame:
    """Shapes (unit, cell, block, value) whose mean weighted by the target's energy of each cell is 1 in each block.

    A unit whose weighted values cancel in a block, to less than ``least_net`` of their gross, has a flat shape there."""
    joined = surface.join(energy, "cell")
    weighted = F.col("value") * F.col("energy")
    sums = joined.groupBy("unit", "block").agg(F.sum(weighted).alias("_net"), F.sum(F.abs(weighted)).alias("_gross"), F.sum("energy").alias("_e"))
    mean = F.col("_net") / F.nullif(F.col("_e"), F.lit(0.0))
    good = (F.col("_gross") > 0) & (F.abs("_net") >= least_net * F.col("_gross")) & (mean != 0)
    means = sums.select("unit", "block", F.when(good, mean).alias("_mean"))
    return joined.join(means, ["unit", "block"]).withColumn("shape", F.when(F.col("_mean").isNotNull(), F.col("value") / F.col("_mean")).otherwise(1.0)).drop("_mean")


def slack_shares(shapes: DataFrame, levels: DataFrame, most: float | None = None, least: float | None = None) -> DataFrame:
    """share * shape for mapped nodes; what is left of each cell is dealt to the others by level.

    ``levels``: node, block, share, mapped; ``shapes``: node, cell, block, shape.  Raises an error where nobody is left to take
    the rest, or would take more than ``most`` times its level, or less than ``least`` times."""
    cells = shapes.select("cell", "block").distinct()
    own = levels.where("mapped").join(shapes, ["node", "block"]).withColumn("s", F.col("share") * F.col("shape"))
    left = own.groupBy("cell", "block").agg(F.sum("s").alias("_m"))
    others = levels.where(~F.col("mapped"))
    taken = others.groupBy("block").agg(F.sum("share").alias("_u"))
    rest = cells.join(left, ["cell", "block"], "left").join(taken, "block", "left").where(refuse(F.coalesce("_u", F.lit(0.0)) == 0, "no unmapped node takes the rest"))
    rest = rest.withColumn("_times", (1 - F.coalesce("_m", F.lit(0.0))) / F.col("_u"))
    if most is not None:
        rest = rest.where(refuse(F.abs("_times") > most, "unmapped nodes are amplified too much"))
    if least is not None:
        rest = rest.where(refuse(F.col("_times") < least, "unmapped nodes change their sign"))
    slack = others.join(rest.select("cell", "block", "_times"), "block").withColumn("s", F.col("share") * F.col("_times"))
    own = own.join(rest.select("cell", "block"), ["cell", "block"], "left_semi")  # so that it is refused where no node is unmapped, too
    return own.select("node", "cell", "s").unionByName(slack.select("node", "cell", "s"))


def renormalised_shares(shapes: DataFrame, levels: DataFrame, least: float = 0.05) -> DataFrame:
    """share * shape by its sum over all nodes of the cell, unmapped nodes having a flat shape; conserves each cell, but not each
    node's energy.  Raises an error where a sum comes nearer to 0 than ``least``."""
    cells = shapes.select("cell", "block").distinct()
    flat = levels.where(~F.col("mapped")).join(cells, "block").withColumn("shape", F.lit(1.0))
    own = levels.where("mapped").join(shapes, ["node", "block"])
    columns = ["node", "cell", "block", (F.col("share") * F.col("shape")).alias("s")]
    every = own.select(*columns).unionByName(flat.select(*columns))
    sums = every.groupBy("cell", "block").agg(F.sum("s").alias("_d")).where(refuse(F.abs("_d") < least, "the shares of a cell cancel"))
    return every.join(sums, ["cell", "block"]).select("node", "cell", (F.col("s") / F.col("_d")).alias("s"))


def county_first(nodes: DataFrame, counties: DataFrame, alpha: float | None = None) -> DataFrame:
    """``nodes``: node, county, weight, covered; ``counties``: county, fraction.  Of a county with n nodes, u of them uncovered, u / n of its
    fraction, or ``alpha`` where some are uncovered, is spread evenly over those and the rest goes to the covered by weight;
    all of it evenly where no covered node has weight."""
    by = Window.partitionBy("county")
    n, u = F.count("*").over(by), F.sum((~F.col("covered")).cast("int")).over(by)
    total = F.sum(F.when(F.col("covered"), F.col("weight")).otherwise(0.0)).over(by)
    joined = nodes.join(counties, "county").withColumn("_a", F.when(total > 0, u / n if alpha is None else F.when(u > 0, F.lit(alpha)).otherwise(0.0)).otherwise(1.0)).withColumn("_t", total).withColumn("_u", u).withColumn("_c", n)
    even = F.when(F.col("_u") > 0, F.col("_a") / F.when(F.col("_u") > 0, F.col("_u")))
    inside = F.when(F.col("_t") <= 0, 1 / F.col("_c")).when(F.col("covered"), (1 - F.col("_a")) * F.col("weight") / F.when(F.col("_t") > 0, F.col("_t"))).otherwise(even)
    return joined.select("node", "county", (F.col("fraction") * inside).alias("share"))


def shares_by_cell(pools: DataFrame, weights: DataFrame, cells: DataFrame) -> DataFrame:
    """Static pools split anew in each cell: ``pools`` (node, county, share, covered) are a county's shares, ``weights`` (node, cell, weight)
    those of its covered nodes by cell, ``cells`` at most a few hundred.

    Uncovered nodes keep their share.  The covered nodes' part of a county is dealt by the cell's weights; where these add up to
    nothing it goes evenly to the county's uncovered nodes.  Shares of a cell then add up to 1."""
    every = F.broadcast(cells.select("cell").distinct())
    bare = pools.where(~F.col("covered")).crossJoin(every)
    pool = pools.groupBy("county").agg(F.sum(F.when(F.col("covered"), F.col("share")).otherwise(0.0)).alias("_pool"), F.sum((~F.col("covered")).cast("int")).alias("_bare"))
    own = pools.where("covered").select("node", "county").crossJoin(every).join(weights, ["node", "cell"], "left").withColumn("weight", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)))
    totals = own.groupBy("county", "cell").agg(F.sum("weight").alias("_w")).join(pool, "county")
    dealt = own.join(totals, ["county", "cell"]).where("_w > 0").select("node", "cell", (F.col("_pool") * F.col("weight") / F.col("_w")).alias("share"))
    handed = bare.join(totals.where("_w <= 0"), ["county", "cell"]).select("node", "cell", (F.col("_pool") / F.col("_bare")).alias("share"))
    out = bare.select("node", "cell", "share").unionByName(dealt).unionByName(handed).groupBy("node", "cell").agg(F.sum("share").alias("share")).where("share > 0")
    sums = out.groupBy("cell").agg(F.sum("share").alias("_s"))
    return out.join(sums, "cell").select("node", "cell", (F.col("share") / F.col("_s")).alias("share"))


def rescale(demand: DataFrame, shares: DataFrame, hold: bool = False, cells: DataFrame | None = None) -> DataFrame:
    """Demand (t, zone, mw) of the zones with a share, added up by hour and dealt anew; with ``hold`` others keep theirs and the
    total is that of the zones with shares, else that of all zones.

    With ``cells`` (t, cell), shares are by cell (zone, cell, share), and an hour whose cell has none raises an error.  Without, every hour
    meets every share: the rows of the result, joined on one constant key."""
    zones = shares.select("zone").distinct()
    touched = demand.join(zones, "zone", "left_semi")
    total = (touched if hold else demand).groupBy("t").agg(F.sum("mw").alias("_total"))
    if cells is None:
        met = total.withColumn("_one", F.lit(1)).join(shares.withColumn("_one", F.lit(1)), "_one")
    else:
        met = total.join(cells, "t").join(shares, "cell", "left").where(refuse(F.col("zone").isNull(), "a cell has no shares"))
    new = met.groupBy("t", "zone").agg(F.sum(F.col("_total") * F.col("share")).alias("mw")) if cells is not None else met.select("t", "zone", (F.col("_total") * F.col("share")).alias("mw"))
    rest = demand.join(zones, "zone", "left_anti").select("t", "zone", F.col("mw") if hold else F.lit(0.0).alias("mw"))
    return new.unionByName(rest)
