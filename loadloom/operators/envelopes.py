"""Sources of sigma, draws of siblings, and checks of what was generated against what was given.

Cells are at most a few hundred, so tables by cell are broadcast."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import hash_uniform, normal_cdf, normal_quantile

#: Tasks for each core among which nodes are dealt.
DEALT = 4


def _over(a, b):
    return F.when(b != 0, a / F.when(b != 0, b))


def with_sigma(rows: DataFrame, kind: str, value: float | DataFrame | None = None, system: DataFrame | None = None, rho: float = 0.231) -> DataFrame:
    """Rows (unit, cell, mu) with sigma by one of four sources.

    ``input-crosssec``: the standard deviation of mu over the units of a cell; ``pinned-rho``: f sd / (n sqrt(rho)) of ``system``
    (cell, f, sd), so that rho comes out; ``scalar``: ``value``; ``proportional-cv``: ``value``, or cv of a table (cell, cv), times
    the size of mu."""
    if kind in ("scalar", "proportional-cv") and value is None:
        raise ValueError(f"{kind} needs a value")
    if kind == "scalar":
        return rows.withColumn("sigma", F.lit(float(value)))
    if kind == "proportional-cv":
        if isinstance(value, DataFrame):
            return rows.join(F.broadcast(value.select("cell", F.col("cv").alias("_cv"))), "cell", "left").withColumn("sigma", F.abs(F.col("_cv") * F.col("mu"))).drop("_cv")
        return rows.withColumn("sigma", F.abs(F.lit(float(value)) * F.col("mu")))
    if kind == "input-crosssec":
        known = F.when(~F.isnan("mu"), F.col("mu"))
        return rows.join(F.broadcast(rows.groupBy("cell").agg(F.stddev_samp(known).alias("sigma"))), "cell", "left")
    if kind != "pinned-rho":
        raise ValueError(f"unknown source of sigma: {kind}")
    if system is None:
        raise ValueError("pinned-rho needs the system's cells")
    return rows.join(F.broadcast(sigma_floor(rows, system).select("cell", (F.col("floor") / rho**0.5).alias("sigma"))), "cell", "left")


def sigma_floor(rows: DataFrame, system: DataFrame) -> DataFrame:
    """By cell f sd / n: with less sigma a unit, rho would be above 1."""
    n = rows.groupBy("cell").agg(F.count("*").alias("n"))
    return n.join(F.broadcast(system.select("cell", "f", "sd")), "cell").select("cell", "n", (F.col("f") * F.col("sd") / F.col("n")).alias("floor"))


def below_zero(rows: DataFrame) -> DataFrame:
    """Rows with the probability of a normal load below 0; without sigma, whether mu is."""
    p = F.when(F.col("sigma") > 0, normal_cdf(-F.col("mu") / F.when(F.col("sigma") > 0, F.col("sigma")))).when(F.col("sigma") == 0, (F.col("mu") < 0).cast("double"))
    return rows.withColumn("p_negative", p)


def sibling_draws(base: DataFrame, siblings: DataFrame, z: DataFrame, cells: DataFrame, seed: int, mode: str = "proportional", keys: Sequence[str] = ()) -> DataFrame:
    """Means (node, cell, mean) of k mu + s (sqrt(rho) z + sqrt(1 - rho) eps), eps by node and day, s = k sigma or sqrt(|k|) sigma.

    ``base``: base, cell, mu, sigma; ``siblings``: node, base, k; ``z``: t, cell, z; ``cells``: cell, rho.  Loads are linear in z
    and eps, so hours are reduced to days of a cell before they meet nodes.  Cells without hours have k mu.
    ``keys``: columns of ``z``, such as its region, for each of whose values all nodes are drawn."""
    if mode not in ("proportional", "quadrature"):
        raise ValueError(f"unknown mode: {mode}")
    days = z.groupBy(*keys, "cell", F.date_format("t", "yyyy-MM-dd").alias("_day")).agg(F.count("*").alias("_n"), F.sum("z").alias("_z"))
    eps = lambda node, day: normal_quantile(hash_uniform(F.lit(str(seed)), F.lit("sibling"), node.cast("string"), day))
    # eps depends on node and day only: each is drawn once, and a node's days are multiplied with the calendar's hours in each cell.
    calendar = days.where("_day IS NOT NULL").select(*keys, "cell", "_day", "_n").collect()  # a calendar's days in each cell
    names = sorted({r["_day"] for r in calendar})
    place_of = {day: i for i, day in enumerate(names)}
    cell_of: dict[tuple, int] = {}
    for r in calendar:
        cell_of.setdefault(tuple(r[:-2]), len(cell_of))
    hours = np.zeros((len(names), len(cell_of)))
    for r in calendar:
        hours[place_of[r["_day"]], cell_of[tuple(r[:-2])]] = r["_n"]

    def mixed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch[at : at + 1000]
                yield pd.DataFrame({"node": part["node"].to_numpy(), "_eps": list(np.stack(part["_e"]) @ hours / hours.sum(0))})

    # Nodes are few bytes but much work, so they are dealt out by number; they stay a row each, with a value for each cell, up to the result.
    drawn = siblings.select("node").distinct().repartition(DEALT * siblings.sparkSession.sparkContext.defaultParallelism, "node")
    drawn = drawn.select("node", F.transform(F.array(*map(F.lit, names)).cast("array<string>"), lambda day: eps(F.col("node"), day)).alias("_e"))
    noise = drawn.mapInPandas(mixed, f"node {dict(siblings.dtypes)['node']}, _eps array<double>")
    places = T.StructType([*(days.schema[c] for c in (*keys, "cell")), T.StructField("_at", T.IntegerType())])
    places = siblings.sparkSession.createDataFrame([(*cell, at) for cell, at in cell_of.items()], places)
    level = days.groupBy(*keys, "cell").agg((F.sum("_z") / F.sum("_n")).alias("_zbar")).join(F.broadcast(places), [*keys, "cell"])
    rows = siblings.join(base, "base").join(F.broadcast(cells.select("cell", "rho")), "cell", "left").join(noise, "node", "left")
    if keys:
        rows = rows.crossJoin(F.broadcast(z.select(*keys).distinct()))  # a few values
    rows = rows.join(F.broadcast(level), [*keys, "cell"], "left").withColumn("_eps", F.get("_eps", "_at"))  # a few cells
    size = F.col("k") if mode == "proportional" else F.sqrt(F.abs("k"))
    w = F.sqrt("rho") * F.col("_zbar") + F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("rho"))) * F.col("_eps")
    return rows.select(*keys, "node", "base", "cell", F.coalesce(F.col("k") * F.col("mu") + size * F.col("sigma") * w, F.col("k") * F.col("mu")).alias("mean"))


def total_checks(simulated: DataFrame, wanted: DataFrame) -> DataFrame:
    """By cell, 10th and 90th percentiles of simulated totals (draw, t, cell, total) and of wanted ones (t, cell, fy), errors in percent."""
    q = lambda c, p: F.percentile(c, p)
    a = wanted.groupBy("cell").agg(q("fy", 0.1).alias("wanted_q10"), q("fy", 0.9).alias("wanted_q90"))
    b = simulated.groupBy("cell").agg(q("total", 0.1).alias("got_q10"), q("total", 0.9).alias("got_q90"))
    out = a.join(b, "cell", "left")
    for p in ("q10", "q90"):
        out = out.withColumn(f"error_{p}", 100 * _over(F.col(f"got_{p}") - F.col(f"wanted_{p}"), F.col(f"wanted_{p}")))
    return out


def tracking(simulated: DataFrame, wanted: DataFrame) -> DataFrame:
    """Relative error of the draws' mean total by hour, in percent: root mean square and bias."""
    mean = simulated.groupBy("t").agg(F.avg("total").alias("_m")).join(wanted.select("t", "fy"), "t")
    e = _over(F.col("_m") - F.col("fy"), F.col("fy"))
    return mean.agg((100 * F.sqrt(F.avg(e * e))).alias("rel_rmse"), (100 * F.avg(e)).alias("bias"), F.count("*").alias("n"))


def recovery(envelope: DataFrame, drawn: DataFrame, scale: float = 1.0) -> DataFrame:
    """By unit and cell, how far the percentiles of drawn loads (unit, cell, load) are from the given ones (min_load, max_load), as parts
    of the envelope's width; missing, and zero-width, envelopes are left out."""
    got = drawn.groupBy("unit", "cell").agg(F.percentile("load", F.array(F.lit(0.1), F.lit(0.9))).alias("_q"))
    low, high = scale * F.least("min_load", "max_load"), scale * F.greatest("min_load", "max_load")
    known = envelope.where("min_load IS NOT NULL AND max_load IS NOT NULL AND min_load <> max_load").select("unit", "cell", low.alias("_l"), high.alias("_h"))
    width = F.col("_h") - F.col("_l")
    return known.join(got, ["unit", "cell"]).select("unit", "cell", (F.abs(F.col("_q")[0] - F.col("_l")) / width).alias("error_q10"), (F.abs(F.col("_q")[1] - F.col("_h")) / width).alias("error_q90"))


def recovery_summary(errors: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Median and 95th percentile of the errors by ``keys``, or over all (there by sketches, as the sub-cells grow with the units)."""
    q = F.percentile if keys else F.percentile_approx
    aggs = [q(f"error_{e}", p).alias(f"{e}_{name}") for e in ("q10", "q90") for name, p in (("median", 0.5), ("p95", 0.95))]
    return errors.groupBy(*(keys or [])).agg(F.count("*").alias("n"), *aggs)


def annualised(annual: DataFrame, hours: DataFrame, complete: int = 8000) -> DataFrame:
    """Mean energy a year (in millions) over draws (draw, year, mwh), by complete years of ``hours`` (t) only; if there is none, by hours."""
    by_year = hours.groupBy(F.year("t").alias("year")).agg(F.count("*").alias("_n"))
    flagged = by_year.withColumn("_full", F.col("_n") >= complete)
    spans = flagged.agg(F.count_if("_full").alias("_years"), F.sum("_n").alias("_hours"))
    rows = annual.join(F.broadcast(flagged.select("year", "_full")), "year", "left").crossJoin(F.broadcast(spans))
    each = rows.where("_years = 0 OR _full").groupBy("draw").agg(F.sum("mwh").alias("_mwh"), F.first("_years").alias("_years"), F.first("_hours").alias("_hours"))
    length = F.when(F.col("_years") > 0, F.col("_years").cast("double")).otherwise(F.col("_hours") / 8760.0)
    return each.agg((F.avg(F.col("_mwh") / length) / 1e6).alias("twh"), F.count("*").alias("draws"))
