"""Tests of means, regression summaries, comparisons of results, donors by features and guards against leakage."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import hash_uniform


def _over(a, b):
    return a / F.nullif(b, F.lit(0.0))


def student_p(t: float | None, df: float | None) -> float | None:
    """The two-sided probability of Student's distribution: the regularised incomplete beta function by its continued fraction (Lentz)."""
    if t is None or df is None or df <= 0 or math.isnan(t):
        return None
    if math.isinf(t):
        return 0.0
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x >= 1:
        return 1.0
    flip = x > (a + 1) / (a + b + 2)
    if flip:
        x, a, b = 1 - x, b, a
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + numerator * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + numerator / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return 1 - front * h if flip else front * h


def _with_p(tests: DataFrame) -> DataFrame:
    """Adds ``p`` to a row a test with t and df: as many rows as keys, in Arrow batches."""

    def run(batches):
        for batch in batches:
            batch["p"] = [student_p(None if math.isnan(t) else t, None if math.isnan(d) else d) for t, d in zip(batch["t"].astype(float), batch["df"].astype(float), strict=True)]
            yield batch

    schema = ", ".join(f"`{c}` {kind}" for c, kind in tests.dtypes) + ", p double"
    return tests.mapInPandas(run, schema)


def one_sample_t(df: DataFrame, keys: Sequence[str], value: str, mean: float = 0.0) -> DataFrame:
    """By key: n, the mean, t against a given mean, degrees of freedom and the two-sided p; null where nothing varies."""
    found = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("_sd"))
    t = _over(F.col("mean") - mean, F.col("_sd") / F.sqrt(F.col("n")))
    return _with_p(found.select(*keys, "n", "mean", t.alias("t"), F.when(F.col("n") > 1, (F.col("n") - 1).cast("double")).alias("df")))


def two_sample_t(df: DataFrame, keys: Sequence[str], value: str, first: str, equal: bool = True) -> DataFrame:
    """The same for the difference of two means: with one variance for both (Student), or one each (Welch)."""
    own = F.col(first)
    part = lambda f, c: f(F.when(c, F.col(value)))
    m = df.groupBy(*keys).agg(*[part(f, c).alias(f"_{n}{i}") for i, c in ((1, own), (2, ~own)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    n1, n2, v1, v2 = (F.col(c) for c in ("_n1", "_n2", "_v1", "_v2"))
    if equal:
        df_ = (n1 + n2 - 2).cast("double")
        spread = F.sqrt(_over((n1 - 1) * v1 + (n2 - 1) * v2, df_) * (_over(F.lit(1.0), n1) + _over(F.lit(1.0), n2)))
    else:
        a, b = _over(v1, n1), _over(v2, n2)
        spread = F.sqrt(a + b)
        df_ = _over((a + b) * (a + b), _over(a * a, n1 - 1) + _over(b * b, n2 - 1))
    return _with_p(m.select(*keys, (F.col("_m1") - F.col("_m2")).alias("difference"), _over(F.col("_m1") - F.col("_m2"), spread).alias("t"), df_.alias("df")))


def ols_summary(df: DataFrame, columns: Sequence[str], label: str) -> list[tuple[str, float, float, float, float]]:
    """Term, coefficient, standard error, t and p of least squares with an intercept; one aggregation gives the normal equations, which
    are as large as the number of columns.  Rows with a null are left out."""
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in columns]]
    y, n = F.col(label).cast("double"), len(columns) + 1
    full = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in (*columns, label)))
    sums = full.agg(F.count("*"), F.sum(y * y), *[F.sum(a * y) for a in x], *[F.sum(x[i] * x[j]) for i in range(n) for j in range(i, n)]).first()
    rows, yy, xy = sums[0], sums[1], np.array(sums[2 : 2 + n], float)
    xx, rest = np.zeros((n, n)), iter(sums[2 + n :])
    for i in range(n):
        for j in range(i, n):
            xx[i, j] = xx[j, i] = next(rest)
    beta = np.linalg.solve(xx, xy)
    free = rows - n
    variance = max(0.0, yy - float(beta @ xy)) / free if free > 0 else math.nan
    errors = np.sqrt(np.diag(np.linalg.inv(xx)) * variance)
    return [(term, float(b), float(e), float(b / e) if e else math.nan, student_p(float(b / e), free) if e else math.nan) for term, b, e in zip(["intercept", *columns], beta, errors, strict=True)]


def compared_results(base: DataFrame, run: DataFrame) -> DataFrame:
    """One row on two tables of results (t, zone, v): movement (half the sum of differences by the base's size) and nRMSE in percent, totals
    (for energy not served, EUE), and hours with any (LOLH).  Only hours and zones in both count."""
    both = base.select("t", "zone", F.col("v").alias("_a")).join(run.select("t", "zone", F.col("v").alias("_b")), ["t", "zone"])
    hourly = both.groupBy("t").agg(
        F.sum(F.abs(F.col("_a") - F.col("_b"))).alias("_d"), F.sum(F.abs("_a")).alias("_s"), F.sum((F.col("_a") - F.col("_b")) * (F.col("_a") - F.col("_b"))).alias("_q"),
        F.count("*").alias("_n"), F.sum("_a").alias("_ta"), F.sum("_b").alias("_tb"),
    )
    return hourly.agg(
        (50 * _over(F.sum("_d"), F.sum("_s"))).alias("movement_pct"), (100 * _over(F.sqrt(F.sum("_q") / F.sum("_n")), F.sum("_s") / F.sum("_n"))).alias("nrmse_pct"), F.sum("_ta").alias("total_base"), F.sum("_tb").alias("total_run"),
        F.sum((F.col("_ta") > 1e-6).cast("long")).alias("hours_base"), F.sum((F.col("_tb") > 1e-6).cast("long")).alias("hours_run"),
    )


def compared_costs(base: DataFrame, run: DataFrame) -> DataFrame:
    """Costs (component, cost as text) of both with the change in percent; components that either lacks, or that are no number, are left out."""
    number = lambda df, out: df.select("component", F.col("cost").cast("string").try_cast("double").alias(out)).where(F.col(out).isNotNull())
    return number(base, "base").join(number(run, "run"), "component").withColumn("delta_pct", 100 * _over(F.col("run") - F.col("base"), F.col("base")))


def grouped_files(files: DataFrame) -> DataFrame:
    """A tree of scenario files (path, content): ``scenario``, ``season`` and ``digest``, and ``same_as``, the first scenario whose files of that season
    are the same byte for byte."""
    parts = F.split("path", "/")
    named = files.select(F.element_at(parts, -3).alias("scenario"), F.element_at(parts, -2).alias("season"), F.md5("content").alias("digest"))
    first = named.groupBy("season", "digest").agg(F.min("scenario").alias("same_as"))
    return named.join(first, ["season", "digest"])


def leaks(df: DataFrame, group: str, fold: str) -> DataFrame:
    """Groups that are on both sides of a split; a split by group has none."""
    return df.groupBy(group).agg(F.countDistinct(fold).alias("folds")).where("folds > 1")


def imputable(columns: Sequence[str], explanatory: Sequence[str]) -> list[str]:
    """The columns, refused if one of them is known only where the target is."""
    bad = sorted({*columns} & {*explanatory})
    if bad:
        raise ValueError(f"not known where the target isn't: {bad}")
    return list(columns)


def feature_neighbours(units: DataFrame, donors: DataFrame, columns: Sequence[str], k: int, most_donors: int = 100_000) -> DataFrame:
    """The k donors nearest in features (unit, donor, rank, distance): gaps filled with medians, columns scaled by the donors' spread.

    Donors are a table of profiled units: they are counted, and more than ``most_donors`` raise an error; each task of units then
    keeps k for each of its own."""
    if donors.count() > most_donors:
        raise ValueError(f"more than {most_donors} donors")
    stats = donors.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("q", lambda c: F.percentile(c, 0.5)),)]).first()
    filled = lambda df: df.select("unit", *[F.coalesce(F.col(c).cast("double"), F.lit(stats[f"q{i}"])).alias(f"x{i}") for i, c in enumerate(columns)])
    known = filled(donors)
    spread = known.agg(*[f(f"x{i}").alias(f"{n}{i}") for i in range(len(columns)) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    scaled = lambda df: df.select("unit", *[((F.col(f"x{i}") - spread[f"m{i}"]) / (spread[f"s{i}"] or 1.0)).alias(f"x{i}") for i in range(len(columns))])
    right = scaled(known).select(F.col("unit").alias("donor"), *[F.col(f"x{i}").alias(f"y{i}") for i in range(len(columns))])
    # Units of equal features are asked once; of donors with equal features only the k first can be among the k nearest.
    xs, ys = [f"x{i}" for i in range(len(columns))], [f"y{i}" for i in range(len(columns))]
    right = right.withColumn("_r", F.row_number().over(Window.partitionBy(*ys).orderBy("donor"))).where(F.col("_r") <= k).select("donor", *ys)
    known = right.toPandas()  # at most ``most_donors``
    points = known[ys].to_numpy(float)
    asked = scaled(filled(units)).select("unit", F.array(*xs).alias("_x"))

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        donors = known["donor"].to_numpy()
        for batch in batches:
            at, which, far = [], [], []
            for x in batch["_x"]:
                x, square = np.array(x, float), 0.0
                for i in range(len(x)):
                    square = square + (x[i] - points[:, i]) * (x[i] - points[:, i])
                d = np.sqrt(square)
                # All as near as the k-th, to what rounding can tell apart.
                kept = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1] + 2e-9) if len(d) > k else np.arange(len(d))
                at += [x] * len(kept)
                which.append(donors[kept])
                far.append(d[kept])
            if at:
                yield pd.DataFrame({"_x": at, "donor": np.concatenate(which), "distance": np.concatenate(far)})

    w = Window.partitionBy("_x").orderBy(F.round("distance", 9), "donor")
    met = asked.select("_x").distinct().mapInPandas(near, f"_x array<double>, donor {dict(right.dtypes)['donor']}, distance double")
    met = met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return asked.join(met, "_x").select("unit", "donor", "distance", "rank")


def neighbour_magnitude(neighbours: DataFrame, magnitudes: DataFrame) -> DataFrame:
    """The median magnitude (unit, magnitude) of each unit's donors."""
    return neighbours.join(magnitudes.select(F.col("unit").alias("donor"), "magnitude"), "donor").groupBy("unit").agg(F.percentile("magnitude", 0.5).alias("magnitude"))


def shape_scores(truth: DataFrame, told: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Correlation and RMSE by unit of shapes (unit, cell, shape) with those that were imputed."""
    met = truth.join(told.withColumnRenamed("shape", "_p"), ["unit", *keys])
    e = F.col("_p") - F.col("shape")
    return met.groupBy("unit").agg(F.corr("shape", "_p").alias("r"), F.sqrt(F.avg(e * e)).alias("rmse"), F.count("*").alias("n"))


def segment_scores(df: DataFrame, keys: Sequence[str], y: str, predicted: str) -> DataFrame:
    """RMSE and bias by segment, and the error at each segment's highest value."""
    e = F.col(predicted) - F.col(y)
    return df.groupBy(*keys).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), F.max_by(e, F.struct(F.col(y), F.col(predicted))).alias("peak_error"))


def drawn_options(choices: dict[str, Sequence[float]], n: int, seed: int) -> list[dict[str, float]]:
    """``n`` different settings drawn from lists of choices, the same for a seed wherever it runs; all of them if there are fewer."""
    size = math.prod(len(v) for v in choices.values())
    order = sorted(range(size), key=lambda i: hashlib.md5(f"{seed}|{i}".encode()).hexdigest())[: min(n, size)]
    out = []
    for i in order:
        one = {}
        for name, values in choices.items():
            i, at = divmod(i, len(values))
            one[name] = values[at]
        out.append(one)
    return out


def resampled_mean(df: DataFrame, keys: Sequence[str], value: str, draws: int, seed: int, unit: str) -> DataFrame:
    """Spread of a mean over draws in which each unit counts with a weight drawn by hash (a Bayesian bootstrap): one pass, no row twice."""
    w = -F.log(hash_uniform(F.lit(str(seed)), F.col("_draw").cast("string"), F.col(unit).cast("string")))
    each = df.withColumn("_draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).groupBy(*keys, "_draw").agg((F.sum(w * F.col(value)) / F.sum(w)).alias("_m"))
    return each.groupBy(*keys).agg(F.avg("_m").alias("mean"), F.stddev_samp("_m").alias("se"))
