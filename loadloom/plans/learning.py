"""Queries of fitted models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import learning as L
from ..operators import statistics as T
from . import fixtures as X
from .registry import query


def _rows(s, d):
    return X.read(s, d, "part").select(F.col("p_partkey").alias("k"), "p_brand", F.col("p_size").cast("double").alias("size"), (F.col("p_partkey") % 97).cast("double").alias("phase"), F.col("p_retailprice").alias("price"))


@query("ols_coefficients", "SELECT round(regr_slope(p_retailprice, p_size), 5) AS slope, round(regr_intercept(p_retailprice, p_size), 4) AS intercept FROM part")
def ols_coefficients(s, d):
    model = L.fit(_rows(s, d), ["size"], "price", "ols", scaled=False).stages[-1]
    return s.createDataFrame([(round(float(model.coefficients[0]), 5), round(model.intercept, 4))], "slope double, intercept double")


@query("model_scores")
def model_scores(s, d):
    """RMSE and the like of each kind of model on the groups that it wasn't fitted to."""
    rows = T.group_folds(_rows(s, d), "p_brand", 5)
    seen, held = rows.where("fold <> 0"), rows.where("fold = 0")
    mean = seen.agg(F.avg("price").alias("baseline"))
    out = None
    for kind in ("ols", "ridge", "lasso", "elastic", "boosted"):
        told = L.fit(seen, ["size", "phase"], "price", kind).transform(held).crossJoin(F.broadcast(mean))  # a single row
        one = T.scores(told.withColumn("model", F.lit(kind)), ["model"], "price", "predicted", "baseline")
        out = one if out is None else out.unionByName(one)
    return out


@query("spatial_blocks")
def spatial_blocks(s, d):
    at = X.places(X.read(s, d, "supplier").select(F.col("s_suppkey").alias("k")), "k")
    return L.spatial_blocks(at, ["lat", "lon"], 4).select("k", "block")


@query("penalty_search")
def penalty_search(s, d):
    penalties = [0.01, 0.1, 1.0]
    best, means = L.search(T.group_folds(_rows(s, d), "p_brand", 3), ["size", "phase"], "price", penalties, 3)
    return s.createDataFrame([(p, m, p == best) for p, m in zip(penalties, means, strict=True)], "penalty double, rmse double, best boolean")
