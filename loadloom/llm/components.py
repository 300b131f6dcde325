"""Connected components of an edge table by alternating large-star and small-star steps in DataFrames; once the edges are few, each
of these steps costs more than all the rest, and the driver finds their components at once.  Both ways are exact."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Edges of two long integers that the driver takes; beyond that nothing is gathered.
GATHERED_BYTES, EDGE_BYTES = 16 << 20, 16


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    near = _both(edges)
    least = near.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return near.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def least_of_each(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of edges in memory: each node that isn't the least of its component, and the least."""
    nodes, places = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = places[: len(u)], places[len(u) :]
    root = np.arange(len(nodes))
    while (root[a] != root[b]).any():
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != root[root]).any():
            root = root[root]
    more = root != np.arange(len(nodes))
    return nodes[more], nodes[root[more]]


def components(edges: DataFrame) -> DataFrame:
    """``u``, ``root``: for each node that isn't the least of its component, the least.  ``edges`` has ``u`` and ``v``.

    Beyond ``GATHERED_BYTES`` the number of rounds grows with the logarithm of a component's diameter; each is written to the shared folder.
    Loops and repeated edges do no harm; no edges give an empty table."""
    clean = lambda e: e.where(F.col("u") != F.col("v")).distinct()
    now = materialise(edges.select("u", "v").where(F.col("u") != F.col("v")), "edges")
    if now.count() * EDGE_BYTES <= GATHERED_BYTES:
        few = now.toArrow()
        u, root = least_of_each(*(few.column(c).to_numpy() for c in ("u", "v")))
        return materialise(now.sparkSession.createDataFrame(pa.table({"u": pa.array(u, pa.int64()), "root": pa.array(root, pa.int64())})), "roots")
    now, before = materialise(clean(now), "edges"), None
    while True:
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == tuple(sign) or not sign[0]:
            return now.select("u", F.col("v").alias("root"))
        before = tuple(sign)
        now = materialise(clean(_small_star(clean(_large_star(now)))), "edges")
