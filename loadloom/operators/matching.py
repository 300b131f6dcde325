"""Names joined exactly, by rule and by likeness; catchments; mapping edges and their use."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def likeness(a: str, b: str) -> float:
    """100 times twice the longest common subsequence of the sorted words by the sum of their lengths."""
    a, b = (" ".join(sorted(x.lower().split())) for x in (a, b))
    if not a or not b:
        return 0.0
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    every = (1 << len(a)) - 1
    free = every  # a cleared bit is a character of ``a`` in the subsequence
    for ch in b:
        met = free & where.get(ch, 0)
        free = ((free + met) | (free - met)) & every
    return 200.0 * (len(a) - free.bit_count()) / (len(a) + len(b))


LETTERS = 64


def _letters(name: str) -> np.ndarray:
    """How often each letter is in the sorted words, by its number modulo LETTERS."""
    return np.bincount([ord(c) % LETTERS for c in " ".join(name.lower().split())], minlength=LETTERS).astype(np.int16)


def fuzzy_join(left: DataFrame, right: DataFrame, threshold: float = 75.0, most: int = 100_000) -> DataFrame:
    """Rows of ``left`` (k, name) with the ``match`` of ``right`` (name) that is most like it and its ``score``; nulls below the threshold.

    Each distinct name is compared once, with those whose letters in common allow a score as high as the best so far: these bound the
    common subsequence.  The right side is a dictionary: more than ``most`` distinct names raise an error.
    Null and empty names match nothing; ties go to the smaller name."""
    known = sorted(r[0] for r in right.select("name").where("trim(name) <> ''").distinct().limit(most + 1).collect())
    if len(known) > most:
        raise ValueError(f"more than {most} names to match")

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters = np.array([_letters(x) for x in known], np.int16).reshape(-1, LETTERS)
        sizes = letters.sum(1)
        for batch in batches:
            rows = []
            for name in batch["name"]:
                own = _letters(name)
                bound = 200.0 * np.minimum(letters, own).sum(1) / np.maximum(1, sizes + own.sum())
                score, match = 0.0, 0
                for i in np.flatnonzero(bound >= threshold)[np.argsort(-bound[bound >= threshold], kind="stable")]:
                    if bound[i] < score:
                        break
                    score, match = max((score, -match), (likeness(name, known[i]), -int(i)))
                    match = -match
                if score >= threshold and score > 0:
                    rows.append((name, known[match], score))
            yield pd.DataFrame(rows, columns=["name", "match", "score"])

    names = left.select("name").where("trim(name) <> ''").distinct()
    return left.join(names.mapInPandas(best, "name string, match string, score double"), "name", "left")


def name_variants(df: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Each name (k, name) with the variants that differ from it, by the first of the numbered rules (pattern, replacement) that makes them."""
    made = [F.struct(F.lit(i).alias("rule"), F.trim(F.regexp_replace("name", p, r)).alias("variant")) for i, (p, r) in enumerate(rules, 1)]
    rows = df.select("k", "name", F.explode(F.array(*made)).alias("_v")).select("k", "name", "_v.*").where("variant <> name AND variant <> ''")
    return rows.groupBy("k", "name", "variant").agg(F.min("rule").alias("rule"))


def resolve_names(left: DataFrame, routes: Sequence[tuple[str, Column, DataFrame]]) -> DataFrame:
    """``left`` (k, ...) with place, route and status, by the first route whose index (key, place) has the row's key.

    A key of several places is ambiguous and ends the search.  Indexes are reduced to a row a key before they are joined."""
    indexes = None
    for i, (_, _, index) in enumerate(routes):
        one = index.where("key IS NOT NULL").groupBy("key").agg(F.countDistinct("place").alias("_n"), F.min("place").alias("_place")).withColumn("_rank", F.lit(i))
        indexes = one if indexes is None else indexes.unionByName(one)
    keys = left.select("k", F.explode(F.array(*[F.struct(F.lit(i).alias("_rank"), key.alias("key")) for i, (_, key, _) in enumerate(routes)])).alias("_c")).select("k", "_c.*")
    first = keys.join(indexes, ["_rank", "key"]).groupBy("k").agg(F.min_by(F.struct("_n", "_place"), "_rank").alias("_b"), F.min("_rank").alias("_r"))
    names = F.array(*[F.lit(name) for name, _, _ in routes])
    out = left.join(first, "k", "left").withColumn("place", F.when(F.col("_b._n") == 1, F.col("_b._place"))).withColumn("route", F.get(names, F.col("_r")))
    return out.withColumn("status", F.when(F.col("_r").isNull(), "unmatched").when(F.col("_b._n") > 1, "ambiguous").otherwise("resolved")).drop("_b", "_r")


def checked_edges(edges: DataFrame, nodes: DataFrame, units: DataFrame) -> DataFrame:
    """Edges (node, unit, weight) with a status: what is wrong with them, or ok."""
    by = Window.partitionBy("node", "unit")
    a = nodes.select("node").distinct().withColumn("_a", F.lit(True))
    b = units.select("unit").distinct().withColumn("_b", F.lit(True))
    status = (
        F.when(F.col("_a").isNull(), "unknown node").when(F.col("_b").isNull(), "unknown unit")
        .when(F.col("weight").isNull() | F.isnan("weight") | (F.col("weight") <= 0), "bad weight").when(F.count("*").over(by) > 1, "repeated").otherwise("ok")
    )
    return edges.join(a, "node", "left").join(b, "unit", "left").withColumn("status", status).drop("_a", "_b")


def apply_mapping(values: DataFrame, mapping: DataFrame, cell: Sequence[str], renormalise: bool = False) -> DataFrame:
    """Values (k, cell, v) at the nodes (other) that ``mapping`` (k, other, share) leads to; unmapped rows are left out, or, with
    ``renormalise``, their value is spread over the rest of the cell."""
    at = values.join(mapping.where("other IS NOT NULL"), "k").groupBy("other", *cell).agg(F.sum(F.col("v") * F.col("share")).alias("v"))
    if not renormalise:
        return at
    whole = values.groupBy(*cell).agg(F.sum("v").alias("_v"))
    got = F.sum("v").over(Window.partitionBy(*cell))
    return at.join(whole, list(cell)).withColumn("v", F.when(got != 0, F.col("v") * F.col("_v") / F.when(got != 0, got)).otherwise(F.col("v"))).drop("_v")


def anchors(cost: np.ndarray) -> np.ndarray:
    """A distinct column for each row (rows <= columns) with the least sum: shortest augmenting paths."""
    return _anchors(cost.__getitem__, *cost.shape)


def _anchors(cost: Callable[[int], np.ndarray], n: int, m: int) -> np.ndarray:
    """The same of costs that are computed row by row, so that memory grows with rows and columns only."""
    u, v = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for row in range(n):
        reach, back, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        i, at = row, -1
        far = 0.0
        while True:
            step = far + cost(i) - u[i] - v
            better = ~done & (step < reach)
            reach[better], back[better] = step[better], at
            open_ = np.where(done, np.inf, reach)
            j = int(open_.argmin())
            if owner[j] >= 0:  # of columns as near, one that is free ends the search
                free = np.flatnonzero((open_ == open_[j]) & (owner < 0))
                j = int(free[0]) if len(free) else j
            far, at = reach[j], j
            done[j] = True
            if owner[j] < 0:
                break
            i = owner[j]
        u[row] += far
        for j in np.flatnonzero(done):
            if owner[j] >= 0:
                u[owner[j]] += far - reach[j]
            v[j] -= far - reach[j]
        while at >= 0:
            before = back[at]
            owner[at] = row if before < 0 else owner[before]
            at = before
    out = np.full(n, -1)
    held = np.flatnonzero(owner >= 0)
    out[owner[held]] = held
    return out


#: Distances that a task keeps.
HELD = 10_000_000


def _km(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
    la, lo, lb, ob = (np.radians(x.to_numpy(float)) for x in (a["lat"], a["lon"], b["lat"], b["lon"]))
    h = np.sin((lb[None] - la[:, None]) / 2) ** 2 + np.cos(la)[:, None] * np.cos(lb)[None] * np.sin((ob[None] - lo[:, None]) / 2) ** 2
    return 2 * 6371.0 * np.arcsin(np.sqrt(np.minimum(1.0, h)))


def catchments(units: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every node goes to one unit of its region, every unit has a node, and the sum of distances is the least.

    Both sides: region, k, lat, lon.  A node that is no unit's anchor goes to its nearest, so the distances above the nearest
    of distinct anchors are what is minimised.  Regions are solved apart, each in one task, which computes distances by unit and
    never holds those of all pairs; one with more units than nodes raises an error.  Regions without units have no rows."""

    def solve(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values("k", ignore_index=True), b.sort_values("k", ignore_index=True)
        if len(a) > len(b) and len(b):
            raise ValueError("more units than nodes in a region")
        if not len(a) or not len(b):
            return pd.DataFrame({"region": [], "node": [], "unit": [], "km": [], "anchor": []})
        # Distances to each position of nodes once, and of units that stand at one position once.
        spots = b[["lat", "lon"]].drop_duplicates(ignore_index=True)
        at = b[["lat", "lon"]].merge(spots.reset_index(), "left", on=["lat", "lon"])["index"].to_numpy()
        least, nearest = np.full(len(spots), np.inf), np.zeros(len(spots), int)
        row = functools.lru_cache(HELD // len(spots))(lambda lat, lon: _km(pd.DataFrame({"lat": [lat], "lon": [lon]}), spots)[0])
        places = list(zip(a["lat"].to_numpy(), a["lon"].to_numpy(), strict=True))
        for i, place in enumerate(places):
            d = row(*place)
            nearer = d < least
            least[nearer], nearest[nearer] = d[nearer], i
        goes, km = nearest[at], least[at]
        held = _anchors(lambda i: (row(*places[i]) - least)[at], len(a), len(b))
        goes[held] = np.arange(len(a))
        km[held] = [row(*place)[at[j]] for place, j in zip(places, held, strict=True)]
        anchor = np.isin(np.arange(len(b)), held)
        return pd.DataFrame({"region": b["region"], "node": b["k"], "unit": a["k"].to_numpy()[goes], "km": km, "anchor": anchor})

    sides = (x.select("region", "k", "lat", "lon").groupBy("region") for x in (units, nodes))
    left, right = sides
    return left.cogroup(right).applyInPandas(solve, "region long, node long, unit long, km double, anchor boolean")


def affine_fit(points: DataFrame) -> list[list[float]]:
    """[[a, b, c], [d, e, f]] with lon = a + b x + c y and lat = d + e x + f y by least squares; the sums are one row."""
    terms = {"x": F.col("x"), "y": F.col("y"), "lon": F.col("lon"), "lat": F.col("lat")}
    pairs = {f"{p}{q}": F.sum(terms[p] * terms[q]) for p, q in (("x", "x"), ("x", "y"), ("y", "y"), ("x", "lon"), ("y", "lon"), ("x", "lat"), ("y", "lat"))}
    r = points.agg(F.count("*").alias("n"), *[F.sum(c).alias(n) for n, c in terms.items()], *[c.alias(n) for n, c in pairs.items()]).first()
    left = np.array([[r["n"], r["x"], r["y"]], [r["x"], r["xx"], r["xy"]], [r["y"], r["xy"], r["yy"]]], float)
    right = np.array([[r["lon"], r["lat"]], [r["xlon"], r["xlat"]], [r["ylon"], r["ylat"]]], float)
    return np.linalg.solve(left, right).T.tolist()
