"""Matching against brute force."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loadloom.operators import matching as M


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b, 1):
            row[j] = last[j - 1] + 1 if x == y else max(last[j], row[j - 1])
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", max_size=12), st.text("abc ", max_size=12))
def test_likeness(a, b):
    x, y = (" ".join(sorted(s.split())) for s in (a, b))
    want = 200.0 * slow_lcs(x, y) / (len(x) + len(y)) if x and y else 0.0
    assert M.likeness(a, b) == pytest.approx(want)


def test_anchors():
    rng = np.random.default_rng(7)
    for _ in range(60):
        n = int(rng.integers(1, 5))
        cost = rng.integers(0, 9, (n, n + int(rng.integers(0, 3)))).astype(float)
        got = M.anchors(cost)
        best = min(sum(cost[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(cost.shape[1]), n))
        assert len(set(got)) == n and cost[np.arange(n), got].sum() == best


def test_catchments(spark):
    rng = np.random.default_rng(3)
    at = lambda n, r: [(r, i, float(a), float(b)) for i, (a, b) in enumerate(rng.uniform(30, 40, (n, 2)))]
    units, nodes = at(3, 1) + at(2, 2), at(6, 1) + at(4, 2) + at(2, 3)
    schema = "region long, k long, lat double, lon double"
    got = M.catchments(spark.createDataFrame(units, schema), spark.createDataFrame(nodes, schema)).toPandas()
    import pandas as pd

    for region in (1, 2):
        a, b = (pd.DataFrame([x for x in side if x[0] == region], columns=["region", "k", "lat", "lon"]) for side in (units, nodes))
        d = M._km(a, b)
        best = min(sum(d[u, i] for i, u in enumerate(p)) for p in itertools.product(range(len(a)), repeat=len(b)) if len(set(p)) == len(a))
        mine = got[got.region == region]
        assert mine.km.sum() == pytest.approx(best) and set(mine.unit) == set(a.k) and len(mine) == len(b)
    assert 3 not in set(got.region)


def test_fuzzy_join(spark):
    left = spark.createDataFrame([(1, "north creek"), (2, "Creek  North"), (3, "zzz"), (4, None), (5, " ")], "k int, name string")
    right = spark.createDataFrame([("creek north",), ("creek nort",), (None,), ("",)], "name string")
    got = {r.k: r.match for r in M.fuzzy_join(left, right).collect()}
    assert got == {1: "creek north", 2: "creek north", 3: None, 4: None, 5: None}
    with pytest.raises(ValueError):
        M.fuzzy_join(left, right, most=1)
    assert {r.match for r in M.fuzzy_join(left, right.where("false")).collect()} == {None}


def test_fuzzy_names_takes_the_whole_dictionary(spark):
    from loadloom.plans import registry

    registry.load()
    data = "/root/testdata/sf0.001"
    got = registry.QUERIES["fuzzy_names"](spark, data).where("trim(name) <> ''").collect()
    assert got and all(r.score == 100 for r in got)  # each name is in the dictionary
