"""Placement, periods and envelopes against plain Python."""

import datetime as dt
import math
import statistics

import pytest
from pyspark.sql import functions as F

from loadloom.functions import periods
from loadloom.functions import scalar as S
from loadloom.operators import envelopes as V
from loadloom.operators import placement as L
from loadloom.operators import reports as K
from loadloom.operators import spatial as P


def km(a, b):
    p, q = (tuple(map(math.radians, x)) for x in (a, b))
    h = math.sin((q[0] - p[0]) / 2) ** 2 + math.cos(p[0]) * math.cos(q[0]) * math.sin((q[1] - p[1]) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, h)))


def test_normal_cdf(spark):
    xs = [-9.0, -7.5, -3.0, -0.1, 0.0, 0.5, 2.0, 7.2]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", S.normal_cdf(F.col("x")).alias("p")).collect()
    for r in got:
        assert r.p == pytest.approx(math.erfc(-r.x / math.sqrt(2)) / 2, rel=1e-9)


def test_co_located(spark):
    rows = [(i, "ab"[i % 2], 34 + (i * 7 % 11) * 0.1, -118 - (i * 5 % 13) * 0.1, float(i), float(i % 4)) for i in range(60)]
    rows += [(100, "a", None, None, None, 5.0), (101, "a", None, -118.0, 7.0, 6.0), (102, None, 34.0, -118.0, 1.0, 1.0), (103, "a", rows[0][2], rows[0][3], 99.0, 1.0), (104, "c", 30.0, -110.0, None, None)]
    df = spark.createDataFrame(rows, "k int, name string, lat double, lon double, voltage double, mw double")
    want = []
    for name in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == name]
        left = [r for r in mine if r[2] is not None and r[3] is not None]
        rest = [r for r in mine if r[2] is None or r[3] is None]
        while left:
            near = [r for r in left if km(r[2:4], left[0][2:4]) <= 25]
            left = [r for r in left if r not in near]
            want.append(near)
        if rest:
            want.append(rest)
    got = {r.k: r for r in L.co_located(df, ["mw"], 25.0).collect()}
    assert set(got) == {c[0][0] for c in want}
    for c in want:
        r, w = got[c[0][0]], [x[5] for x in c]
        known = [x for x in w if x is not None]
        assert r.n_rows == len(c) and r.mw == (sum(known) if known else None)
        if all(x[2] is not None for x in c):
            w = w if len(known) == len(c) and sum(known) > 0 else [1.0] * len(c)
            assert r.lat == pytest.approx(sum(x[2] * y for x, y in zip(c, w, strict=True)) / sum(w))
    assert L.co_located(df.limit(0), ["mw"]).count() == 0
    with pytest.raises(Exception, match="more distinct positions"):
        L.co_located(df, ["mw"], 25.0, most=3).collect()


def test_place_names(spark):
    units = [("x", "one", "X1", 34.0, -118.0), ("x", "two", "X2", 34.0, -118.0), ("y", "two", "Y2", 36.0, -118.0), ("x", "bare", "XB", None, None)]
    rows = [
        (1, "one", None, None, None, "unit", "X1", "ok"), (2, "two", "y", None, None, "unit", "Y2", "ok"), (3, "two", None, 34.1, -118.0, "unit", "X2", "ok"),
        (4, "two", None, 35.0, -118.0, "unresolved", None, "several units"), (5, "two", None, None, None, "unresolved", None, "several units"), (6, "one", None, 40.0, -118.0, "coordinates", None, "unit too far"),
        (7, "told", None, None, None, "dictionary", "X1", "ok"), (8, "other", None, 34.0, -119.0, "coordinates", None, "ok"), (9, "known", None, None, None, "reference", None, "ok"),
        (10, "dim", None, None, None, "unresolved", None, "reference without coordinates"), (11, "nothing", None, None, None, "unresolved", None, "no match"), (12, "", None, 34.0, -118.0, "unresolved", None, "blank name"),
        (13, None, None, None, None, "unresolved", None, "blank name"), (14, "bare", None, 34.0, -118.0, "unit", "XB", "ok"),
    ]
    asked = spark.createDataFrame([r[:5] for r in rows], "k int, key string, owner string, lat double, lon double")
    u = spark.createDataFrame(units, "owner string, key string, place string, lat double, lon double")
    told = spark.createDataFrame([("told", "X1"), ("twice", "X1"), ("twice", "X2")], "key string, place string")
    known = spark.createDataFrame([("known", "R", 33.0, -117.0), ("dim", "D", None, None)], "key string, place string, lat double, lon double")
    got = {r.k: r for r in L.place_names(asked, u, told, known, 25.0, 100.0).collect()}
    assert len(got) == len(rows)
    for k, *_, route, place, status in rows:
        assert (got[k].route, got[k].place, got[k].status) == (route, place, status), k
    assert (got[9].place_lat, got[8].place_lat, got[6].place_lat) == (33.0, 34.0, 40.0)
    clash = spark.createDataFrame([(1, "twice", None, None, None)], asked.schema)
    with pytest.raises(Exception, match="several places for twice"):
        L.place_names(clash, u, told, known).collect()


def test_areas(spark):
    square = lambda x, y: [(x, y), (x + 2.0, y), (x + 2.0, y + 2.0), (x, y + 2.0)]
    areas = spark.createDataFrame([("a", square(-123.0, 33.0)), ("b", square(-119.0, 33.0))], "area string, ring array<struct<x: double, y: double>>")
    points = spark.createDataFrame([(1, 34.0, -122.0), (2, 34.0, -120.5), (3, 34.0, -119.5), (4, 30.0, -118.0), (5, None, -118.0)], "k int, lat double, lon double")
    got = {r.k: (r.area, r.fallback) for r in L.area_of(points, areas, P.inside).collect()}
    assert got == {1: ("a", False), 2: ("a", True), 3: ("b", True), 4: ("b", True), 5: (None, None)}
    m = spark.createDataFrame([(34.0, -120.0)], "lat double, lon double").select(L.metres_to_ring(F.col("lat"), F.col("lon"), F.lit(None).cast("array<struct<x: double, y: double>>")).alias("none"), *[c.alias(n) for c, n in zip(L.projected(F.col("lat"), F.col("lon")), "xy", strict=True)]).first()
    assert m.none is None and m.x == pytest.approx(0, abs=1e-6) and abs(m.y + 445_000) < 2_000
    far = areas.where("area = 'b'").crossJoin(points.where("k = 3")).select(L.metres_to_ring(F.col("lat"), F.col("lon"), F.col("ring")).alias("m")).first().m
    assert far == pytest.approx(km((34.0, -119.5), (34.0, -119.0)) * 1000, rel=0.02)


def test_periods():
    have = (range(2026, 2041), range(2007, 2013))
    assert periods.jobs("2030,2026", "2007,2008", *have) == [(2026, 2007, 1, 8760), (2026, 2008, 1, 8760), (2030, 2007, 1, 8760), (2030, 2008, 1, 8760)]
    assert periods.jobs("2030-2031", "2007", *have) == [(2030, 2007, 1, 8760), (2031, 2007, 1, 8760)]
    assert periods.jobs("2030-2030", "2007", *have) == [(2030, 2007, 1, 8760)]
    assert periods.jobs("2032-03-01:2033-01-02", "2008,2007", *have) == [(2032, 2008, 59 * 24 + 1, 8760), (2033, 2007, 1, 48)]
    for period, weather, why in (
        ("2030-2032", "2007,2008", "need 1 or 3"), ("2032-02-29:2032-03-01", "2007", "29 February"), ("2031-01-01:2030-01-01", "2007", "in order"), ("2050", "2007", "model years"), ("2030", "1999", "weather years"),
        ("2030,2030", "2007", "more than once"), ("", "2007", "empty"), ("x", "2007", "four digits"), ("2030", "", "are needed"), ("2031-2030", "2007", "before the first"), ("2030-1:2031-01-01", "2007", "of the form"),
    ):
        with pytest.raises(ValueError, match=why):
            periods.jobs(period, weather, *have)


@pytest.mark.parametrize("mode", ["proportional", "quadrature"])
def test_sibling_draws(spark, mode):
    start = dt.datetime(2024, 1, 1)
    z = spark.createDataFrame([(start + dt.timedelta(hours=h), h % 24 // 12, math.sin(h)) for h in range(24 * 5)], "t timestamp, cell int, z double")
    base = spark.createDataFrame([("b", c, 10.0 + c, 2.0) for c in range(3)], "base string, cell int, mu double, sigma double")
    nodes = spark.createDataFrame([(1, "b", 0.25), (2, "b", 0.75)], "node int, base string, k double")
    cells = spark.createDataFrame([(0, 0.3), (1, 1.0)], "cell int, rho double")
    got = {(r.node, r.cell): r["mean"] for r in V.sibling_draws(base, nodes, z, cells, 7, mode).collect()}
    eps = lambda n, d: S.normal_quantile(S.hash_uniform(F.lit("7"), F.lit("sibling"), F.lit(str(n)), F.lit(d)))
    days = [f"2024-01-0{d}" for d in range(1, 6)]
    for node, k in ((1, 0.25), (2, 0.75)):
        noise = statistics.mean(spark.range(1).select(*[eps(node, d).alias(d) for d in days]).first())
        size = k if mode == "proportional" else math.sqrt(k)
        zbar = statistics.mean(math.sin(h) for h in range(120) if h % 24 < 12)
        assert got[node, 0] == pytest.approx(k * 10 + size * 2 * (math.sqrt(0.3) * zbar + math.sqrt(0.7) * noise))
        assert got[node, 2] == pytest.approx(k * 12)


def test_sigma_and_years(spark):
    rows = spark.createDataFrame([(1, 0, 2.0), (2, 0, 4.0), (3, 1, -5.0)], "unit int, cell int, mu double")
    cv = spark.createDataFrame([(0, 0.5), (1, 0.1)], "cell int, cv double")
    assert {r.unit: r.sigma for r in V.with_sigma(rows, "proportional-cv", cv).collect()} == {1: 1.0, 2: 2.0, 3: 0.5}
    assert {r.unit: r.sigma for r in V.with_sigma(rows, "input-crosssec").collect()} == {1: pytest.approx(math.sqrt(2)), 2: pytest.approx(math.sqrt(2)), 3: None}
    for kind, why in (("scalar", "needs a value"), ("other", "unknown"), ("pinned-rho", "needs the system")):
        with pytest.raises(ValueError, match=why):
            V.with_sigma(rows, kind)
    hours = spark.sql("SELECT explode(sequence(timestamp'2023-12-31 00:00:00', timestamp'2024-12-31 23:00:00', interval 1 hour)) AS t")
    annual = spark.createDataFrame([(0, 2023, 9e6), (0, 2024, 2e6), (1, 2024, 4e6)], "draw int, year int, mwh double")
    assert tuple(V.annualised(annual, hours).first()) == (3.0, 2)
    assert V.annualised(annual, hours, 10**6).first().twh == pytest.approx((11 + 4) / 2 / (367 * 24 / 8760))


def test_uniform_family(spark):
    from loadloom.operators import stochastic as E

    env = spark.createDataFrame([(1, 0, 10.0, 3.0)], "unit int, hour int, mu double, sigma double")
    z = spark.createDataFrame([(dt.datetime(2024, 1, 1) + dt.timedelta(days=d), 0, 0.0) for d in range(2000)], "t timestamp, hour int, z double")
    cells = spark.createDataFrame([(0, 0.0)], "hour int, rho double")
    q = E.generate(env, z, cells, 7, 0, "uniform").agg(F.percentile("load", F.array(F.lit(0.1), F.lit(0.9))).alias("q"), F.max("load").alias("m")).first()
    width = 2 * S.Z90 * 3.0
    assert q.q == pytest.approx([10 - width / 2, 10 + width / 2], abs=0.35) and q.m <= 10 + width / 2 + width / 8 + 1e-9


def test_agreement_shifts_only_when_nothing_meets(spark):
    at = lambda h: dt.datetime(2024, 1, 1, h)
    a = spark.createDataFrame([("k", at(h), float(h)) for h in (1, 3)], "key string, t timestamp, v double")
    b = spark.createDataFrame([("k", at(h), float(h)) for h in (0, 2)], "key string, t timestamp, v double")
    r = K.agreement(a, b, ["key"], ["v"], 0.5).first()
    assert (r.shifted, r.n, r.mae, r.n_large) == (True, 2, 1.0, 2)
    assert K.agreement(a, a, ["key"], ["v"], 0.5).first().shifted is False


def test_overrides(spark):
    places = spark.createDataFrame([(1, "o", "a", 1.0, 2.0), (2, "o", "b", None, 2.0), (3, "o", "c", None, None), (4, None, "b", None, None)], "k int, owner string, name string, lat double, lon double")
    given = spark.createDataFrame([("o", "a", 9.0, 9.0), ("o", "a", 8.0, 8.0), ("o", "b", 5.0, 6.0), ("o", "b", 5.0, 6.0)], "owner string, name string, lat double, lon double")
    got = {r.k: (r.lat, r.lon, r.coordinates) for r in L.overridden(places, given).collect()}
    assert got == {1: (1.0, 2.0, "own"), 2: (5.0, 6.0, "override"), 3: (None, None, "none"), 4: (None, None, "none")}
    with pytest.raises(Exception, match="several overrides of o/c"):
        L.overridden(places, given.unionByName(given.select("owner", F.lit("c").alias("name"), "lat", "lon"))).collect()


def test_draws_take_every_region(spark):
    from loadloom.plans import fixtures as X
    from loadloom.plans import registry

    registry.load()
    data = "/root/testdata/sf0.001"
    regions = {r.region for r in X.series(spark, data).select("region").distinct().collect()}
    assert len(regions) == 5
    for name in ("generate_draw", "uniform_draw", "sibling_draws"):
        assert {r.region for r in registry.QUERIES[name](spark, data).select("region").distinct().collect()} == regions, name


def test_sibling_draws_by_region(spark):
    at = lambda d: dt.datetime(2024, 1, d)
    z = spark.createDataFrame([(0, at(1), 0, 1.0), (0, at(2), 0, -3.0), (1, at(1), 0, 2.0)], "region int, t timestamp, cell int, z double")
    base = spark.createDataFrame([("b", 0, 10.0, 2.0), ("b", 1, 20.0, 2.0)], "base string, cell int, mu double, sigma double")
    nodes = spark.createDataFrame([(1, "b", 0.5)], "node int, base string, k double")
    cells = spark.createDataFrame([(0, 0.25)], "cell int, rho double")
    got = {(r.region, r.cell): r["mean"] for r in V.sibling_draws(base, nodes, z, cells, 7, keys=["region"]).collect()}
    want = {(g, r.cell): r["mean"] for g in (0, 1) for r in V.sibling_draws(base, nodes, z.where(F.col("region") == g), cells, 7).collect()}
    assert got == pytest.approx(want) and len(got) == 4
