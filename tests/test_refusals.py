"""What is refused, and operators that SQL does not check, against plain Python."""

import hashlib
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from loadloom.functions import cleaning as N
from loadloom.operators import allocation as A
from loadloom.operators import external as Y
from loadloom.operators import frames as J
from loadloom.operators import matching as M
from loadloom.operators import proportional as P
from loadloom.operators import relational as R
from loadloom.operators import scenarios as C
from loadloom.operators import spatial as D
from loadloom.operators import testing as Q
from loadloom.sources import tables as Z


def refuses(df, message):
    with pytest.raises(Exception, match=message):
        df.collect()


def nodes(spark, rows):
    return spark.createDataFrame(rows, "block int, base string, node string, level double")


def test_levels(spark):
    rows = [(0, "a", "a1", 10.0), (0, "a", "a2", -4.0), (0, "b", "b1", -3.0), (0, "c", "c1", 6.0)]
    got = {r.node: r.share for r in A.level_shares(nodes(spark, rows)).collect()}
    assert got == pytest.approx({"a1": 0.5, "a2": 0.0, "b1": 0.0, "c1": 0.5})
    refuses(A.level_shares(nodes(spark, rows), "refuse"), "negative level")
    refuses(A.level_shares(nodes(spark, rows), "net-base", negative_base="refuse"), "a base nets below zero")
    refuses(A.level_shares(nodes(spark, [*rows, (0, "d", "d1", None)])), "a level is missing")
    refuses(A.level_shares(nodes(spark, [(0, "a", "a1", -1.0)]), "participate"), "net to nothing")
    refuses(A.level_shares(nodes(spark, [(0, "a", "a1", 10.0), (0, "b", "b1", -9.5)]), "participate", 0.2), "cancel")
    with pytest.raises(ValueError, match="unknown way"):
        A.level_shares(nodes(spark, rows), "other")


def test_slack_and_renormalised(spark):
    levels = spark.createDataFrame([("m", 0, 0.8, True), ("u", 0, 0.2, False)], "node string, block int, share double, mapped boolean")
    shapes = spark.createDataFrame([("m", 0, 0, 1.2), ("m", 1, 0, 0.8)], "node string, cell int, block int, shape double")
    got = {(r.node, r.cell): r.s for r in A.slack_shares(shapes, levels, most=2.0, least=0.1).collect()}
    assert got == pytest.approx({("m", 0): 0.96, ("m", 1): 0.64, ("u", 0): 0.04, ("u", 1): 0.36})
    refuses(A.slack_shares(shapes, levels, most=1.5), "amplified")
    refuses(A.slack_shares(shapes, levels, least=0.5), "change their sign")
    refuses(A.slack_shares(shapes, levels.withColumn("mapped", F.lit(True))), "no unmapped node")
    sums = A.renormalised_shares(shapes, levels).groupBy("cell").agg(F.sum("s").alias("s")).collect()
    assert all(r.s == pytest.approx(1) for r in sums)
    refuses(A.renormalised_shares(shapes.withColumn("shape", F.lit(-0.25)), levels), "cancel")
    flat = A.energy_normalised(spark.createDataFrame([("u", 0, 0, 1.0), ("u", 1, 0, -0.9)], "unit string, cell int, block int, value double"), spark.createDataFrame([(0, 1.0), (1, 1.0)], "cell int, energy double"))
    assert {r["shape"] for r in flat.collect()} == {1.0}


def test_node_table(spark):
    kind = "node_id string, base_id string, winter_load string, summer_load string"
    table = lambda *rows: P.node_table(spark.createDataFrame(rows, kind))
    good = ("a,'\n é", "b", " 1e3 ", "-2")
    r = table(good).first()
    assert (r.node_id, r.base_id, r.subname, r.winter_load, r.summer_load) == (good[0], "b", "", 1000.0, -2.0)
    refuses(table(good, (" ", "b", "1", "1")), "a node id is blank")
    refuses(table(good, good), "a node id repeats")
    refuses(table((*good[:1], " ", "1", "1")), "a base id is blank")
    for bad in ("", "-", "N/A", "3 MW", "NaN", "Infinity", None):
        refuses(table(("x", "b", bad, "1")), "no finite number")
    with pytest.raises(ValueError, match="no column"):
        P.node_table(spark.createDataFrame([("a",)], "node_id string"))
    assert P.node_table(spark.createDataFrame([("a", "1", "2")], "node_id string, winter_load string, summer_load string")).first().base_id == "a"


def test_rounding(spark):
    rng = random.Random(4)
    rows = [(k, i, rng.uniform(0, 37)) for k in range(20) for i in range(50)]
    df = spark.createDataFrame(rows, "k int, o int, v double")
    got = R.round_to_printed(df, ["k"], "v", "o", 1).collect()
    for k in range(20):
        assert round(sum(r.printed for r in got if r.k == k) * 10) == round(sum(r.v for r in got if r.k == k) * 10)
    assert all(abs(r.printed - r.v) < 0.1 + 1e-9 for r in got)
    two = spark.createDataFrame([(0, 0, 1.0), (0, 1, 1.0)], "k int, o int, v double")
    refuses(R.round_to_printed(two, ["k"], "v", "o", 1, F.lit(9.0)), "wider than rounding")
    refuses(R.round_to_printed(two.withColumn("v", F.lit(0.0)), ["k"], "v", "o", 1, F.lit(-0.1)), "not enough units")
    assert sorted(r.printed for r in R.round_to_printed(two.withColumn("v", F.lit(0.0)), ["k"], "v", "o", 1, F.lit(-0.1), allow_negative=True).collect()) == [-0.1, 0.0]


def test_rescaling_conserves(spark):
    demand = spark.createDataFrame([(t, z, float(10 * t + z)) for t in range(6) for z in range(4)], "t int, zone int, mw double")
    cells = spark.createDataFrame([(t, t % 2) for t in range(6)], "t int, cell int")
    shares = spark.createDataFrame([(0, 0, 0.25), (0, 1, 0.75), (1, 1, 1.0)], "cell int, zone int, share double")
    for hold in (False, True):
        got = A.rescale(demand, shares, hold, cells)
        sums = {r.t: r.s for r in got.groupBy("t").agg(F.sum("mw").alias("s")).collect()}
        assert sums == pytest.approx({t: sum(10 * t + z for z in range(4)) for t in range(6)})
        kept = got.where("zone = 3").collect()
        assert all(r.mw == (10 * r.t + 3 if hold else 0) for r in kept)
    refuses(A.rescale(demand, shares.where("cell = 0"), False, cells), "a cell has no shares")


def test_external_loads(spark):
    kind = "name string, summer_load string, winter_load string, latitude string, long string"
    loads = lambda *rows, **how: Y.seasonal_loads(spark.createDataFrame(rows, kind), **how)
    a = ("A", "1", "x", "34", "-118")
    r = loads(a).first()
    assert (r.summer_load, r.winter_load, r.lat, r.utility) == (1.0, None, 34.0, None) and r.row_id
    refuses(loads(("A", "1", "1", "34", None)), "only one of lat and lon")
    refuses(loads(("A", "1", "1", "34", "-200")), "off the globe")
    refuses(loads(a, a), "a name repeats")
    assert len({r.row_id for r in loads(a, a, duplicates="keep").collect()}) == 2
    merged = loads(a, ("A", "2", "3", "34.001", "-118"), ("A", "5", "3", "36", "-118"), duplicates="sum").collect()
    assert sorted((r.summer_load, r.merged) for r in merged) == [(3.0, 2), (5.0, 1)]
    with pytest.raises(ValueError, match="unknown way"):
        loads(a, duplicates="drop")
    hours = [("PGE", "Summer", str(h), "2") for h in range(24)]
    shapes = lambda rows: Y.seasonal_shapes(spark.createDataFrame(rows, "utility string, season string, hour string, shape string"))
    assert {r["shape"] for r in shapes(hours).collect()} == {1.0}
    refuses(shapes(hours[:-1]), "all 24 hours")
    refuses(shapes([*hours[:-1], ("PGE", "autumn", "23", "2")]), "unknown season")
    refuses(shapes([*hours[:-1], ("PGE", "summer", "23", "a")]), "no number")
    refuses(shapes([(u, s, h, "-1") for u, s, h, _ in hours]), "not positive")


def test_gaps_and_cells(spark):
    series = spark.createDataFrame([("a", f"2030-01-01 0{h}:00:00") for h in range(5)], "k string, t string").withColumn("t", F.col("t").cast("timestamp"))
    assert Z.gapless(series, ["k"], "t").count() == 5
    refuses(Z.gapless(series.where("hour(t) <> 2"), ["k"], "t"), "a gap or a repeat")
    refuses(Z.gapless(series.unionByName(series.limit(1)), ["k"], "t"), "a gap or a repeat")
    cells = spark.createDataFrame([(1, 0, 5), (1, 0, 6)], "month int, hour int, cell int")
    refuses(C.encoded(cells.select("month", "hour"), cells), "several cells")


def test_wide_file(spark, tmp_path):
    long = spark.createDataFrame([(t, z, t + z / 3) for t in range(1, 30) for z in (1, 2)], "Time_Index int, z int, mw double")
    voll = spark.createDataFrame([(t, f"0{t}.50") for t in range(1, 30)], "Time_Index int, Voll string")
    Z.write_wide(long, str(tmp_path / "out"), "Time_Index", "z", "mw", [2, 1], 1, voll)
    back = Z.csv_strings(spark, str(tmp_path / "out"))
    assert back.columns == ["Voll", "Time_Index", "2", "1"]
    rows = {int(r.Time_Index): r for r in back.collect()}
    assert len(rows) == 29 and rows[3]["2"] == "3.7" and rows[3]["1"] == "3.3" and rows[3].Voll == "03.50"


def test_lookups_and_leakage(spark):
    df, table = spark.createDataFrame([(1,), (1,), (2,)], "k int"), spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    refuses(J.looked_up(df, table, ["k"]), "a key of the table repeats")
    assert J.looked_up(df, table.limit(1), ["k"]).count() == 3
    with pytest.raises(ValueError, match="peak"):
        Q.imputable(["area", "peak"], ["peak"])
    with pytest.raises(ValueError, match="donors"):
        Q.feature_neighbours(df.withColumnRenamed("k", "unit"), df.withColumnRenamed("k", "unit"), ["unit"], 1, most_donors=2)


def test_nearest_everywhere(spark):
    rng = random.Random(7)
    spots = [(i, math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180), i % 3) for i in range(150)]
    asked = [(i, math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180), i % 4) for i in range(40)]
    asked += [(100, 0.0, 179.99, 0), (101, 89.0, 0.0, 1), (102, -90.0, 5.0, 2), (103, None, 1.0, 0)]
    spots += [(500, 0.0, -179.99, 0), (501, 89.0, 10.0, 1), (502, 0.0, -179.99, 1)]
    kind = "k int, lat double, lon double, class int"
    left, right = spark.createDataFrame(asked, kind), spark.createDataFrame(spots, kind)

    def km(a, b):
        p, q = (tuple(map(math.radians, x[1:3])) for x in (a, b))
        h = math.sin((q[0] - p[0]) / 2) ** 2 + math.cos(p[0]) * math.cos(q[0]) * math.sin((q[1] - p[1]) / 2) ** 2
        return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, h)))

    placed = [a for a in asked if a[1] is not None]
    got = {(r.k, r.other) for r in D.within_km(left, right, 2500.0).collect()}
    assert got == {(a[0], b[0]) for a in placed for b in spots if km(a, b) <= 2500} and (100, 500) in got and (101, 501) in got
    want = {(a[0], b[0], n) for a in placed for n, b in enumerate(sorted(spots, key=lambda b: (round(km(a, b), 9), b[0]))[:4], 1)}  # noqa: B023
    for km_ in (1.0, 300.0, 30_000.0):  # where to look first doesn't matter
        assert {(r.k, r.other, r["rank"]) for r in D.k_nearest(left, right, 4, km_).collect()} == want
    ties = {(r.k, r.other) for r in D.nearest_with_ties(left, right).collect()}
    assert {(100, 500), (100, 502), (103, None)} <= ties and len(ties) == len(asked) + 1
    best = {}
    for a in placed:
        own = [b for b in spots if b[3] == a[3]] or spots
        best[a[0]] = (min(own, key=lambda b: (round(km(a, b), 9), b[0]))[0], a[3] < 3)  # noqa: B023
    assert {r.k: (r.other, r.same) for r in D.nearest_of_class(left, right).collect()} == best
    assert D.k_nearest(left, right.limit(0), 2).count() == 0


def test_probabilities_of_student():
    for t, df, p in ((0.0, 5, 1.0), (2.0, 10, 0.07338803477074), (1.0, 1, 0.5), (12.7062047364, 1, 0.05), (1.959963984540, 1e7, 0.05)):
        assert Q.student_p(t, df) == pytest.approx(p, rel=2e-4)
    for t, df in ((-3.5, 30), (2.5, 2.5), (0.3, 7), (6.0, 4), (1.2, 200)):
        # x = sqrt(df) tan(a) makes the density a power of the cosine.
        size = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
        low, n = math.atan(abs(t) / math.sqrt(df)), 20_000
        step = (math.pi / 2 - low) / n
        area = sum(math.cos(low + (i + 0.5) * step) ** (df - 1) for i in range(n)) * step
        assert Q.student_p(t, df) == pytest.approx(2 * size * area, rel=1e-6)
    assert Q.student_p(math.nan, 3) is None and Q.student_p(1.0, 0) is None and Q.student_p(math.inf, 3) == 0.0


def test_fuzzy_names_against_all_pairs(spark):
    rng = random.Random(3)
    known = ["".join(rng.choice("abcdef ") for _ in range(rng.randrange(1, 14))) for _ in range(120)]
    asked = known[:20] + ["".join(rng.choice("abcdef ") for _ in range(rng.randrange(1, 14))) for _ in range(80)] + [None, "", " "]
    left = spark.createDataFrame(list(enumerate(asked)), "k int, name string")
    right = spark.createDataFrame([(x,) for x in known], "name string")
    names = sorted({x for x in known if x.strip()})
    for r in M.fuzzy_join(left, right).collect():
        score, match = max(((M.likeness(r.name, x), -i) for i, x in enumerate(names)), default=(0, 0)) if r.name and r.name.strip() else (0, 0)
        assert (r.match, r.score) == ((names[-match], pytest.approx(score)) if score >= 75 else (None, None)), r.name


def test_drawn_options():
    choices = {"a": [1, 2, 3], "b": [10, 20]}
    every = [{"a": a, "b": b} for b, a in itertools.product(choices["b"], choices["a"])]
    order = sorted(range(6), key=lambda i: hashlib.md5(f"9|{i}".encode()).hexdigest())
    assert Q.drawn_options(choices, 4, 9) == [every[i] for i in order[:4]] and len(Q.drawn_options(choices, 99, 9)) == 6


def test_variants_of_names(spark):
    names = ["EL NO 3", "HART PH", "MOUNTAIN VIEW", "RIO A", "SF B (Mission)", "Oak (old)", "ROSE AND PINE", "plain"]
    got = spark.createDataFrame([(x,) for x in names], "n string").select("n", F.explode(N.variants(F.col("n"))).alias("v")).select("n", "v.*").where("NOT rule LIKE 'numbered%'").collect()
    assert {(r.n, r.rule, r.variant) for r in got} == {
        ("EL NO 3", "no_n_rule", "EL 3"), ("HART PH", "ph_drop", "HART"), ("MOUNTAIN VIEW", "mountain_mt", "Mt. VIEW"), ("RIO A", "station_insert", "RIO Station A"), ("RIO A", "letter_drop", "RIO"),
        ("SF B (Mission)", "sf_paren", "Mission"), ("SF B (Mission)", "paren_strip", "SF B"), ("Oak (old)", "paren_strip", "Oak"), ("ROSE AND PINE", "and_ampersand", "ROSE & PINE"),
    }
