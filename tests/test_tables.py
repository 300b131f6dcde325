"""Files read and written, and streams."""

import datetime as dt
import zipfile

from pyspark.sql import functions as F

from loadloom.operators import surfaces
from loadloom.sources import tables as T
from loadloom.streaming import live


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿id,v,w\n007,1.5,\n008,NA,x\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("id,v,w\n009,2,\"\"\n")
    found = T.csv_strings(spark, str(tmp_path / "*.csv"))
    assert sorted(map(tuple, found.collect())) == [("007", "1.5", ""), ("008", "NA", "x"), ("009", "2", "")]
    typed = T.csv_typed(spark, str(tmp_path / "*.csv"), {"id": "string", "v": "double"})
    assert sorted(map(tuple, typed.collect()), key=str) == [("007", 1.5), ("008", None), ("009", 2.0)]


def test_zip(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.csv", "a,b\n1,2\n3,4\n")
        z.writestr("y.csv", "a\n5\n")
        z.writestr("notes.txt", "no")
    got = T.zipped_rows(spark, str(tmp_path / "*.zip"), ["a", "b"]).select("member", "a", "b")
    assert sorted(map(tuple, got.collect()), key=str) == [("x.csv", "1", "2"), ("x.csv", "3", "4"), ("y.csv", "5", None)]


def test_forms(spark, tmp_path):
    rows = spark.createDataFrame([("t1", "1", "x"), ("t2", "2", "3"), ("sum", "3", "3")], "label string, a string, b string")
    assert sorted(map(tuple, T.labelled_rows(rows, "label").collect()), key=str) == [("t1", "a", 1.0), ("t1", "b", None), ("t2", "a", 2.0), ("t2", "b", 3.0)]
    at = [dt.datetime(2024, 1, 1, h) for h in (0, 1, 3, 3)]
    assert sorted(r.seconds for r in T.gaps(spark.createDataFrame([(1, t) for t in at], "k int, t timestamp"), ["k"], "t").collect()) == [0, 7200]
    week = T.week_calendar(spark.createDataFrame([("w", dt.datetime(2024, 3, 1, 8))], "season string, start timestamp"))
    assert week.count() == 168 and tuple(week.where("i = 0").first()) == ("w", 0, 3, 0)
    long = spark.createDataFrame([(1, "b", 2.0), (2, "a", -0.04)], "t int, node string, mw double")
    table = T.printed(T.wide(long, "t", "node", "mw", ["b", "a"]), ["b", "a"], 1)
    T.write_printed(table, str(tmp_path / "out"), ["t"])
    assert sorted(map(tuple, T.csv_strings(spark, str(tmp_path / "out")).collect())) == [("1", "2.0", "0.0"), ("2", "0.0", "0.0")]


def test_package(spark, tmp_path):
    series = spark.createDataFrame([(dt.datetime(y, 1, 1), 0, 10.0) for y in (2023, 2024)], "t timestamp, cell int, mw double")
    T.write_package(series, spark.createDataFrame([(1, 0, 0.25), (2, 0, 0.75)], "node int, cell int, s double"), str(tmp_path))
    hourly = surfaces.expanded(*[spark.read.parquet(f"{tmp_path}/{n}") for n in ("series", "shares")])
    T.write_by_year(hourly, f"{tmp_path}/hourly")
    back = spark.read.parquet(f"{tmp_path}/hourly").groupBy("year").agg(F.sum("mw")).collect()
    assert sorted(map(tuple, back)) == [(2023, 10.0), (2024, 10.0)]


def test_streams(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, i % 2, base + dt.timedelta(minutes=10 * i), 1.0) for i in range(60)]
    schema = "id long, region int, ts timestamp, value double"
    spark.createDataFrame([*rows, rows[0]], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    read = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/in")

    def run(name, stream):
        live.drain(stream, f"{tmp_path}/{name}", f"{tmp_path}/{name}-state")
        return spark.read.parquet(f"{tmp_path}/{name}")

    assert run("unique", live.without_repeats(read(), "id")).count() == 60
    sums = run("sums", live.hourly(read(), ["region"], "value")).collect()
    want = spark.read.parquet(f"{tmp_path}/in").groupBy("region", F.date_trunc("hour", "ts").alias("t")).agg(F.sum("value").alias("mw"))
    known = {(r.region, r.t): r.mw for r in want.collect()}
    assert sums and all(known[r.region, r.t] == r.mw for r in sums)
    assert run("sessions", live.sessions(read(), "region", "15 minutes")).count() > 0
    weights = spark.createDataFrame([(r, f"{r}{u}", 1, h, 0.5) for r in (0, 1) for u in "ab" for h in range(24)], "region int, unit string, month int, hour int, weight double")
    loads = run("loads", live.disaggregated(read().select("region", F.col("ts").alias("t"), F.col("value").alias("mw")), weights))
    assert loads.count() == 122 and loads.agg(F.sum("load")).first()[0] == 61.0
    live.drain(live.without_repeats(read(), "id"), f"{tmp_path}/unique", f"{tmp_path}/unique-state")
    assert spark.read.parquet(f"{tmp_path}/unique").count() == 60
