"""Reading of loosely kept files, and the forms in which results are written."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def csv_strings(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Every field of the files (a path, list or pattern) as the string that stands there; empty fields are empty strings."""
    df = spark.read.csv(path, header=True, inferSchema=False, encoding="UTF-8").na.fill("")
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


def csv_typed(spark: SparkSession, path: str | list[str], types: dict[str, str]) -> DataFrame:
    """The named columns in the given types; what can't be read as its type is null.  Other columns are not parsed."""
    return csv_strings(spark, path).select(*[F.col(f"`{c}`").try_cast(t).alias(c) for c, t in types.items()])


def zipped_rows(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Rows of the CSV files within zip archives as strings, with archive and member; columns that a member lacks are null.

    A task holds one archive and streams its members."""
    names = list(columns)

    def unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for place, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in sorted(n for n in z.namelist() if n.lower().endswith(".csv")):
                        with z.open(member) as raw:
                            rows = csv.DictReader(io.TextIOWrapper(raw, encoding="utf-8-sig", newline=""))
                            block = []
                            for row in rows:
                                block.append((place, member, *[row.get(c) for c in names]))
                                if len(block) == 10_000:
                                    yield pd.DataFrame(block, columns=["archive", "member", *names])
                                    block = []
                            yield pd.DataFrame(block, columns=["archive", "member", *names])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(unzip, ", ".join(f"`{c}` string" for c in ("archive", "member", *names)))


def labelled_rows(df: DataFrame, label: str, pattern: str = r"^t\d+$") -> DataFrame:
    """Long form (label, column, value) of the rows whose label fits the pattern; values that aren't numbers are null."""
    values = [c for c in df.columns if c != label]
    return df.where(F.col(label).rlike(pattern)).select(label, *[F.col(f"`{c}`").try_cast("double").alias(c) for c in values]).unpivot(label, values, "column", "value")


def gaps(df: DataFrame, keys: Sequence[str], t: str, hours: int = 1) -> DataFrame:
    """Rows that don't follow the one before by exactly ``hours``: repeated ones and those after a gap."""
    w = Window.partitionBy(*keys).orderBy(t)
    step = F.unix_timestamp(t) - F.unix_timestamp(F.lag(t).over(w))
    return df.withColumn("seconds", step).where(F.col("seconds") != 3600 * hours)


def gapless(df: DataFrame, keys: Sequence[str], t: str, hours: int = 1) -> DataFrame:
    """The rows; one that doesn't follow the one before by exactly ``hours`` raises an error."""
    w = Window.partitionBy(*keys).orderBy(t)
    step = F.unix_timestamp(t) - F.unix_timestamp(F.lag(t).over(w))
    wrong = F.raise_error(F.concat(F.lit("the series has a gap or a repeat at "), F.col(t).cast("string"))).cast("boolean")
    return df.withColumn("_step", step).where(F.when(F.col("_step") != 3600 * hours, wrong).otherwise(F.lit(True))).drop("_step")


def week_calendar(starts: DataFrame, offset_hours: int = -8) -> DataFrame:
    """The 168 hours of each representative week (season, start as UTC) with month and hour at a fixed offset from UTC."""
    hours = starts.select("season", "start", F.explode(F.sequence(F.lit(0), F.lit(167))).alias("i"))
    at = F.timestamp_seconds(F.unix_timestamp("start") + (F.col("i") + offset_hours) * 3600)
    return hours.select("season", "i", F.month(at).alias("month"), F.hour(at).alias("hour"))


def wide(df: DataFrame, row: str, column: str, value: str, names: Sequence) -> DataFrame:
    """A column for each of ``names`` in their order; rows without a value have 0."""
    return df.groupBy(row).pivot(column, list(names)).agg(F.sum(value)).na.fill(0.0)


def printed(df: DataFrame, columns: Sequence[str], digits: int) -> DataFrame:
    """The columns as text with a fixed number of digits; there is no negative zero."""
    p = f"%.{digits}f"

    def text(c: str) -> Column:
        rounded = F.bround(c, digits)
        return F.format_string(p, F.when(rounded == 0, F.lit(0.0)).otherwise(rounded.cast("double")))

    return df.withColumns({c: F.when(F.col(c).isNotNull(), text(c)) for c in columns})


def write_printed(df: DataFrame, path: str, order: Sequence[str], compression: str | None = None) -> None:
    """CSV in the order of the named columns; parts follow each other in it."""
    df.orderBy(*order).write.mode("overwrite").option("compression", compression or "none").csv(path, header=True)


def write_wide(df: DataFrame, path: str, row: str, column: str, value: str, names: Sequence, digits: int, metadata: DataFrame | None = None) -> None:
    """A wide table of demand as compressed CSV in order of its rows: first the columns of ``metadata`` (with ``row``) as they are, then
    one for each name, with a fixed number of digits.  Rows are dealt by range, so that no task has all of them."""
    table = printed(wide(df, row, column, value, names), [str(n) for n in names], digits)
    if metadata is not None:
        first = [c for c in metadata.columns if c != row]
        table = metadata.join(table, row).select(*first, row, *[str(n) for n in names])
    table.repartitionByRange(row).sortWithinPartitions(row).write.mode("overwrite").option("compression", "gzip").csv(path, header=True)


def write_package(series: DataFrame, shares: DataFrame, path: str) -> None:
    """The compact form of hourly results: a series by cell and each cell's shares."""
    series.write.mode("overwrite").parquet(f"{path}/series")
    shares.write.mode("overwrite").parquet(f"{path}/shares")


def write_by_year(df: DataFrame, path: str, t: str = "t") -> None:
    """Parquet in a folder a year; rows are brought together by year and day first, so that a year has many writers but few files."""
    dated = df.withColumn("year", F.year(t))
    dated.repartition("year", F.dayofyear(t)).write.mode("overwrite").partitionBy("year").parquet(path)
