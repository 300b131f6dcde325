"""The grammar of requested periods, and the jobs that a request stands for.

A period is a year (``2035``) or a list of years (``2026,2030``), each met with every weather year; or a range of years
(``2030-2035``) or of days (``2030-01-01:2031-06-30``), one continuous series whose calendar years take the weather years in
turn (a single one is repeated).  Years have 8760 hours: 29 February can't be asked for."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Sequence
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The lengths of the months of a year of 8760 hours.
MONTHS = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
YEAR_HOURS = 24 * sum(MONTHS)
JOB = "job int, model_year int, weather_year int, first_hour int, last_hour int"
#: A term of a request: a year, a range of years, or a range of days.
TERM = re.compile(r"(?P<year>\d{4})|(?P<low>\d{4})\s*-\s*(?P<high>\d{4})|(?P<start>[^:]*):(?P<end>[^:]*)")


def _distinct(found: Sequence[int], what: str) -> list[int]:
    if twice := sorted(y for y, n in Counter(found).items() if n > 1):
        raise ValueError(f"{what}: listed more than once: {twice}")
    return [*found]


def _terms(text: object) -> list[str]:
    return [t for t in (part.strip() for part in str("" if text is None else text).split(",")) if t]


def years(text: str | int | None, what: str = "years") -> list[int]:
    """The years of a list, in its order; repeats are refused."""
    terms = _terms(text)
    if not all(len(t) == 4 and t.isdecimal() for t in terms):
        raise ValueError(f"{what}: not years of four digits: {text}")
    return _distinct([*map(int, terms)], what)


def day_begins(text: str) -> int:
    """The hour at which a day begins, counted in years of 8760 hours from the year 0."""
    fields = re.fullmatch(r"\s*(\d{4})-(\d\d?)-(\d\d?)\s*", text)
    if fields is None:
        raise ValueError(f"not a day of the form YYYY-MM-DD: {text!r}")
    year, month, day = map(int, fields.groups())
    if (month, day) == (2, 29):
        raise ValueError("29 February is not in a year of 8760 hours: use 28 February or 1 March")
    if not 1 <= month <= 12 or not 1 <= day <= MONTHS[month - 1]:
        raise ValueError(f"not a day of the form YYYY-MM-DD: {text!r}")
    return year * YEAR_HOURS + 24 * (sum(MONTHS[: month - 1]) + day - 1)


def interval(term: str) -> tuple[int, int, bool]:
    """The hours [begin, end) of a term, and whether it is one series over them, which a single year is not."""
    m = TERM.fullmatch(term)
    if m is None:
        raise ValueError(f"period: not a first and a last day in order, nor years of four digits: {term!r}")
    if m["start"] is not None:
        begin, end = day_begins(m["start"]), day_begins(m["end"]) + 24
        if begin >= end:
            raise ValueError(f"not a first and a last day in order: {term!r}")
        return begin, end, True
    low = int(m["year"] or m["low"])
    high = int(m["high"] or low)
    if high < low:
        raise ValueError(f"the last year is before the first: {term!r}")
    return low * YEAR_HOURS, (high + 1) * YEAR_HOURS, high > low


def cut_by_year(begin: int, end: int) -> list[tuple[int, int, int]]:
    """(year, first hour, last hour) of each year that the hours touch, hours of a year from 1."""
    touched = range(begin // YEAR_HOURS, -(-end // YEAR_HOURS))
    return [(y, max(begin - y * YEAR_HOURS, 0) + 1, min(end - y * YEAR_HOURS, YEAR_HOURS)) for y in touched]


def _in_source(asked: Iterable[int], source: Iterable[int], what: str) -> None:
    have = {*source}
    if lacking := sorted({*asked} - have):
        raise ValueError(f"{what} years that the source lacks: {lacking}; it has {sorted(have)}")


def jobs(period: str, weather_years: str | int | None, model_range: Iterable[int], weather_range: Iterable[int]) -> list[tuple[int, int, int, int]]:
    """(model year, weather year, first hour, last hour), hours from 1; years that the source lacks are refused."""
    asked = sorted(map(interval, _terms(period)))
    weather = years(weather_years, "weather years")
    if not asked:
        raise ValueError("the period is empty")
    one_series = any(series for *_, series in asked)
    if one_series and len(asked) > 1:
        raise ValueError(f"period: a list is of single years of four digits: {period}")
    if not weather:
        raise ValueError(f"weather years are needed; the source has {sorted({*weather_range})}")
    parts = [part for begin, end, _ in asked for part in cut_by_year(begin, end)]
    models = _distinct([y for y, *_ in parts], "period")
    _in_source(models, model_range, "model")
    _in_source(weather, weather_range, "weather")
    if not one_series:
        pairs = product(parts, weather)
    elif len(weather) in (1, len(models)):
        pairs = zip(parts, weather * (len(models) // len(weather)), strict=True)
    else:
        raise ValueError(f"{len(models)} calendar years need 1 or {len(models)} weather years, not {len(weather)}")
    return [(year, w, first, last) for (year, first, last), w in pairs]


def job_table(spark: SparkSession, planned: Sequence[tuple[int, int, int, int]]) -> DataFrame:
    """A row a job, numbered in order."""
    return spark.createDataFrame([(i, *j) for i, j in enumerate(planned)], JOB)


def selected_hours(series: DataFrame, planned: DataFrame) -> DataFrame:
    """Rows of ``series`` (model_year, weather_year, hour from 1, ...) that a job asks for, with the job; jobs are few and broadcast."""
    side = F.broadcast(planned)
    return series.join(side, ["model_year", "weather_year"]).where(F.col("hour").between(F.col("first_hour"), F.col("last_hour"))).drop("first_hour", "last_hour")
