"""Column functions that clean sources: sentinels, codes, names, voltages, units, clocks and places."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import EARTH_KM

#: What an owner's raw name contains, in the order in which it counts, and the owner.
OWNERS = (("PG&E", "pge"), ("SCE", "sce"), ("SDG&E", "sdge"), ("SDGE", "sdge"), ("SMUD", "smud"), ("IID", "iid"), ("PCORP", "pacificorp"), ("LADWP", "ladwp"), ("WAPA", "wapa"), ("SVP", "svp"), ("VEA", "vea"), ("NVE", "nve"), ("PSREC", "psrec"), ("Liberty", "liberty"), ("PACE", "pace"), ("BPA", "bpa"))
#: Raw names that count only as a whole, with the rule before which they do.
WHOLE_OWNERS = {"PGE": ("pge", "SCE"), "BV": ("bv", "PACE")}
#: Owners whose names are marked as assumed.
ASSUMED = (("PGE", "pge_assumed"), ("SCE", "sce_assumed"), ("NVE", "nve_assumed"))
#: Types that are parts of lines.
STRUCTURES = ("TAP", "RISER", "DEAD END")
#: Owners that follow a name after a dash.
SUFFIXES = r"(?i)\s*-\s*\(?\s*(pg&e|pge|sce|sdg&e|sdge|smud|iid|ladwp|pcorp|wapa|svp|vea|nve)\b.*$"
POWER_FACTOR = 0.95


def known(x: Column, sentinel: float = -99.0) -> Column:
    """Null for the value that stands for unknown."""
    return F.when(x != sentinel, x)


def mapped(x: Column, values: Mapping[str, str], default: Column | None = None) -> Column:
    """Codes by a small fixed dictionary; others have the default, or null."""
    pairs = F.create_map(*[F.lit(v) for pair in values.items() for v in pair])
    found = F.try_element_at(pairs, x)
    return found if default is None else F.coalesce(found, default)


def owner(raw: Column) -> Column:
    """The owner by the first rule that the raw name meets; null is "unknown", none "other"."""
    assumed = F.lit("other_assumed")
    for needle, code in reversed(ASSUMED):
        assumed = F.when(raw.contains(needle), code).otherwise(assumed)
    out = F.lit("other")
    for needle, code in reversed(OWNERS):
        out = F.when(raw.contains(needle), code).otherwise(out)
        for whole, (name, before) in WHOLE_OWNERS.items():
            if needle == before:
                out = F.when(F.trim(raw) == whole, name).otherwise(out)
    return F.when(raw.isNull(), "unknown").when(raw.contains("Assumed"), assumed).otherwise(out)


def category(kind: Column) -> Column:
    """substation, line_structure or unknown."""
    t = F.upper(F.trim(kind))
    return F.when(kind.isNull() | (t == "NOT AVAILABLE"), "unknown").when(t.isin(*STRUCTURES), "line_structure").otherwise("substation")


def plain_name(name: Column) -> Column:
    """Lower case, P.T. anywhere and "substation" left out, punctuation as spaces; "" for null."""
    out = F.regexp_replace(F.trim(name), r"(?i)\bP\.?\s*T\.?\b", "")
    out = F.regexp_replace(F.regexp_replace(out, r"(?i)\bsubstation\b", ""), r"[/\\\-,.&()_#']", " ")
    return F.coalesce(F.lower(F.trim(F.regexp_replace(out, r"\s+", " "))), F.lit(""))


def base_name(name: Column) -> Column:
    """The same without a trailing owner."""
    return plain_name(F.regexp_replace(F.trim(name), SUFFIXES, ""))


def variants(name: Column) -> Column:
    """An array of (rule, variant): other spellings under which a source may know the name, where a rule changes it."""
    bare = F.trim(name)
    sub = lambda pattern, to: F.regexp_replace(name, pattern, to)
    has = lambda pattern: name.rlike(pattern)
    made: list[tuple[str, Column, Column | None]] = [
        ("no_n_rule", sub(r"(?i)\bNO\s+(\d+)\b", "$1"), None),
        ("ph_drop", F.trim(sub(r"(?i)\s+PH$", "")), None),
        ("pp_drop", F.trim(sub(r"(?i)\s+PP$", "")), None),
        ("mountain_mt", sub(r"(?i)\bMOUNTAIN\b", "Mt."), has(r"(?i)\bMOUNTAIN\b")),
        ("station_insert", F.regexp_replace(bare, r"^(.+?)\s+([A-Z])$", "$1 Station $2"), bare.rlike(r"^(.+?)\s+([A-Z])$")),
        ("letter_drop", F.trim(F.regexp_replace(bare, r"^(.+?)\s+([A-Z])$", "$1")), bare.rlike(r"^(.+?)\s+([A-Z])$")),
        ("sf_paren", F.trim(F.regexp_extract(bare, r"(?i)^SF\s+[A-Z]\s*\(([^)]+)\)$", 1)), bare.rlike(r"(?i)^SF\s+[A-Z]\s*\(([^)]+)\)$")),
        ("paren_strip", F.trim(sub(r"\s*\([^)]*\)", "")), F.trim(sub(r"\s*\([^)]*\)", "")) != ""),
        *[(f"numbered_{n}", F.concat(name, F.lit(f" {n}")), ~has(r"\d")) for n in range(1, 13)],
        ("and_ampersand", sub(r"(?i)\bAND\b", "&"), has(r"(?i)\bAND\b")),
    ]
    rows = [F.when((variant != name) if fits is None else (fits & (variant != name)), F.struct(F.lit(rule).alias("rule"), variant.alias("variant"))) for rule, variant, fits in made]
    return F.array_compact(F.array(*rows))


def voltage_token(text: Column) -> Column:
    """The first number of a text such as 115/12 kV."""
    return F.regexp_extract(text, r"(\d+\.?\d*)", 1).try_cast("double")


def kilovolts(text: Column) -> Column:
    """The number before kV; null where there is none."""
    return F.regexp_extract(text, r"(?i)([\d.]+)\s*kv", 1).try_cast("double")


def split_cell(text: Column) -> tuple[Column, Column]:
    """Month and hour of a text such as 7_18."""
    parts = F.split(text, "_")
    return F.get(parts, F.lit(0)).try_cast("int"), F.get(parts, F.lit(1)).try_cast("int")


def forecast_file(path: Column) -> Column:
    """(vintage, utility, scenario) of an hourly forecast's path; null where it is none, or is of the whole system."""
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")
    folder = F.substring_index(F.substring_index(path, "/", -2), "/", 1)
    vintage = F.when(folder.rlike(r"^\d{4}$"), folder).otherwise(F.regexp_extract(stem, r"(?i)CEDU?\s+(\d{4})", 1)).try_cast("int")
    shape = r"(?i)Hourly Forecast - ([A-Za-z]+) - (.+)"
    utility = F.upper(F.regexp_extract(stem, shape, 1))
    scenario = F.replace(F.trim(F.substring_index(F.trim(F.regexp_extract(stem, shape, 2)), " - ", 1)), F.lit(" "), F.lit("_"))
    return F.when(vintage.isNotNull() & (utility != "") & (utility != "CAISO"), F.struct(vintage.alias("vintage"), utility.alias("utility"), scenario.alias("scenario")))


def line_ends(paths: Column) -> Column:
    """First and last point (lon, lat) of a polyline in JSON: lists of points by part."""
    parsed = F.from_json(paths, "array<array<array<double>>>")
    start, end = F.get(F.get(parsed, F.lit(0)), F.lit(0)), F.try_element_at(F.try_element_at(parsed, F.lit(-1)), F.lit(-1))
    at = lambda p, i: F.get(p, F.lit(i))
    return F.struct(at(start, 0).alias("from_lon"), at(start, 1).alias("from_lat"), at(end, 0).alias("to_lon"), at(end, 1).alias("to_lat"))


def kw_to_mw(kw: Column) -> Column:
    return kw / 1000


def amps_to_mw(amps: Column, kv: Column) -> Column:
    """Three phases at the usual power factor."""
    return amps * (math.sqrt(3) * POWER_FACTOR) * kv / 1000


def utc_ending_to_standard(t: Column) -> Column:
    """The hour that ends at ``t`` in UTC, as the hour that begins in Pacific standard time."""
    return t - F.expr("INTERVAL 9 HOURS")


def central_to_pacific(start: Column, index: Column) -> Column:
    """The hour with a number within a year that begins at ``start`` in Central standard time, in Pacific standard time."""
    return F.timestamp_add("HOUR", (index - 2).cast("int"), start)


def hour_beginning(ending: Column) -> Column:
    """0 to 23 for 1 to 24."""
    return ending - 1


def timestamp_of(year: Column, month: Column, day: Column, hour: Column) -> Column:
    """From hours 0 to 23, or 24 for the next day's first."""
    return F.timestamp_add("HOUR", hour.cast("int"), F.make_date(year, month, day).cast("timestamp_ntz"))


def unit_sphere(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    return F.cos(F.radians(lat)) * F.cos(F.radians(lon)), F.cos(F.radians(lat)) * F.sin(F.radians(lon)), F.sin(F.radians(lat))


def chord_km(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Kilometres along the surface between two points of the unit sphere, from the chord between them."""
    chord = F.sqrt(sum((x - y) * (x - y) for x, y in zip(a, b, strict=True)))
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), chord / 2))


def one_hot(x: Column, values: Sequence[str]) -> list[Column]:
    """A column of 0 and 1 for each value; all 0 for others and for null."""
    return [F.coalesce((x == v).cast("double"), F.lit(0.0)) for v in values]


def decay(age_days: Column, half_life: float) -> Column:
    return F.pow(F.lit(0.5), age_days / half_life)
