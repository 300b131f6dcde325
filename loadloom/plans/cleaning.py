"""Queries of cleaning functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cleaning as N
from ..functions import scalar as S
from . import fixtures as X
from .registry import query

#: The same text in both dialects: names and codes made from keys.
SPELLED = """CASE p_partkey % 9 WHEN 0 THEN p_name || ' PH' WHEN 1 THEN 'MOUNTAIN ' || p_name WHEN 2 THEN p_name || ' NO ' || CAST(p_size AS VARCHAR(9)) WHEN 3 THEN upper(p_name) || ' ' || chr(CAST(65 + p_partkey % 26 AS INT))
  WHEN 4 THEN p_name || ' (' || p_type || ')' WHEN 5 THEN p_name || ' AND ' || p_brand WHEN 6 THEN 'SF A (' || p_name || ')' WHEN 7 THEN p_name || ' - (PG&E)' ELSE 'P.T. ' || p_name || ' Substation #' || CAST(p_size AS VARCHAR(9)) END"""
RAW_OWNERS = ["PG&E", " PGE ", "SCE", "Assumed PGE", "Assumed SCE", "Assumed NVE", "Assumed by owner", "SDG&E", "SDGE", "SMUD", "IID", "PCORP", "LADWP", "WAPA", "SVP", "VEA", "NVE", "PSREC", "Liberty Utilities", "BV", "PACE", "BPA", "City of PGE", None]


def _parts(s, d):
    return X.read(s, d, "part").withColumn("k", F.col("p_partkey"))


def _pick(values, key="k"):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(key) % len(values) + 1).cast("int"))


def _list(values):
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


@query("unknown_to_null", "SELECT p_partkey AS k, nullif(CASE WHEN p_size % 5 = 0 THEN -99 ELSE p_size END, -99)::DOUBLE AS kv FROM part")
def unknown_to_null(s, d):
    raw = F.when(F.col("p_size") % 5 == 0, -99.0).otherwise(F.col("p_size").cast("double"))
    return _parts(s, d).select("k", N.known(raw).alias("kv"))


KINDS = {"ECONOMY": "eco", "STANDARD": "std", "PROMO": "pro"}


@query("mapped_codes", "SELECT p_partkey AS k, coalesce(MAP {'ECONOMY': 'eco', 'STANDARD': 'std', 'PROMO': 'pro'}[p_type], lower(p_type)) AS code FROM part")
def mapped_codes(s, d):
    return _parts(s, d).select("k", N.mapped(F.col("p_type"), KINDS, F.lower("p_type")).alias("code"))


def _owner_sql(raw: str) -> str:
    whens = []
    for needle, code in N.OWNERS:
        whens += [f"WHEN trim({raw}) = '{w}' THEN '{c}'" for w, (c, before) in N.WHOLE_OWNERS.items() if before == needle]
        whens.append(f"WHEN contains({raw}, '{needle}') THEN '{code}'")
    assumed = " ".join(f"WHEN contains({raw}, '{n}') THEN '{c}'" for n, c in N.ASSUMED)
    return f"CASE WHEN {raw} IS NULL THEN 'unknown' WHEN contains({raw}, 'Assumed') THEN CASE {assumed} ELSE 'other_assumed' END {' '.join(whens)} ELSE 'other' END"


@query("owners", f"WITH x AS (SELECT p_partkey AS k, {_list(RAW_OWNERS)}[(p_partkey % {len(RAW_OWNERS)} + 1)::INT] AS raw FROM part) SELECT k, raw, {_owner_sql('raw')} AS owner FROM x")
def owners(s, d):
    return _parts(s, d).select("k", _pick(RAW_OWNERS).alias("raw")).withColumn("owner", N.owner(F.col("raw")))


RAW_KINDS = ["SUBSTATION", " tap", "RISER", "Dead End", "NOT AVAILABLE", None, "SUBSTATION ASSUMED"]


@query("categories", f"""WITH x AS (SELECT p_partkey AS k, {_list(RAW_KINDS)}[(p_partkey % {len(RAW_KINDS)} + 1)::INT] AS raw FROM part)
  SELECT k, CASE WHEN raw IS NULL OR upper(trim(raw)) = 'NOT AVAILABLE' THEN 'unknown' WHEN upper(trim(raw)) IN ('TAP', 'RISER', 'DEAD END') THEN 'line_structure' ELSE 'substation' END AS category FROM x""")
def categories(s, d):
    return _parts(s, d).select("k", N.category(_pick(RAW_KINDS)).alias("category"))


def _plain_sql(x: str) -> str:
    return rf"""lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim({x}), '\bP\.?\s*T\.?\b', '', 'gi'), '\bsubstation\b', '', 'gi'), '[/\\\-,.&()_#'']', ' ', 'g'), '\s+', ' ', 'g')))"""


@query("plain_names", rf"""WITH x AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 50 <> 0 THEN {SPELLED} END AS name FROM part)
  SELECT k, coalesce({_plain_sql('name')}, '') AS plain, coalesce({_plain_sql(f"regexp_replace(trim(name), '{N.SUFFIXES[4:]}', '', 'i')")}, '') AS base FROM x""")
def plain_names(s, d):
    x = _parts(s, d).select("k", F.expr(f"CASE WHEN p_partkey % 50 <> 0 THEN {SPELLED} END").alias("name"))
    return x.select("k", N.plain_name(F.col("name")).alias("plain"), N.base_name(F.col("name")).alias("base"))


@query("passed_through", r"WITH x AS (SELECT p_partkey AS k, p_name || CASE p_partkey % 4 WHEN 0 THEN ' P.T.' WHEN 1 THEN ' pt' WHEN 2 THEN ' P. T. B' ELSE '' END AS name FROM part) SELECT k, regexp_matches(name, 'p\.?\s*t\.?\s*$', 'i') AS passes FROM x")
def passed_through(s, d):
    name = F.expr("p_name || CASE p_partkey % 4 WHEN 0 THEN ' P.T.' WHEN 1 THEN ' pt' WHEN 2 THEN ' P. T. B' ELSE '' END")
    return _parts(s, d).select("k", S.pass_through(name).alias("passes"))


VARIANTS = r"""v AS (
  SELECT k, name, 'no_n_rule' AS rule, regexp_replace(name, '\bNO\s+(\d+)\b', '\1', 'gi') AS variant FROM x
  UNION ALL SELECT k, name, 'ph_drop', trim(regexp_replace(name, '\s+PH$', '', 'i')) FROM x UNION ALL SELECT k, name, 'pp_drop', trim(regexp_replace(name, '\s+PP$', '', 'i')) FROM x
  UNION ALL SELECT k, name, 'mountain_mt', regexp_replace(name, '\bMOUNTAIN\b', 'Mt.', 'gi') FROM x
  UNION ALL SELECT k, name, 'station_insert', regexp_replace(trim(name), '^(.+?)\s+([A-Z])$', '\1 Station \2') FROM x WHERE regexp_matches(trim(name), '^(.+?)\s+([A-Z])$')
  UNION ALL SELECT k, name, 'letter_drop', trim(regexp_replace(trim(name), '^(.+?)\s+([A-Z])$', '\1')) FROM x WHERE regexp_matches(trim(name), '^(.+?)\s+([A-Z])$')
  UNION ALL SELECT k, name, 'sf_paren', trim(regexp_extract(trim(name), '(?i)^SF\s+[A-Z]\s*\(([^)]+)\)$', 1)) FROM x WHERE regexp_matches(trim(name), '^SF\s+[A-Z]\s*\(([^)]+)\)$', 'i')
  UNION ALL SELECT k, name, 'paren_strip', trim(regexp_replace(name, '\s*\([^)]*\)', '', 'g')) FROM x WHERE trim(regexp_replace(name, '\s*\([^)]*\)', '', 'g')) <> ''
  UNION ALL SELECT k, name, 'numbered_' || n, name || ' ' || n FROM x, range(1, 13) t(n) WHERE NOT regexp_matches(name, '\d')
  UNION ALL SELECT k, name, 'and_ampersand', regexp_replace(name, '\bAND\b', '&', 'gi') FROM x WHERE regexp_matches(name, '\bAND\b', 'i'))"""


@query("spelling_variants", f"WITH x AS (SELECT p_partkey AS k, {SPELLED} AS name FROM part), {VARIANTS} SELECT k, rule, variant FROM v WHERE variant <> name")
def spelling_variants(s, d):
    x = _parts(s, d).select("k", F.expr(SPELLED).alias("name"))
    return x.select("k", F.explode(N.variants(F.col("name"))).alias("v")).select("k", "v.rule", "v.variant")


VOLTS = "CASE p_partkey % 5 WHEN 0 THEN CAST(p_size AS VARCHAR(9)) || '/12 kV' WHEN 1 THEN CAST(p_size AS VARCHAR(9)) || '.5KV' WHEN 2 THEN 'none' WHEN 3 THEN 'x ' || CAST(p_size AS VARCHAR(9)) || '  Kv' END"


@query("voltage_texts", rf"SELECT p_partkey AS k, try_cast(nullif(regexp_extract({VOLTS}, '(\d+\.?\d*)', 1), '') AS DOUBLE) AS token, try_cast(nullif(regexp_extract({VOLTS}, '(?i)([\d.]+)\s*kv', 1), '') AS DOUBLE) AS kv FROM part")
def voltage_texts(s, d):
    return _parts(s, d).select("k", N.voltage_token(F.expr(VOLTS)).alias("token"), N.kilovolts(F.expr(VOLTS)).alias("kv"))


@query("split_cells", "SELECT l_orderkey, l_linenumber, month(l_shipdate)::INT AS month, (l_orderkey % 24)::INT AS hour FROM lineitem")
def split_cells(s, d):
    text = F.concat_ws("_", F.month("l_shipdate"), F.col("l_orderkey") % 24)
    month, hour = N.split_cell(text)
    return X.read(s, d, "lineitem").select("l_orderkey", "l_linenumber", month.alias("month"), hour.alias("hour"))


PATHS = ["raw/2025/Hourly Forecast - PGE - Local_Reliability - Corrected.xlsx", "raw/CED 2023 Hourly Forecast - Sce - Planning Scenario.xlsx", "raw/2024/Hourly Forecast - CAISO - Planning.xlsx", "raw/x/Baseline Forecast - PGE.xlsx", "raw/a/CEDU 2022 Hourly Forecast - SDGE - Planning_Scenario - correction 32025.csv"]
FOUND = "[{'v': 2025, 'u': 'PGE', 's': 'Local_Reliability'}, {'v': 2023, 'u': 'SCE', 's': 'Planning_Scenario'}, NULL, NULL, {'v': 2022, 'u': 'SDGE', 's': 'Planning_Scenario'}]"


@query("forecast_files", f"WITH x AS (SELECT p_partkey AS k, {FOUND}[(p_partkey % 5 + 1)::INT] AS f FROM part) SELECT k, f.v::INT AS vintage, f.u AS utility, f.s AS scenario FROM x")
def forecast_files(s, d):
    return _parts(s, d).select("k", N.forecast_file(_pick(PATHS)).alias("f")).select("k", "f.vintage", "f.utility", "f.scenario")


@query("line_ends", "SELECT p_partkey AS k, p_size::DOUBLE AS from_lon, 1.5::DOUBLE AS from_lat, p_retailprice AS to_lon, 3.0::DOUBLE AS to_lat FROM part")
def line_ends(s, d):
    text = F.format_string("[[[%d, 1.5], [7, 8]], [[0, 0], [%s, 3.0]]]", "p_size", F.col("p_retailprice").cast("string"))
    return _parts(s, d).select("k", N.line_ends(text).alias("e")).select("k", "e.*")


@query("power_units", "SELECT s_suppkey AS k, round(s_acctbal / 1000, 9) AS mw, round(s_acctbal * sqrt(3) * 0.95 * 12.47 / 1000, 6) AS from_amps FROM supplier")
def power_units(s, d):
    return X.read(s, d, "supplier").select(F.col("s_suppkey").alias("k"), F.round(N.kw_to_mw(F.col("s_acctbal")), 9).alias("mw"), F.round(N.amps_to_mw(F.col("s_acctbal"), F.lit(12.47)), 6).alias("from_amps"))


@query("clocks", """SELECT event_id, strftime(date_trunc('hour', ts) - INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') AS pacific, strftime(TIMESTAMP '2012-01-01' + to_hours(event_id % 8760 - 2), '%Y-%m-%d %H:%M:%S') AS from_central, (event_id % 24)::INT AS hour,
  strftime(make_date(2000 + event_id % 20, 1 + event_id % 12, 1 + event_id % 28)::TIMESTAMP + to_hours(event_id % 25), '%Y-%m-%d %H:%M:%S') AS made FROM events""")
def clocks(s, d):
    n = F.col("event_id")
    text = lambda t: F.date_format(t, "yyyy-MM-dd HH:mm:ss")
    made = N.timestamp_of(2000 + (n % 20).cast("int"), 1 + (n % 12).cast("int"), 1 + (n % 28).cast("int"), n % 25)
    central = N.central_to_pacific(F.lit("2012-01-01").cast("timestamp_ntz"), n % 8760)
    return X.read(s, d, "events").select("event_id", text(N.utc_ending_to_standard(F.date_trunc("hour", "ts"))).alias("pacific"), text(central).alias("from_central"), N.hour_beginning((n % 24 + 1).cast("int")).alias("hour"), text(made).alias("made"))


@query("chords", """WITH x AS (SELECT p_partkey AS k, 32 + (p_partkey * 37 % 1000) / 100.0::DOUBLE AS lat, -124 + (p_partkey * 91 % 1000) / 100.0::DOUBLE AS lon FROM part)
  SELECT k, round(cos(radians(lat)) * cos(radians(lon)), 9) AS x, round(cos(radians(lat)) * sin(radians(lon)), 9) AS y, round(sin(radians(lat)), 9) AS z,
  round(2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(lat - 34) / 2), 2) + cos(radians(lat)) * cos(radians(34)) * pow(sin(radians(lon + 118) / 2), 2)))), 4) AS km FROM x""")
def chords(s, d):
    at = X.places(_parts(s, d).select("k"), "k")
    here, there = N.unit_sphere(F.col("lat"), F.col("lon")), N.unit_sphere(F.lit(34.0), F.lit(-118.0))
    return at.select("k", *[F.round(c, 9).alias(n) for c, n in zip(here, "xyz", strict=True)], F.round(N.chord_km(here, there), 4).alias("km"))


@query("encoded_features", """SELECT p_partkey AS k, (p_type = 'ECONOMY')::INT::DOUBLE AS eco, (p_type = 'PROMO')::INT::DOUBLE AS pro, round(sin(p_size * 2 * pi() / 24), 9) AS turn_sin, round(cos(p_size * 2 * pi() / 24), 9) AS turn_cos, round(pow(0.5, p_size / 10.0::DOUBLE), 9) AS weight FROM part""")
def encoded_features(s, d):
    sin, cos = S.cyclic(F.col("p_size"), 24.0)
    eco, pro = N.one_hot(F.col("p_type"), ["ECONOMY", "PROMO"])
    return _parts(s, d).select("k", eco.alias("eco"), pro.alias("pro"), F.round(sin, 9).alias("turn_sin"), F.round(cos, 9).alias("turn_cos"), F.round(N.decay(F.col("p_size"), 10.0), 9).alias("weight"))
