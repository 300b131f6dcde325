"""Column functions of the domain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
#: The 0.9 quantile of the standard normal distribution.
Z90 = 1.2815515655446004
#: Acklam's rational approximation of the normal quantile.
ACKLAM_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
ACKLAM_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
ACKLAM_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
ACKLAM_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
#: Hart's rational approximation of the normal distribution function, as given by West.
HART_A = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
HART_B = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
#: Voltage classes and the limits between them.
VOLTAGES, LIMITS = (66, 115, 230, 500), (87.1, 162.6, 339.1)


def _horner(x, coefficients):
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_quantile(p: Column) -> Column:
    """Null outside (0, 1)."""
    low = 0.02425
    q, r = p - 0.5, (p - 0.5) * (p - 0.5)
    middle = _horner(r, ACKLAM_A) * q / (_horner(r, ACKLAM_B) * r + 1)
    tail = lambda t: _horner(t, ACKLAM_C) / (_horner(t, ACKLAM_D) * t + 1)
    lower, upper = tail(F.sqrt(-2 * F.ln(p))), -tail(F.sqrt(-2 * F.ln(1 - p)))
    return F.when((p > 0) & (p < low), lower).when((p >= low) & (p <= 1 - low), middle).when((p > 1 - low) & (p < 1), upper)


def normal_cdf(x: Column) -> Column:
    a = F.abs(x)
    near = _horner(a, HART_A) / _horner(a, HART_B)
    far = a + 0.65
    for i in (4.0, 3.0, 2.0, 1.0):
        far = a + i / far
    tail = F.exp(-a * a / 2) * F.when(a < 7.07106781186547, near).otherwise(1 / far / 2.506628274631)
    return F.when(x > 0, 1 - tail).otherwise(tail)


def hash_uniform(*parts: Column) -> Column:
    """A number in (0, 1) that depends on its parts only, not on how rows are dealt."""
    digits = F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(2**52)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.when(a > 1, 1.0).otherwise(a)))  # null where a coordinate is


def voltage_class(kv: Column) -> Column:
    out = F.lit(VOLTAGES[-1])
    for limit, v in zip(reversed(LIMITS), reversed(VOLTAGES[:-1]), strict=True):
        out = F.when(kv < limit, v).otherwise(out)
    return F.when(kv.isNotNull(), out)


def wall_clock_to_standard(month: Column, hour: Column) -> Column:
    """Hours of March to October one earlier, within 0 to 23."""
    return F.when(month.between(3, 10), F.pmod(hour - 1, F.lit(24))).otherwise(hour)


def normal_name(name: Column) -> Column:
    """Lower case, without "substation", a trailing P.T., punctuation and spaces."""
    out = F.regexp_replace(F.lower(F.trim(name)), r"\s*\(?p\.?\s*t\.?\)?\s*$", "")
    return F.regexp_replace(F.regexp_replace(out, r"\bsub(station)?\b", ""), r"[^a-z0-9]", "")


def pass_through(name: Column) -> Column:
    return name.rlike(r"(?i)p\.?\s*t\.?\s*$")


def clipped(x: Column) -> Column:
    return F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))


def cell(month: Column, hour: Column) -> Column:
    return ((month - 1) * 24 + hour).cast("int")


def season(month: Column) -> Column:
    """0 to 3: winter (from December), spring, summer, autumn."""
    return F.floor(F.pmod(month, F.lit(12)) / 3).cast("int")


def half_year(month: Column) -> Column:
    """1 for April to September."""
    return month.between(4, 9).cast("int")


def cyclic(x: Column, period: float) -> tuple[Column, Column]:
    turn = x * (6.283185307179586 / period)
    return F.sin(turn), F.cos(turn)
