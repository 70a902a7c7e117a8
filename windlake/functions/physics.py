"""Scalar physics as column expressions. Missing is NULL everywhere; NaN is turned into NULL when data is read."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from windlake.functions.special import gamma

C = Column | str


def col(x: C) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean(x: C) -> Column:
    """NaN to NULL."""
    return F.when(~F.isnan(col(x)), col(x))


def wind_speed(u: C, v: C) -> Column:
    u, v = col(u), col(v)
    return F.sqrt(u * u + v * v)


def wind_direction(u: C, v: C) -> Column:
    """Where the wind comes from, in degrees of [0, 360), north 0, clockwise. Calm (0, 0) is 180, as floating-point atan2 of two negative zeros gives."""
    u, v = col(u), col(v)
    return F.when((u == 0) & (v == 0), F.lit(180.0)).otherwise(F.pmod(F.degrees(F.atan2(-u, -v)), F.lit(360.0)))


def shear_exponent(hi: C, lo: C, z_hi: float = 100.0, z_lo: float = 10.0) -> Column:
    """Exponent of the power law between two heights; NULL if either speed is 0."""
    return F.ln(F.nullif(col(hi), F.lit(0.0)) / F.nullif(col(lo), F.lit(0.0))) / F.lit(math.log(z_hi / z_lo))


shear_from_two_levels = shear_exponent


def extrapolate_shear(v: C, z_ref: float, z_target: float, alpha: C | float) -> Column:
    return col(v) * F.pow(F.lit(z_target / z_ref), F.lit(alpha) if isinstance(alpha, float) else col(alpha))


def air_density_correction(ws: C, temp_c: C | None = None) -> Column:
    if temp_c is None:
        return col(ws)
    return col(ws) * F.pow(F.lit(273.15) / (F.lit(273.15) + col(temp_c)), F.lit(1.0 / 3.0))


def air_density(temp_c: C | float = 15.0, p_hpa: C | float = 1013.25) -> Column:
    t, p = (F.lit(x) if isinstance(x, float) else col(x) for x in (temp_c, p_hpa))
    return p * 100.0 / (F.lit(287.05) * (t + 273.15))


#: Density of the standard atmosphere, from the formula above.
STANDARD_DENSITY = 1013.25 * 100.0 / (287.05 * (15.0 + 273.15))


def time_features(ts: C) -> dict[str, Column]:
    ts = col(ts)
    hour, doy, turn = F.hour(ts), F.dayofyear(ts), 2 * math.pi
    return {
        "hour": hour,
        "dayofyear": doy,
        "month": F.month(ts),
        "hour_sin": F.sin(turn * hour / 24),
        "hour_cos": F.cos(turn * hour / 24),
        "doy_sin": F.sin(turn * doy / 365),
        "doy_cos": F.cos(turn * doy / 365),
    }


def clip01(x: C) -> Column:
    """Into [0, 1]; NULL stays NULL."""
    x = col(x)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def weibull_pdf(v: C, k: C, c: C) -> Column:
    v, k, c = col(v), col(k), col(c)
    return k / c * F.pow(v / c, k - 1) * F.exp(-F.pow(v / c, k))


def weibull_cdf(v: C, k: C, c: C) -> Column:
    return 1.0 - F.exp(-F.pow(col(v) / col(c), col(k)))


def weibull_mean(k: C, c: C) -> Column:
    return col(c) * gamma(1.0 + 1.0 / col(k))


def wind_power_density_weibull(k: C, c: C, rho: float = 1.225) -> Column:
    return 0.5 * rho * F.pow(col(c), F.lit(3.0)) * gamma(1.0 + 3.0 / col(k))


#: Lower bounds of the seven wind power density grades at 10 m, W/m2.
GRADE_BOUNDS = (0, 100, 150, 200, 250, 300, 400)
GRADE_TEXT = ("poor", "fair", "usable", "good", "very good", "excellent", "outstanding")


def grade(wpd: C) -> Column:
    wpd, out = col(wpd), F.lit(None).cast("int")
    for i, lo in enumerate(GRADE_BOUNDS):
        out = F.when(wpd >= lo, i + 1).otherwise(out)
    return F.when(~F.isnan(wpd), out)


def grade_text(wpd: C) -> Column:
    g, out = grade(wpd), F.lit("cannot grade")
    for i, text in enumerate(GRADE_TEXT, 1):
        out = F.when(g == i, text).otherwise(out)
    return out


def p_values(p50: C, sigma: float) -> dict[str, Column]:
    """Energy exceeded in 50, 75 and 90 years of 100, by the normal quantiles 0.6745 and 1.2816."""
    return {"p50": col(p50), "p75": col(p50) * (1 - 0.6745 * sigma), "p90": col(p50) * (1 - 1.2816 * sigma)}


def typical_power(v: C, v_rated: float = 12.0, v_in: float = 3.0, v_out: float = 25.0) -> Column:
    v = col(v)
    ramp = (v * v * v - v_in**3) / (v_rated**3 - v_in**3)
    return F.when(v < v_in, 0.0).when(v <= v_rated, ramp).when(v < v_out, 1.0).when(v >= v_out, 0.0)
