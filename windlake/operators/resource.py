"""Wind resource assessment: density, shear, energy, uncertainty, and the site table."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from windlake.functions import physics as P
from windlake.operators.curves import interpolate
from windlake.operators.weibull import fit_mle

#: The uncertainty items of a yield assessment and their standard deviations.
UNCERTAINTY = [
    ("interannual variability", 0.06), ("measurement representativeness", 0.05), ("long-term correction", 0.04), ("extrapolation", 0.04),
    ("power curve", 0.05), ("wake model", 0.04), ("availability", 0.03), ("electrical losses", 0.02),
]
TOTAL_SIGMA = math.sqrt(sum(s * s for _, s in UNCERTAINTY))


def power_density_observed(df: DataFrame, col: str, rho: float = 1.225, by: str = "zone") -> DataFrame:
    """wpd: half the density times the mean cube of finite speeds."""
    v = F.when(F.abs(F.col(col)) < float("inf"), F.col(col))
    return df.groupBy(by).agg((F.avg(v * v * v) * (0.5 * rho)).alias("wpd"))


def mean_shear(df: DataFrame, by: str = "zone", shear: str = "shear") -> DataFrame:
    """Mean exponent of each station and, in the row with a NULL station, of all rows."""
    return df.rollup(by).agg(F.avg(shear).alias("alpha"))


def speed_bins(spark: SparkSession, v_max: float = 25.0, dv: float = 0.2) -> DataFrame:
    """Middles of the speed bins: 125 rows by default, whatever the data."""
    return spark.range(round((v_max - dv / 2) / dv + 0.4999)).select((F.lit(dv / 2) + F.col("id") * dv).alias("v_mid"))


def aep_detail(spark: SparkSession, params: DataFrame, capacity_mw: float = 1.0, hours: float = 8760.0, v_max: float = 25.0, dv: float = 0.2, k: str = "k", c: str = "c", by: str = "zone", curve: DataFrame | None = None) -> DataFrame:
    """Energy of each station and speed bin: its frequency by the Weibull density, the power, the energy. ``curve`` (x speed,
    y power of a turbine in shares of its capacity) is a turbine's own; 0 beyond its ends. Without one, the typical curve."""
    bins = speed_bins(spark, v_max, dv)
    bins = F.broadcast(bins.withColumn("p_norm", _curve_at("v_mid")) if curve is None else interpolate(bins, "v_mid", curve, "p_norm", left=0.0, right=0.0))
    d = params.select(by, F.col(k).alias("k"), F.col(c).alias("c")).crossJoin(bins)
    d = d.withColumn("frequency", P.weibull_pdf("v_mid", "k", "c") * dv)
    return d.select(by, "v_mid", "frequency", "p_norm", (F.col("p_norm") * capacity_mw).alias("p_mw"), (hours * capacity_mw * F.col("p_norm") * F.col("frequency")).alias("energy_mwh"))


def _curve_at(v: str, n: int = 200):
    """The typical curve as its n even points give it by linear interpolation; 0 beyond its ends."""
    step = 30.0 / (n - 1.0)
    i = F.floor(F.col(v) / step)
    lo, hi = i * F.lit(30.0) / F.lit(n - 1.0), (i + 1) * F.lit(30.0) / F.lit(n - 1.0)
    y0, y1 = P.typical_power(lo), P.typical_power(hi)
    return F.when((F.col(v) < 0) | (F.col(v) > 30), 0.0).otherwise(y0 + (y1 - y0) * (F.col(v) - lo) / (hi - lo))


def aep(spark: SparkSession, params: DataFrame, capacity_mw: float = 1.0, by: str = "zone", **kw) -> DataFrame:
    """capacity_factor (no unit) and aep_mwh of each station."""
    d = aep_detail(spark, params, capacity_mw, by=by, **kw)
    cf = F.sum(F.col("p_norm") * F.col("frequency"))
    return d.groupBy(by).agg(cf.alias("capacity_factor"), F.sum("energy_mwh").alias("aep_mwh"))


def top_bins(detail: DataFrame, n: int = 8, by: str = "zone") -> DataFrame:
    """The n speed bins with most energy of each station."""
    order = Window.partitionBy(by).orderBy(F.desc("energy_mwh"), "v_mid")
    return detail.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def uncertainty_budget(spark: SparkSession, items: list[tuple[str, float]] = UNCERTAINTY) -> DataFrame:
    """item, sigma, variance_share_pct, total_sigma: independent items add in squares."""
    total = math.sqrt(sum(s * s for _, s in items))
    d = spark.createDataFrame(items, "item string, sigma double")
    return d.withColumn("variance_share_pct", F.col("sigma") * F.col("sigma") / (total * total) * 100).withColumn("total_sigma", F.lit(total))


def wind_resource_report(spark: SparkSession, df: DataFrame, ws: str = "ws100", hub_height: float = 100.0, z_obs: float = 100.0, capacity_mw: float = 1.0, by: str = "zone", alpha: float = 0.143, curve: DataFrame | None = None, beyond: str = "moments") -> DataFrame:
    """One row for each station (``curve`` as in aep_detail, ``beyond`` as in fit_mle): fits, density, grade, hub values, capacity factor, P50, P75, P90, unrounded."""
    rho = P.STANDARD_DENSITY
    fits = fit_mle(spark, df, ws, [by], beyond)
    v = F.when(F.abs(F.col(ws)) < float("inf"), F.col(ws))
    base = df.groupBy(by).agg(F.count(v).alias("n"), F.avg(v).alias("mean_ws"), (F.avg(v * v * v) * (0.5 * rho)).alias("wpd"))
    r = base.join(fits, by).withColumn("c_hub", F.col("c_mle") * (hub_height / z_obs) ** alpha)
    energy = aep(spark, r, capacity_mw, by, k="k_mle", c="c_hub", curve=curve)
    r = r.withColumns({"wpd_weibull": P.wind_power_density_weibull("k_mle", "c_mle", rho), "wpd_hub": P.wind_power_density_weibull("k_mle", "c_hub", rho), "grade": P.grade("wpd")})
    return r.join(energy, by).withColumns(P.p_values("aep_mwh", TOTAL_SIGMA)).drop("aep_mwh")


def site_resource_table(spark: SparkSession, df: DataFrame, hub: float = 100.0, capacity_mw: float = 50.0, by: str = "zone", curve: DataFrame | None = None, beyond: str = "moments") -> DataFrame:
    """One row for each station (``beyond`` as in fit_mle). Hub speeds come from 100 m by the station's own mean shear; the grade from 10 m."""
    shear = df.groupBy(by).agg(F.avg("shear").alias("shear_alpha"), F.avg("ws10").alias("ws10_mean"))
    d = df.join(shear.select(by, "shear_alpha"), by).withColumn("ws_hub", P.extrapolate_shear("ws100", 100.0, hub, "shear_alpha"))
    hub_rows = wind_resource_report(spark, d, "ws_hub", hub, hub, capacity_mw, by, curve=curve, beyond=beyond)
    low = power_density_observed(df, "ws10", P.STANDARD_DENSITY, by).select(by, F.col("wpd").alias("wpd10"))
    r = hub_rows.join(low, by).join(shear, by)
    return r.select(
        by, "ws10_mean", F.col("mean_ws").alias("ws_hub_mean"), F.col("k_mle").alias("k"), F.col("c_mle").alias("c"), "shear_alpha", "wpd10",
        P.grade("wpd10").alias("grade"), F.col("wpd").alias("wpd_hub"), "capacity_factor", "p50", "p75", "p90",
    )


def resource_totals(table: DataFrame) -> DataFrame:
    return table.agg(F.avg("ws_hub_mean").alias("ws_hub_mean"), F.avg("wpd_hub").alias("wpd_hub"), F.avg("capacity_factor").alias("capacity_factor"), F.sum("p50").alias("p50_total"))
