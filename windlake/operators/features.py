"""The feature table: physical, calendar and history columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windlake.functions import physics as P
from windlake.operators.history import chunk_order, with_halo

FEATURES = ["u10", "v10", "u100", "v100", "ws10", "ws100", "wd10", "wd100", "shear", "hour_sin", "hour_cos", "doy_sin", "doy_cos"]
LAG_FEATURES = ["power_lag1", "power_lag2", "power_lag24", "power_roll3", "power_roll24"]


def drop_missing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(cols))


def with_speeds(df: DataFrame) -> DataFrame:
    return df.withColumns({"ws10": P.wind_speed("u10", "v10"), "ws100": P.wind_speed("u100", "v100")})


def rolling_mean_prior(col: str, n: int, order: Window) -> Column:
    """Mean of the n rows before this one; NULL unless all n have a value."""
    frame = order.rowsBetween(-n, -1)
    return F.when(F.count(col).over(frame) == n, F.avg(col).over(frame))


def lag_features(df: DataFrame, col: str = "power", lags: Sequence[int] = (1, 2, 24), means: Sequence[int] = (3, 24), station: str = "zone", ts: str = "ts", chunk_hours: int | None = None, parts: int | None = None) -> DataFrame:
    """Row-based history of each station (one shared window, so one sort); with gaps a lag isn't a fixed time.

    With ``chunk_hours`` (and ``parts``, as in with_halo) a task holds a station's chunk of time and the rows before it that the lags need, and the result is
    the same. Of rows that repeat a station and time the order is open; an empty table stays empty; columns named as the
    new ones are replaced.
    """
    if chunk_hours:
        df, order = with_halo(df, [col], max(*lags, *means), station, ts, chunk_hours, parts), chunk_order(station, ts)
    else:
        order = Window.partitionBy(station).orderBy(ts)
    new = {f"{col}_lag{n}": F.lag(col, n).over(order) for n in lags}
    out = df.withColumns(new | {f"{col}_roll{n}": rolling_mean_prior(col, n, order) for n in means})
    return out.where("not _halo").drop("_halo", "_chunk") if chunk_hours else out


def lag_by_time(df: DataFrame, col: str, hours: int, station: str = "zone", ts: str = "ts") -> DataFrame:
    """The value exactly ``hours`` earlier, by a self-join on time; NULL in gaps. Keys (station, time) must be unique: a key that
    repeats gives a row for each of the values earlier. An empty table stays empty."""
    past = df.select(station, F.timestamp_add("HOUR", F.lit(hours), F.col(ts)).alias(ts), F.col(col).alias(f"{col}_{hours}h"))
    return df.join(past, [station, ts], "left")


def build_features(df: DataFrame, add_lag: bool = True, ts: str = "ts", station: str = "zone", chunk_hours: int | None = None) -> DataFrame:
    """Speeds, directions, shear and calendar columns, and with ``add_lag`` the history (``chunk_hours`` as in lag_features)."""
    d = with_speeds(df).withColumns({"wd10": P.wind_direction("u10", "v10"), "wd100": P.wind_direction("u100", "v100"), "shear": P.shear_exponent("ws100", "ws10")} | P.time_features(ts))
    return lag_features(d, station=station, ts=ts, chunk_hours=chunk_hours) if add_lag else d
