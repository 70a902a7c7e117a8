"""Forecast metrics, for all models in one aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def regression_metrics(df: DataFrame, y: str = "power", pred: str = "pred", by: Sequence[str] = ("model",), capacity: float = 1.0, tol: float = 0.25) -> DataFrame:
    """rmse, mae, r2 (NULL if the truth is constant, judged by its ends: a variance added up from parts may miss 0), accuracy_pct, qualified_pct over rows that have both values."""
    e = F.col(y) - F.col(pred)
    d = df.where(F.col(y).isNotNull() & F.col(pred).isNotNull())
    m = d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(e * e).alias("sse"), F.avg(F.abs(e)).alias("mae"), F.when(F.max(y) > F.min(y), F.var_pop(y) * F.count(F.lit(1))).alias("sst"), F.avg((F.abs(e) <= tol * capacity).cast("double")).alias("ok")
    )
    rmse = F.sqrt(F.col("sse") / F.col("n"))
    return m.select(
        *by,
        F.round(rmse, 4).alias("rmse"),
        F.round("mae", 4).alias("mae"),
        F.when(F.col("sst") > 0, F.round(1 - F.col("sse") / F.nullif("sst", F.lit(0.0)), 4)).alias("r2"),
        F.round((1 - rmse / capacity) * 100, 2).alias("accuracy_pct"),
        F.round(F.col("ok") * 100, 2).alias("qualified_pct"),
    )


def ranked(metrics: DataFrame) -> DataFrame:
    """Best accuracy first, ties by name."""
    return metrics.orderBy(F.desc("accuracy_pct"), "model")


def error_by_wind_bin(df: DataFrame, ws: str = "ws100", y: str = "power", pred: str = "pred", bins: Sequence[float] = (0, 3, 6, 9, 12, 25), least: int = 10) -> DataFrame:
    """wind_bin (lo, hi], n, rmse, mean_power; bins with fewer than ``least`` rows are left out."""
    name = F.lit(None).cast("string")
    for lo, hi in zip(bins, bins[1:]):
        name = F.when((F.col(ws) > lo) & (F.col(ws) <= hi), F.lit(f"({lo}, {hi}]")).otherwise(name)
    e = F.col(y) - F.col(pred)
    g = df.withColumn("wind_bin", name).where("wind_bin is not null").groupBy("wind_bin")
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.sqrt(F.avg(e * e)), 4).alias("rmse"), F.round(F.avg(y), 4).alias("mean_power")).where(F.col("n") >= least)
