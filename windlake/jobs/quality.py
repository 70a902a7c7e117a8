"""Data quality and independence of stations, and the leakage that shared data causes in folds by station."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from windlake.operators import features, independence, quality, validation
from windlake.operators.history import CHUNK_HOURS
from windlake.sources.scratch import Scratch
from windlake.sources.stations import write_report


def run(spark: SparkSession, stations: DataFrame, out: str, ts: str = "timestamp", tol: float = 0.0, learner: str = "ridge", **gbt) -> dict[str, DataFrame]:
    """Raises on repeated keys; then writes and returns every report table."""
    d = stations.withColumnRenamed(ts, "ts")
    quality.assert_unique(d)
    d = Scratch(spark, "quality").put(features.build_features(d, add_lag=False), "features")
    results = {"station_qc": quality.station_qc_table(d, chunk_hours=CHUNK_HOURS)} | independence.independence_report(spark, d, tol=tol)
    groups = independence.near_duplicate_groups(spark, d, tol) if tol > 0 else independence.exact_duplicate_groups(d)
    groups = Scratch(spark, "quality").put(groups, "groups")
    test = validation.controlled_leakage_test(spark, d, groups, learner=learner, **gbt)
    results["leakage"] = validation.relative_overestimate(validation.leakage_verdict(test))
    for name, folds in (("folds_by_station", validation.station_folds(d, groups)), ("folds_by_group", validation.group_folds(d, groups))):
        results[name] = validation.fold_rmse(spark, d, folds, learner=learner, **gbt)
    for name, df in results.items():
        write_report(df, f"{out}/{name}", "parquet")
    return {name: spark.read.parquet(f"{out}/{name}") for name in results}
