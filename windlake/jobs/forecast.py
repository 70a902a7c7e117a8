"""Power forecasting: stations to feature table, time split, experiments with and without history, result tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from windlake.operators import features, models, quality
from windlake.operators.trees import TreeSettings
from windlake.operators.history import CHUNK_HOURS
from windlake.sources.scratch import Scratch
from windlake.sources.stations import write_report


def run(spark: SparkSession, stations: DataFrame, out: str, test_ratio: float = 0.3, learners: Sequence[str] = ("ridge", "gbt"), ts: str = "timestamp", settings: TreeSettings = TreeSettings()) -> dict[str, DataFrame]:
    """Raises on repeated keys. Then writes overview, missing, and for both experiments metrics, errors by speed, the trees' nodes
    and ranked importance, and what the learners gain, under ``out``; returns them as read back.

    The feature table is written once and read by every model.
    """
    d = stations.withColumnRenamed(ts, "ts")
    quality.assert_unique(d)
    table = Scratch(spark, "forecast").put(features.build_features(d, chunk_hours=CHUNK_HOURS), "features")
    train, test, _ = models.split_by_time(table, test_ratio)
    results = {"overview": quality.dataset_overview(d), "missing": quality.missing_report(d)}
    for name, run_it, baseline in (("a", models.experiment_a, "power curve"), ("b", models.experiment_b, "persistence")):
        e = run_it(spark, train, test, learners, settings)
        results |= {f"experiment_{name}": e.table, f"experiment_{name}_bins": e.errors}
        results[f"delta_{name}"] = reduce(DataFrame.unionAll, (models.experiment_delta(e.table, x, baseline) for x in learners))
        if e.nodes is not None:
            results |= {f"trees_{name}": e.nodes, f"importance_{name}": e.importance}
    for name, df in results.items():
        write_report(df, f"{out}/{name}", "parquet")
    return {name: spark.read.parquet(f"{out}/{name}") for name in results}
