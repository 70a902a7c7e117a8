"""Folds by station and by group, and the controlled test of leakage between stations that share data.

With ridge, a training set is the total of stations' moment blocks less some: all folds and all controlled runs take one
scan for the blocks and one for the test errors, and are solved in tasks. With trees, all runs grow together.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from windlake.functions.physics import clip01
from windlake.operators.features import FEATURES, drop_missing
from windlake.operators.models import Moments, moment_blocks, ridge_from_moments
from windlake.operators.trees import LEAKAGE, TreeSettings, run_errors
from windlake.sources.scratch import Scratch


def exclude_stations(df: DataFrame, stations: DataFrame, station: str = "zone") -> DataFrame:
    """All rows but those of the listed stations (one column)."""
    gone = stations.toDF("_s")
    return df.join(gone, df[station] == gone["_s"], "left_anti")


def control_stations(df: DataFrame, groups: DataFrame, station: str = "zone") -> DataFrame:
    """Stations that are in no duplicate group."""
    return df.select(F.col(station).alias("station")).distinct().join(groups.select("station"), "station", "left_anti")


def station_folds(df: DataFrame, groups: DataFrame, station: str = "zone") -> DataFrame:
    """fold, held_out, test_rows, train_has_partner, stations (the held-out ones): one station held out in each fold."""
    return _folds(df, groups, station, by_group=False)


def group_folds(df: DataFrame, groups: DataFrame, station: str = "zone") -> DataFrame:
    """The same with whole duplicate groups held out; no partner is ever left in training."""
    return _folds(df, groups, station, by_group=True)


def _folds(df: DataFrame, groups: DataFrame, station: str, by_group: bool) -> DataFrame:
    n = df.groupBy(F.col(station).alias("station")).agg(F.count(F.lit(1)).alias("rows")).join(groups, "station", "left")
    unit = F.coalesce("group_id", "station") if by_group else F.col("station")
    partner = F.lit(0) if by_group else F.max(F.col("group_id").isNotNull().cast("int"))
    f = n.groupBy(unit.alias("unit")).agg(F.array_sort(F.collect_list("station")).alias("stations"), F.sum("rows").alias("test_rows"), partner.alias("train_has_partner"))
    f = f.withColumn("held_out", F.array_join(F.transform("stations", lambda s: s.cast("string")), ","))
    return f.select(F.row_number().over(Window.orderBy("unit")).alias("fold"), "held_out", "test_rows", "train_has_partner", "stations")


def _solved(spark: SparkSession, plan: DataFrame, blocks: dict, shift: np.ndarray, features: Sequence[str], alpha: float, kind: str) -> DataFrame:
    """(run, _station, _coef, _intercept) of the plan's ridge models, solved in tasks: the stations' moments are sent to each
    (about a kilobyte a station), and a run's are the total less those of the stations that it leaves out."""
    total = sum(blocks.values(), Moments(0.0, np.zeros(len(features) + 1), np.zeros((len(features) + 1,) * 2)))
    sent = spark.sparkContext.broadcast((blocks, total))

    def solve(batches):
        blocks, total = sent.value
        for b in batches:
            rows = []
            for run, test, gone in zip(b["run"], b["test"], b["gone"]):
                m = total
                for s in set(gone):
                    m = m - blocks[s] if s in blocks else m
                if m.n > 0.5:
                    model = ridge_from_moments(m, shift, features, alpha)
                    rows += [(run, s, model.coef.tolist(), model.intercept) for s in test]
            yield pd.DataFrame(rows, columns=["run", "_station", "_coef", "_intercept"])

    return plan.mapInPandas(solve, f"run string, _station {kind}, _coef array<double>, _intercept double")


def run_plan(spark: SparkSession, df: DataFrame, plan: DataFrame | list[tuple[str, Sequence, Sequence]], features: Sequence[str] = FEATURES, y: str = "power", station: str = "zone", learner: str = "ridge", alpha: float = 1.0, settings: TreeSettings = LEAKAGE) -> DataFrame:
    """(run, rmse, n) for the runs of ``plan``: run, test stations, excluded stations (run string, test array, gone array, or a
    list of tuples). Runs without training rows or without test rows are left out.

    Ridge models are solved in tasks from per-station moments. With ``learner`` "gbt" all runs' trees grow together, from
    histograms that share their passes over the rows.
    """
    kind = df.schema[station].dataType.simpleString()
    if isinstance(plan, list):
        plan = spark.createDataFrame([(r, list(t), list(g)) for r, t, g in plan], f"run string, test array<{kind}>, gone array<{kind}>")
    if learner == "gbt":
        runs = [(r["run"], r["test"], r["gone"]) for r in plan.orderBy("run").collect()]  # each is a whole model to be fitted
        found = [(name, e, n) for name, e, n in run_errors(spark, df, runs, features, y, station, settings) if n]
        return spark.createDataFrame(found, "run string, e double, n long").select("run", F.sqrt(F.col("e") / F.col("n")).alias("rmse"), "n")
    d = drop_missing(df, [*features, y])
    blocks, shift = moment_blocks(d, features, y, station)
    table = Scratch(spark, "runs").put(_solved(spark, plan, blocks, shift, features, alpha, kind), "models")
    pred = F.col("_intercept")
    for i, name in enumerate(features):
        pred = pred + F.col("_coef")[i] * F.col(name)
    errors = d.join(table, F.col(station) == F.col("_station")).select("run", F.pow(F.col(y) - clip01(pred), F.lit(2.0)).alias("e"))
    return errors.groupBy("run").agg(F.sqrt(F.avg("e")).alias("rmse"), F.count(F.lit(1)).alias("n"))


def fold_rmse(spark: SparkSession, df: DataFrame, folds: DataFrame, station: str = "zone", **kw) -> DataFrame:
    """The folds (of station_folds or group_folds) with their rmse."""
    plan = folds.select(F.col("fold").cast("string").alias("run"), F.col("stations").alias("test"), F.col("stations").alias("gone"))
    got = run_plan(spark, df, plan, station=station, **kw)
    return folds.join(got.select(F.col("run").cast("int").alias("fold"), F.round("rmse", 4).alias("rmse")), "fold").select("fold", "held_out", "test_rows", "rmse", "train_has_partner")


def leakage_plan(df: DataFrame, groups: DataFrame, station: str = "zone") -> DataFrame:
    """run, test, gone, with test_station, twin, kind (A, B or C): for each duplicate group its smallest station T, tested after
    training without T (A), without T and its first other member (B), and without T and each station outside the group (C)."""
    members = groups.groupBy("group_id").agg(F.array_sort(F.collect_set("station")).alias("members")).where(F.size("members") > 1)
    t = members.select(F.col("members")[0].alias("test_station"), F.col("members")[1].alias("twin"), "members")
    stations = df.select(F.col(station).alias("other")).where("other is not null").distinct()
    c = t.crossJoin(F.broadcast(stations)).where(~F.array_contains("members", F.col("other"))).select("test_station", "twin", F.lit("C").alias("kind"), "other")  # runs of the test, by its definition
    ab = t.select("test_station", "twin", F.explode(F.array(F.struct(F.lit("A").alias("kind"), F.col("test_station").alias("other")), F.struct(F.lit("B").alias("kind"), F.col("twin").alias("other")))).alias("x")).select("test_station", "twin", "x.*")
    name = F.concat_ws("|", F.col("test_station").cast("string"), "kind", F.col("other").cast("string"))
    return ab.unionAll(c).select(name.alias("run"), F.array("test_station").alias("test"), F.array("test_station", "other").alias("gone"), "test_station", "twin", "kind")


def controlled_leakage_test(spark: SparkSession, df: DataFrame, groups: DataFrame, station: str = "zone", **kw) -> DataFrame:
    """One row for each duplicate group: test_station, twin, the errors of the runs of leakage_plan (a_rmse, b_rmse, c_mean,
    c_sd, and each C in c_runs), leak = B - C and gain = A - C. A leak shows as B worse than the mean of C. Without groups
    there are no rows."""
    plan = Scratch(spark, "leakage").put(leakage_plan(df, groups, station), "plan")
    got = run_plan(spark, df, plan.select("run", "test", "gone"), station=station, **kw).join(plan.select("run", "test_station", "twin", "kind"), "run")
    pick = lambda c: F.max(F.when(F.col("kind") == c, F.col("rmse")))
    c = F.when(F.col("kind") == "C", F.col("rmse"))
    t = got.groupBy("test_station", "twin").agg(pick("A").alias("a_rmse"), pick("B").alias("b_rmse"), F.avg(c).alias("c_mean"), F.stddev_pop(c).alias("c_sd"), F.array_sort(F.collect_list(F.round(c, 4))).alias("c_runs"))
    t = t.withColumns({"leak": F.col("b_rmse") - F.col("c_mean"), "gain": F.col("a_rmse") - F.col("c_mean")})
    return t.select("test_station", "twin", "a_rmse", "b_rmse", "c_mean", "c_sd", "leak", "gain", "c_runs")


def leakage_verdict(table: DataFrame) -> DataFrame:
    """leak, weak or none, from columns leak and c_sd."""
    x = F.col("leak")
    return table.withColumn("verdict", F.when((x > 2 * F.col("c_sd")) & (x > 0), "leak").when(x > 0, "weak").otherwise("none"))


def relative_overestimate(table: DataFrame) -> DataFrame:
    """By how many per cent a fold with the twin in training looks too good: (B - C) / B, with (B - C) / C and (B - A) / B. A share of
    an error of 0 (power that doesn't vary is predicted exactly) is NULL."""
    a, b, c = (F.col(x) for x in ("a_rmse", "b_rmse", "c_mean"))
    share = lambda x, whole: F.try_divide(x, whole) * 100
    return table.withColumns({"overestimate_pct": share(b - c, b), "over_c_pct": share(b - c, c), "over_a_pct": share(b - a, b)})
