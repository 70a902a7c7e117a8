"""Learners: ridge by per-station moment blocks, boosted trees (trees.py); the time split and the experiments."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windlake.functions.physics import clip01
from windlake.operators import curves
from windlake.operators.features import FEATURES, LAG_FEATURES, drop_missing
from windlake.operators.metrics import error_by_wind_bin, ranked, regression_metrics
from windlake.operators.ranks import values_at_ranks
from windlake.operators.trees import Trees, TreeSettings, fit_trees
from windlake.sources.scratch import Scratch


def split_by_time(df: DataFrame, test_ratio: float = 0.3, ts: str = "ts") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Train, test and the cut (one row, epoch microseconds): the interpolated quantile of all rows' times, never a random draw.
    Rows without a time are in neither; an empty table gives two empty ones."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    counts = df.where(micros.isNotNull()).groupBy(micros.alias("v")).agg(F.count(F.lit(1)).alias("c")).withColumn("all", F.lit(0))
    place = counts.groupBy("all").agg(((F.sum("c") - 1) * F.lit(1 - test_ratio)).alias("place"))
    ranks = place.select("all", F.explode(F.array(F.floor("place"), F.ceil("place"))).alias("rank"))
    ends = values_at_ranks(df.sparkSession, counts, ranks, "all").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    cut = ends.crossJoin(F.broadcast(place)).select((F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("place") - F.floor("place"))).alias("cut"))
    at = cut.toDF("_split_cut")  # a name that no table has
    d = df.crossJoin(F.broadcast(at))
    return d.where(micros <= F.col("_split_cut")).drop("_split_cut"), d.where(micros > F.col("_split_cut")).drop("_split_cut"), cut


@dataclass
class Ridge:
    features: list[str]
    coef: np.ndarray
    intercept: float

    def column(self) -> Column:
        y = F.lit(float(self.intercept))
        for name, c in zip(self.features, self.coef):
            y = y + F.lit(float(c)) * F.col(name)
        return clip01(y)


@dataclass
class Moments:
    """n, sums and products of (features, target), shifted by fixed values: sums of stations' moments are a set's moments."""

    n: float
    s: np.ndarray
    q: np.ndarray

    def __add__(self, o: Moments) -> Moments:
        return Moments(self.n + o.n, self.s + o.s, self.q + o.q)

    def __sub__(self, o: Moments) -> Moments:
        return Moments(self.n - o.n, self.s - o.s, self.q - o.q)


def moment_blocks(df: DataFrame, features: Sequence[str] = FEATURES, y: str = "power", by: str = "zone") -> tuple[dict, np.ndarray]:
    """Each station's moments, in one scan; what reaches the driver is one row of (p + 1)(p + 4) / 2 sums a station."""
    cols = [*features, y]
    d = drop_missing(df, cols)
    shift = np.array([x or 0.0 for x in d.agg(*(F.avg(c) for c in cols)).first()])
    x = [F.col(c) - F.lit(float(m)) for c, m in zip(cols, shift)]
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    aggs = [F.count(F.lit(1)).alias("n"), *(F.sum(v).alias(f"s{i}") for i, v in enumerate(x)), *(F.sum(x[i] * x[j]).alias(f"q{i}_{j}") for i, j in pairs)]
    out = {}
    for r in d.groupBy(by).agg(*aggs).collect():
        q = np.zeros((len(cols), len(cols)))
        for i, j in pairs:
            q[i, j] = q[j, i] = r[f"q{i}_{j}"]
        out[r[by]] = Moments(r["n"], np.array([r[f"s{i}"] for i in range(len(cols))]), q)
    return out, shift


def ridge_from_moments(m: Moments, shift: np.ndarray, features: Sequence[str], alpha: float = 1.0) -> Ridge:
    """Standardised features (population deviation), an intercept that isn't penalised."""
    p = len(features)
    mean = m.s / m.n
    cov = m.q - m.n * np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov)[:p], 0) / m.n)
    sd[sd < 1e-12] = 1.0
    a = cov[:p, :p] / np.outer(sd, sd) + alpha * np.eye(p)
    coef = np.linalg.solve(a, cov[:p, p] / sd) / sd
    return Ridge(list(features), coef, float(mean[p] + shift[p] - coef @ (mean[:p] + shift[:p])))


def ridge_fit(df: DataFrame, features: Sequence[str] = FEATURES, y: str = "power", alpha: float = 1.0, by: str = "zone") -> Ridge:
    blocks, shift = moment_blocks(df, features, y, by)
    total = sum(blocks.values(), Moments(0.0, np.zeros(len(features) + 1), np.zeros((len(features) + 1,) * 2)))
    return ridge_from_moments(total, shift, features, alpha)


def ridge_predict(df: DataFrame, model: Ridge, medians: dict[str, float] | None = None, out: str = "pred") -> DataFrame:
    """Predictions in [0, 1]. Missing features are NULL unless training medians are given for them."""
    return (df.na.fill(medians, subset=model.features) if medians else df).withColumn(out, model.column())


def gbt_predict(df: DataFrame, model: Trees, out: str = "pred") -> DataFrame:
    """Predictions in [0, 1] of the rows that have all features."""
    d = drop_missing(df, model.features)
    return d.withColumn(out, clip01(model.column(d)))


def feature_importance(spark: SparkSession, nodes: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """feature, importance (in how many nodes of the model's table it splits), largest first: one row for each feature."""
    used = nodes.where("feature is not null").groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    names = spark.createDataFrame([(f,) for f in features], "feature string")
    return names.join(used, "feature", "left").select("feature", F.coalesce("n", F.lit(0)).alias("importance")).orderBy(F.desc("importance"), "feature")


def _prediction(spark: SparkSession, name: str, train: DataFrame, ok: DataFrame, features: Sequence[str], settings: TreeSettings) -> tuple[DataFrame, Trees | None]:
    if name == "power curve":
        return curves.predict_power_curve(ok, curves.fit_power_curve(spark, train)), None
    if name == "linear":
        return curves.predict_linear(ok, curves.fit_linear(train)), None
    if name == "cubic":
        return curves.predict_cubic(ok, curves.fit_cubic(train)), None
    if name == "persistence":
        return curves.predict_persistence(ok), None
    if name == "ridge":
        return ridge_predict(ok, ridge_fit(train, features)), None
    if name == "gbt":
        model = fit_trees(spark, train, features, settings=settings)
        return gbt_predict(ok, model), model
    raise ValueError(f"no model is called {name}")


@dataclass
class Experiment:
    """What an experiment leaves behind, each part a written table or made from one: predictions of all models (model, zone, ts,
    ws100, power, pred), the metrics (best first), the best model's errors by speed, and the trees' nodes and ranked
    split counts (None without trees)."""

    predictions: DataFrame
    table: DataFrame
    errors: DataFrame
    nodes: DataFrame | None
    importance: DataFrame | None


def run_experiment(spark: SparkSession, train: DataFrame, test: DataFrame, models: Sequence[str], features: Sequence[str], settings: TreeSettings = TreeSettings()) -> Experiment:
    """Every model is fitted once, on the training rows that have what it needs, and scored once, on the test rows that have all
    features and the target."""
    scratch = Scratch(spark, "experiment")
    ok = drop_missing(test, [*features, "power"])
    parts, nodes = [], None
    for name in models:
        p, model = _prediction(spark, name, train, ok, features, settings)
        parts.append(p.select(F.lit(name).alias("model"), "zone", "ts", "ws100", "power", "pred"))
        nodes = scratch.put(model.nodes(spark), "nodes") if model else nodes
    pred = scratch.put(reduce(DataFrame.unionAll, parts), "predictions")
    table = scratch.put(ranked(regression_metrics(pred)), "metrics").orderBy(F.desc("accuracy_pct"), "model")
    best = pred.join(F.broadcast(table.limit(1).select("model")), "model")
    return Experiment(pred, table, error_by_wind_bin(best), nodes, feature_importance(spark, nodes, features) if nodes else None)


def experiment_a(spark: SparkSession, train: DataFrame, test: DataFrame, learners: Sequence[str] = ("ridge", "gbt"), settings: TreeSettings = TreeSettings()) -> Experiment:
    """Forecast features only: physical baselines against learners."""
    return run_experiment(spark, train, test, ["power curve", "cubic", "linear", *learners], FEATURES, settings)


def experiment_b(spark: SparkSession, train: DataFrame, test: DataFrame, learners: Sequence[str] = ("ridge", "gbt"), settings: TreeSettings = TreeSettings()) -> Experiment:
    """With the station's own history: persistence is the baseline."""
    return run_experiment(spark, train, test, ["persistence", *learners], [*FEATURES, *LAG_FEATURES], settings)


def experiment_delta(table: DataFrame, learner: str = "gbt", baseline: str = "power curve") -> DataFrame:
    """How many points of accuracy the learner gains."""
    a, b = (table.where(F.col("model") == m).select(F.col("accuracy_pct").alias(n)) for m, n in ((learner, "a"), (baseline, "b")))
    return a.crossJoin(F.broadcast(b)).select(F.lit(learner).alias("learner"), F.lit(baseline).alias("baseline"), F.round(F.col("a") - F.col("b"), 2).alias("delta_points"))
