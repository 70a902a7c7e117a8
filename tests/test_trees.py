"""Boosted trees against a plain search of all splits, and runs grown together against separate fits."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from windlake.operators import models, trees, validation
from windlake.operators.trees import TreeSettings

NAMES = ["a", "b", "c"]


def table(spark, n=600, seed=1, stations=4):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.integers(0, 30, n), rng.integers(0, 7, n), rng.integers(0, 2, n)], axis=1).astype(float)
    y = np.clip(0.3 + 0.02 * x[:, 0] * (x[:, 1] > 3) - 0.2 * x[:, 2] + rng.normal(0, 0.05, n), 0, 1)
    rows = [(int(i % stations) + 1, *map(float, r), float(v), "z") for i, (r, v) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "zone int, a double, b double, c double, power double, pred string").repartition(5), x, y


def best_split(x, g, least, lam):
    """(gain, feature, threshold) over all values of all features; the first feature's lowest threshold of equal gains."""
    best = (1e-12, None, None)
    for f in range(x.shape[1]):
        for v in sorted(set(x[:, f]))[:-1]:
            left = x[:, f] <= v
            n, m = left.sum(), (~left).sum()
            if n >= least and m >= least:
                gain = g[left].sum() ** 2 / (n + lam) + g[~left].sum() ** 2 / (m + lam) - g.sum() ** 2 / (len(g) + lam)
                if gain > best[0] + 1e-9:
                    best = (gain, f, v)
    return best


def grown_one_by_one(x, y, s):
    """Leaf-wise growth that splits one leaf at a time; the splits in order, and predictions of the training rows."""
    pred, all_splits = np.full(len(y), y.mean()), []
    for _ in range(s.trees):
        g = pred - y
        leaves = [np.arange(len(y))]
        splits = []
        while len(leaves) < s.leaves:
            found = [(*best_split(x[i], g[i], s.least_rows, s.penalty), k) for k, i in enumerate(leaves) if len(i) >= 2 * s.least_rows]
            found = [f for f in found if f[1] is not None]
            if not found:
                break
            gain, f, v, k = max(found, key=lambda t: t[0])
            rows = leaves.pop(k)
            on = x[rows, f] <= v
            leaves += [rows[on], rows[~on]]
            splits.append((NAMES[f], v, len(rows)))
        for i in leaves:
            pred[i] -= g[i].sum() / (len(i) + s.penalty) * s.rate
        all_splits.append(sorted(splits))
    return all_splits, pred


@pytest.mark.parametrize("settings", [TreeSettings(trees=4, rate=0.3, leaves=12, least_rows=10, feature_share=1.0), TreeSettings(trees=3, rate=0.5, leaves=40, least_rows=3, penalty=0.0, feature_share=1.0)])
def test_splits_are_those_of_a_plain_search(spark, settings, monkeypatch):
    monkeypatch.setattr(trees, "ROWS_A_PART", 150)  # several partitions
    monkeypatch.setattr(trees, "SUM_AT_DRIVER", 1)  # that are added up in a tree
    monkeypatch.setattr(trees, "CHECKPOINT_EVERY", 2)
    df, x, y = table(spark)
    model = trees.fit_trees(spark, df, NAMES, settings=settings)
    splits, pred = grown_one_by_one(x, y, settings)
    got = {}
    for r in model.nodes(spark).where("feature is not null").collect():
        got.setdefault(r.tree, []).append((r.feature, r.threshold, r.n_rows))
    assert [sorted(got[t]) for t in range(settings.trees)] == splits
    assert np.allclose(model.predict(x), pred, atol=1e-9)


def test_runs_grown_together_are_separate_fits(spark, monkeypatch):
    monkeypatch.setattr(trees, "RUNS_AT_ONCE", 3)
    monkeypatch.setattr(trees, "ROWS_A_PART", 700)
    df, _, _ = table(spark, 900)
    s = TreeSettings(trees=6, rate=0.2, leaves=9, least_rows=10, feature_share=0.7)
    plan = [("one", [1], [1]), ("two", [2], [2, 3]), ("both", [3, 4], [3, 4]), ("all", [1], []), ("nothing left", [1], [1, 2, 3, 4])]
    got = {r.run: (r.rmse, r.n) for r in validation.run_plan(spark, df, plan, NAMES, learner="gbt", settings=s).collect()}
    for name, test, gone in plan[:4]:
        model = trees.fit_trees(spark, df.where(~F.col("zone").isin(gone)) if gone else df, NAMES, settings=s)
        rows = df.where(F.col("zone").isin(test)).collect()
        p = np.clip(model.predict(np.array([[r[c] for c in NAMES] for r in rows])), 0, 1)
        assert got[name][1] == len(rows) and got[name][0] == pytest.approx(math.sqrt(np.mean((p - [r.power for r in rows]) ** 2)), abs=1e-9)
    assert got["nothing left"][1] == 225


def test_better_than_a_line_where_there_is_something_to_learn(spark):
    df, x, y = table(spark, 3000, 7)
    train, test = df.where("zone <= 3"), df.where("zone = 4")
    rmse = lambda d: d.select(F.sqrt(F.avg((F.col("power") - F.col("pred")) ** 2))).first()[0]
    model = trees.fit_trees(spark, train, NAMES, settings=TreeSettings(trees=60, leaves=15))
    by_trees, by_line = rmse(models.gbt_predict(test.drop("pred"), model)), rmse(models.ridge_predict(test.drop("pred"), models.ridge_fit(train, NAMES)))
    assert by_trees < 0.6 * by_line and by_trees < 0.07


def test_the_model_is_a_table(spark):
    df, x, y = table(spark)
    model = trees.fit_trees(spark, df, NAMES, settings=TreeSettings(trees=12, leaves=8, feature_share=0.7))
    nodes = model.nodes(spark)
    found = nodes.toPandas()
    con = duckdb.connect()
    con.register("nodes", found)
    want = dict(con.execute("select feature, count(*) from nodes where feature is not null group by 1").fetchall())
    ranked = models.feature_importance(spark, nodes, [*NAMES, "unused"]).collect()
    assert {r.feature: r.importance for r in ranked} == want | {"unused": 0} and [r.importance for r in ranked] == sorted((r.importance for r in ranked), reverse=True)
    # every row goes down each tree in SQL, from the table alone
    con.register("rows_in", df.select(*NAMES).toPandas().assign(i=range(600)))
    walk = """with recursive w as (select r.i, t.tree, 0 as node, r.a, r.b, r.c from rows_in r, (select distinct tree from nodes where tree >= 0) t
        union all select w.i, w.tree, case when case n.feature when 'a' then w.a when 'b' then w.b else w.c end <= n.threshold then n."left" else n."right" end, w.a, w.b, w.c
        from w join nodes n on n.tree = w.tree and n.node = w.node where n.feature is not null)
        select i, sum(value) + (select value from nodes where tree = -1) from w join nodes n on n.tree = w.tree and n.node = w.node where n.feature is null group by i order by i"""
    rows = np.array(df.select(*NAMES).collect(), float)
    by_sql = np.array([v for _, v in con.execute(walk).fetchall()])
    got = np.array([r[0] for r in df.select(model.column(df)).collect()])
    assert np.allclose(by_sql, model.predict(rows), atol=1e-9) and np.allclose(np.sort(got), np.sort(by_sql), atol=1e-9)
    inner = found[found.feature.notna()]
    for r in inner.itertuples():
        kids = found[(found.tree == r.tree) & found.node.isin([r.left, r.right])]
        assert kids.n_rows.sum() == r.n_rows and kids.n_rows.min() >= 20


def test_odd_tables(spark):
    s = TreeSettings(trees=3, leaves=4)
    df, _, _ = table(spark)
    none = trees.fit_trees(spark, df.limit(0), NAMES, settings=s)
    assert none.trees == [] and none.nodes(spark).count() == 1 and none.base == 0
    flat = trees.fit_trees(spark, df.withColumn("a", F.lit(1.0)).withColumn("power", F.lit(0.25)), NAMES, settings=s)
    assert flat.base == pytest.approx(0.25) and all(len(t.feature) == 1 for t in flat.trees)
    some = df.withColumn("a", F.when(F.col("a") > 3, F.col("a"))).withColumn("power", F.when(F.col("b") > 0, F.col("power")))
    model = trees.fit_trees(spark, some, NAMES, settings=s)
    assert model.nodes(spark).where("tree = 0 and node = 0").first().n_rows == some.where("a is not null and power is not null").count()
    assert some.where("a is null").select(model.column(some).alias("p")).where("p is not null").count() == 0
    few = trees.fit_trees(spark, df.limit(30), NAMES, settings=s)
    assert few.trees == []


def test_quantile_bins_are_even(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=5000)
    edges = trees.bin_edges(spark.createDataFrame([(float(x), float(i % 3)) for i, x in enumerate(v)], "x double, few double"), ["x", "few"], 50)
    assert len(edges[0]) == 49 and list(edges[1]) == [0.0, 1.0]
    share = np.bincount(np.searchsorted(edges[0], v, "left")) / len(v)
    assert share.max() < 0.025 and share.min() > 0.015


def test_leaves_are_split_without_gain_if_asked(spark):
    df = spark.createDataFrame([(float(i % 10), 1.0) for i in range(200)], "a double, power double")
    rows = lambda over: trees.fit_trees(spark, df, ["a"], settings=TreeSettings(trees=1, leaves=3, feature_share=1.0, over_gain=over)).nodes(spark).where("tree = 0 and feature is not null").count()
    assert rows(1e-12) == 0 and rows(-float("inf")) == 2
