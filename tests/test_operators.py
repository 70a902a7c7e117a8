"""Edge cases, published numbers and known truths."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from windlake.functions.physics import air_density_correction, clip01, wind_direction
from windlake.functions.special import gamma
from windlake.jobs import forecast, quality as quality_job, resource as resource_job
from windlake.operators import curves, features, independence, metrics, models, quality, ranks, resource, validation, weibull
from windlake.operators.components import connected_components
from windlake.operators.trees import TreeSettings
from windlake.sources.stations import read_stations, read_stations_checked, write_report


def at(i):
    return dt.datetime(2012, 1, 1) + dt.timedelta(hours=i)


def series(spark, values, zone=1):
    return spark.createDataFrame([(zone, at(i), v) for i, v in enumerate(values)], "zone int, ts timestamp_ntz, v double")


def test_gamma(spark):
    xs = [1.0, 1.1, 1.5, 2.0, 3.7, 10.0, 60.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(gamma(F.col("x"))).collect()
    assert all(math.isclose(g[0], math.gamma(x), rel_tol=1e-12) for g, x in zip(got, xs))


def test_missing_values_stay_missing(spark):
    r = spark.createDataFrame([(None, 0.0, 0.0), (2.0, 0.0, -1.0), (-1.0, 1.0, 0.0)], "x double, u double, v double").select(clip01("x"), wind_direction("u", "v"), air_density_correction("x", "u")).collect()
    assert r[0][0] is None and r[1][0] == 1.0 and r[2][0] == 0.0
    assert [x[1] for x in r] == [180.0, 0.0, 270.0] and r[1][2] == 2.0


def test_frozen_runs_and_jumps(spark):
    v = [1.0] * 5 + [2.0] * 6 + [None] + [2.0] * 7 + [8.0, 14.1, float("inf")]
    df = series(spark, v).unionAll(series(spark, [14.1] * 3, 2))
    runs = sorted((r.zone, r.start_pos, r.length, r.value) for r in quality.frozen_runs(df, "v").collect())
    assert runs == [(1, 5, 6, 2.0), (1, 12, 7, 2.0)]
    assert [(r.frozen_runs, r.longest_frozen) for r in quality.frozen_check(df, "v").orderBy("zone").collect()] == [(2, 7), (0, 0)]
    assert quality.jump_points(series(spark, [1.0, 7.0, 13.1]), "v").count() == 1  # 6.0 exactly is no jump
    with pytest.raises(ValueError):
        quality.assert_unique(df.unionAll(df.limit(1)))


def test_lags_stay_in_their_station(spark):
    df = series(spark, [0.1, 0.2, 0.3, 0.4]).unionAll(series(spark, [0.5], 2)).withColumnRenamed("v", "power")
    r = features.lag_features(df).orderBy("zone", "ts").collect()
    assert [x.power_lag1 for x in r] == [None, 0.1, 0.2, 0.3, None] and r[3].power_roll3 == pytest.approx(0.2) and r[2].power_roll3 is None


def test_weibull_recovers_known_parameters(spark):
    rng = np.random.default_rng(3)
    rows = [(z, float(v)) for z, (k, c) in enumerate([(0.8, 3.0), (2.0, 8.0), (5.0, 11.0)]) for v in c * rng.weibull(k, 8000)] + [(9, 1.0)] * 12 + [(8, 2.0)]
    got = {r.zone: r for r in weibull.fit_mle(spark, spark.createDataFrame(rows, "zone int, v double"), "v").collect()}
    for z, (k, c) in enumerate([(0.8, 3.0), (2.0, 8.0), (5.0, 11.0)]):
        assert got[z].k_mle == pytest.approx(k, rel=0.03) and got[z].c_mle == pytest.approx(c, rel=0.03)
    assert got[9].k_mle is None and got[8].k_mle is None


def test_published_energy(spark):
    # k, c -> capacity factor, P50, P75, P90 of three published sites (50 MW); k and c have three decimals
    sites = [(1, 2.54, 7.123, 0.209, 91580, 84091, 77350), (2, 2.476, 7.182, 0.216, 94767, 87017, 80042), (3, 2.618, 7.476, 0.237, 103742, 95258, 87622)]
    e = resource.aep(spark, spark.createDataFrame([s[:3] for s in sites], "zone int, k double, c double"), 50.0).collect()
    for r, (_, _, _, cf, p50, p75, p90) in zip(sorted(e), sites):
        assert r.capacity_factor == pytest.approx(cf, abs=6e-4) and r.aep_mwh == pytest.approx(p50, rel=5e-4)
        assert r.aep_mwh * (1 - 0.6745 * resource.TOTAL_SIGMA) == pytest.approx(p75, rel=5e-4)
        assert r.aep_mwh * (1 - 1.2816 * resource.TOTAL_SIGMA) == pytest.approx(p90, rel=5e-4)
    assert resource.TOTAL_SIGMA == pytest.approx(0.121244, abs=1e-6)


def test_published_leakage(spark):
    rows = [(4, 0.1825, 0.1929, [0.1828, 0.1842, 0.1801, 0.1857, 0.1823, 0.1813, 0.1824, 0.1787]), (7, 0.1476, 0.1806, [0.1521, 0.1498, 0.1423, 0.1456, 0.1431, 0.1435, 0.1494, 0.1393])]
    t = spark.createDataFrame([(z, a, b, float(np.mean(c)), float(np.std(c)), b - float(np.mean(c))) for z, a, b, c in rows], "zone int, a_rmse double, b_rmse double, c_mean double, c_sd double, leak double")
    got = validation.relative_overestimate(validation.leakage_verdict(t)).orderBy("zone").collect()
    assert [r.verdict for r in got] == ["leak", "leak"]
    assert [round(r.overestimate_pct, 1) for r in got] in ([5.5, 19.4], [5.6, 19.4])


def test_published_duplicates(spark):
    rows = [(z, at(t)) for z in range(1, 11) for t in range(6)]
    df, groups = spark.createDataFrame(rows, "zone int, ts timestamp_ntz"), spark.createDataFrame([(4, 4), (5, 4), (7, 7), (8, 7)], "station int, group_id int")
    s = independence.effective_sample_size(groups, df).first()
    assert (s.nominal_stations, s.effective_stations, s.nominal_samples, s.effective_samples, s.inflation) == (10, 8, 60, 48, 1.25)
    c = independence.cv_impact(groups, df).first()
    assert (c.nominal_folds, c.suggested_folds, c.risk, c.leaking_groups) == (10, 8, "medium", "4 - 5; 7 - 8")
    f = validation.group_folds(df, groups).orderBy("fold").collect()
    assert [x.held_out for x in f] == ["1", "2", "3", "4,5", "6", "7,8", "9", "10"] and f[3].test_rows == 12


def test_duplicates_by_edge_cases(spark):
    rows = []
    for t in range(5):
        rows += [(1, at(t), 0.0, 1.0 + t), (2, at(t), -0.0, 1.0 + t), (4, at(t), 0.0, 1.5 + t), (5, at(t), 0.0, 2.0 + t)]
        rows += [(3, at(t), 0.0, 1.0 + t)] if t < 4 else [(3, at(t), None, None)]
    rows += [(6, at(t), 0.0, 1.0 + t) for t in range(4)]  # an absent row is like a missing one
    df = spark.createDataFrame(rows, "zone int, ts timestamp_ntz, u100 double, v100 double")
    assert sorted(map(tuple, independence.exact_duplicate_groups(df).collect())) == [(1, 1), (2, 1), (3, 3), (6, 3)]
    near = {(r.station_a, r.station_b) for r in independence.near_duplicate_pairs(df, 0.5).collect()}
    assert {(1, 4), (4, 5)} <= near and (1, 5) not in near
    assert {r.group_id for r in independence.near_duplicate_groups(spark, df, 0.5).collect()} == {1}


def test_components(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, rnd.randrange(101, 400)) for _ in range(200)] + [(500, 500)]
    got = dict(map(tuple, connected_components(spark, spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(got[i] == 0 for i in range(61)) and all(c == 100 for v, c in got.items() if 100 <= v < 400) and got[500] == 500


def test_power_curve_edges(spark):
    rows = [(0.1, 0.0)] * 5 + [(0.6, 0.4)] * 4 + [(1.2, 0.5)] * 5 + [(2.0, 0.9)] * 9  # a bin of 4 is empty; 2.0 is the top edge
    curve = {r.bin: r.y for r in curves.fit_power_curve(spark, spark.createDataFrame(rows, "ws100 double, power double")).collect()}
    assert curve == {0: 0.0, 1: 0.25, 2: 0.5, 3: 0.5}


def test_metric_edges(spark):
    df = spark.createDataFrame([("m", 0.5, 0.25), ("m", 0.5, 0.5), ("m", None, 0.1), ("m", 0.5, 0.2499)], "model string, power double, pred double")
    r = metrics.regression_metrics(df).first()
    assert r.r2 is None and r.qualified_pct == 66.67
    rows = [(w, 0.0, 0.0) for w in (0.0, 3.0, 25.0, 25.1) for _ in range(10)]
    bins = metrics.error_by_wind_bin(spark.createDataFrame(rows, "ws100 double, power double, pred double")).collect()
    assert sorted(b.wind_bin for b in bins) == ["(0, 3]", "(12, 25]"]


def stations(spark, hours=400, n=6):
    """Stations with known links: 2 copies 1's wind; power follows wind by a ramp and noise."""
    rng = np.random.default_rng(5)
    rows, wind = [], {}
    for z in range(1, n + 1):
        wind[z] = wind[1] if z == 2 else np.abs(np.cumsum(rng.normal(0, 0.4, hours)) % 12 + rng.normal(0, 0.3, hours))
        for t, w in enumerate(wind[z]):
            p = float(np.clip((w / 12) ** 3 + rng.normal(0, 0.05) + 0.1 * (z % 2), 0, 1))
            rows.append((at(t), z, p, float(0.6 * w), 0.5, float(w), 0.7))
    return spark.createDataFrame(rows, "timestamp timestamp_ntz, zone int, power double, u10 double, v10 double, u100 double, v100 double")


def test_ridge_is_the_closed_form(spark):
    d = features.build_features(stations(spark).withColumnRenamed("timestamp", "ts"), add_lag=False)
    m = models.ridge_fit(d, alpha=2.0)
    rows = np.array([[r[c] for c in [*features.FEATURES, "power"]] for r in features.drop_missing(d, [*features.FEATURES, "power"]).collect()])
    x, y = rows[:, :-1], rows[:, -1]
    sd = x.std(axis=0)
    sd[sd < 1e-12] = 1
    z = (x - x.mean(axis=0)) / sd
    w = np.linalg.solve(z.T @ z + 2.0 * np.eye(z.shape[1]), z.T @ (y - y.mean())) / sd
    assert np.allclose(m.coef, w, atol=1e-6) and m.intercept == pytest.approx(y.mean() - x.mean(axis=0) @ w, abs=1e-6)


def test_jobs(spark, tmp_path):
    s = stations(spark)
    f = forecast.run(spark, s, f"{tmp_path}/f", settings=TreeSettings(trees=15, leaves=7))
    assert {r.model for r in f["experiment_a"].collect()} == {"power curve", "cubic", "linear", "ridge", "gbt"} and f["experiment_b"].count() == 3
    assert f["experiment_a"].where("accuracy_pct > 85").count() > 0
    assert f["importance_a"].count() == 13 and f["importance_b"].first().importance > 0 and f["trees_a"].agg(F.max("tree")).first()[0] == 14
    assert {r.learner for r in f["delta_a"].collect()} == {"ridge", "gbt"}
    r = resource_job.run(spark, s, f"{tmp_path}/r")
    own = resource_job.run(spark, s, f"{tmp_path}/own", curve=spark.createDataFrame([(0.0, 1.0), (30.0, 1.0)], "x double, y double"))
    assert own["totals"].first().capacity_factor > 0.95 > r["totals"].first().capacity_factor
    assert r["sites"].count() == 6 and r["top_bins"].count() == 48 and r["mean_shear"].count() == 7
    q = quality_job.run(spark, s, f"{tmp_path}/q", learner="gbt", settings=TreeSettings(trees=10, leaves=7))
    assert [list(x.members) for x in q["groups"].collect()] == [[1, 2]] and q["leakage"].first().twin == 2 and q["folds_by_group"].count() == 5


def test_read_stations(spark, tmp_path):
    for z, head in ((1, " zoneid ,Timestamp,TARGETVAR,u10,V10,U100,V100"), (2, "ZONEID,TIMESTAMP,TARGETVAR,U10,V10,U100,V100")):
        (tmp_path / f"Task1_W_Zone{z}.csv").write_text(f"{head}\n{z},20120101 1:00,0,2.1,-2.6,2.8,-3.6\n{z},20120131 24:00,,1,1,1,NaN\n{z},20120101 0:30, 0.5 ,1,1,1,1\n")
    df = read_stations(spark, f"{tmp_path}/Task1_W_Zone*.csv", task=1)
    got = sorted(df.collect(), key=lambda r: (r.zone, r.timestamp))
    assert [(r.zone, r.timestamp, r.power, r.v100) for r in got[:3]] == [(1, dt.datetime(2012, 1, 1), 0.5, 1.0), (1, dt.datetime(2012, 1, 1, 1), 0.0, -3.6), (1, dt.datetime(2012, 2, 1), None, None)]
    assert read_stations(spark, f"{tmp_path}/*.csv", zones=[2]).count() == 3
    write_report(df, f"{tmp_path}/out", single_file=True)
    assert spark.read.csv(f"{tmp_path}/out", header=True).count() == 6


def test_odd_curves_clashing_names_and_empty_tables(spark):
    curve = spark.createDataFrame([(0.0, 0.0), (3.0, 0.1), (3.5, 0.9), (20.0, 1.0), (None, 5.0)], "x double, y double")
    rows = [(1, v, 7.0, "lo", "a") for v in (-1.0, 0.0, 1.5, 3.0, 3.25, 3.5, 20.0, 21.0, None)]
    df = spark.createDataFrame(rows, "zone int, ws100 double, k double, lo string, a string")
    got = [r.p for r in curves.interpolate(df, "ws100", curve, "p", left=-9.0).collect()]
    assert got[-1] is None and np.allclose(got[:-1], [-9.0, 0.0, 0.05, 0.1, 0.5, 0.9, 1.0, 1.0])
    cubic = spark.createDataFrame([(0.001,)], "k double")
    out = curves.predict_cubic(df, cubic)
    assert set(df.columns) < set(out.columns) and {r.k for r in out.collect()} == {7.0}
    none = df.limit(0).withColumn("power", F.lit(0.5))
    assert weibull.fit_mle(spark, none, "ws100").count() == 0 and curves.fit_power_curve(spark, none).where("y is not null").count() == 0


def test_files_of_any_column_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ZONEID,TIMESTAMP,TARGETVAR,U10,V10,U100,V100\n1,20120101 1:00,0.5,1,2,3,4\n")
    (tmp_path / "b.csv").write_text(" v100,u100,V10,U10,TARGETVAR,TIMESTAMP,ZoneId\n4,3,2,1,,20120101 24:00,2\n")
    got = {r.zone: (r.power, r.u10, r.v10, r.u100, r.v100, str(r.timestamp)) for r in read_stations(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]).collect()}
    assert got == {1: (0.5, 1.0, 2.0, 3.0, 4.0, "2012-01-01 01:00:00"), 2: (None, 1.0, 2.0, 3.0, 4.0, "2012-01-02 00:00:00")}


def test_curve_of_many_uneven_points(spark):
    rng = np.random.default_rng(8)
    x = np.unique(np.round(np.cumsum(rng.exponential(1.0, 5000)), 6))
    y = np.sin(x)
    curve = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    v = np.concatenate([rng.uniform(x[0] - 5, x[-1] + 5, 2000), x[::97], [x[0], x[-1]]])
    out = curves.interpolate(spark.createDataFrame([(float(a),) for a in v], "v double"), "v", curve, "p").collect()
    assert np.allclose([r.p for r in out], np.interp([r.v for r in out], x, y), atol=1e-9)
    one = spark.createDataFrame([(2.0, 7.0)], "x double, y double")
    got = [r.p for r in curves.interpolate(spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, None)], "v double"), "v", one, "p").collect()]
    assert got == [7.0, 7.0, 7.0, None]
    none = curves.interpolate(spark.createDataFrame([(1.0,)], "v double"), "v", curve.limit(0), "p").collect()
    assert [r.p for r in none] == [None]


def test_a_broken_speed_is_no_curve_of_a_billion_bins(spark):
    rows = [(0.1 * (i % 30), 0.01 * (i % 30)) for i in range(300)] + [(1e9, 0.5)] * 6 + [(float("inf"), 0.5)]
    df = spark.createDataFrame(rows, "ws100 double, power double")
    with pytest.raises(Exception, match="give v_max"):
        curves.fit_power_curve(spark, df).collect()
    assert curves.fit_power_curve(spark, df, v_max=40.0).count() == 6


def test_no_file_and_no_row_is_lost(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ZONEID,TIMESTAMP,TARGETVAR,U10,V10,U100,V100\n1,20120101 1:00,0.5,1,2,3,4\nx,20120101 1:00,0.5,1,2,3,4\n1,yesterday,0.5,1,2,3,4\n1,20120101 2:00,0.5,1,2\n1,20120101 3:00,bad,1,2,3,4\n\n1,20120101 4:00,0.5,1,2,3,4,5\n")
    (tmp_path / "b c.csv").write_text("TIMESTAMP,TARGETVAR,U10,V10,U100,V100\n20120101 1:00,0.5,1,2,3,4\n")
    (tmp_path / "d.csv").write_text("")
    with pytest.raises(ValueError, match="ZONEID"):
        read_stations(spark, str(tmp_path / "*.csv"))
    good, bad, files = read_stations_checked(spark, str(tmp_path / "*.csv"))
    assert sorted((r.timestamp.hour, r.power) for r in good.collect()) == [(1, 0.5), (3, None)]
    assert sorted((r.reason, r.line) for r in bad.collect()) == [("columns", "1,20120101 2:00,0.5,1,2"), ("columns", "1,20120101 4:00,0.5,1,2,3,4,5"), ("timestamp", "1,yesterday,0.5,1,2,3,4"), ("zone", "x,20120101 1:00,0.5,1,2,3,4")]
    assert {f.rsplit("/", 1)[1].replace("%20", " "): len(c) for f, c in files.items()} == {"b c.csv": 1, "d.csv": 7}
    assert all(r.file.endswith("a.csv") for r in bad.collect())


def test_values_at_ranks(spark):
    rng = np.random.default_rng(4)
    groups = {0: np.round(rng.normal(size=3000), 3), 1: np.array([5.0] * 400), 2: np.concatenate([[-1e300, 1e300], rng.random(500)]), 3: np.array([2.0]), 4: rng.integers(0, 3, 900).astype(float)}
    rows = [(g, float(v)) for g, x in groups.items() for v in x]
    counted = spark.createDataFrame(rows, "g int, v double").groupBy("g", "v").agg(F.count(F.lit(1)).alias("c"))
    want = {(g, r): float(np.sort(x)[r]) for g, x in groups.items() for r in {0, len(x) // 3, len(x) // 2, len(x) - 1}}
    targets = spark.createDataFrame([*want, (3, 7), (9, 0)], "g int, rank long")
    got = {(r.g, r["rank"]): r.v for r in ranks.values_at_ranks(spark, counted, targets, "g", buckets=16).collect()}
    assert got == want
    assert ranks.values_at_ranks(spark, counted.limit(0), targets, "g").count() == 0


def test_median_of_a_crowded_bin(spark):
    rng = np.random.default_rng(9)
    ws, p = np.concatenate([np.full(4000, 5.2), rng.uniform(0, 12, 3000)]), rng.random(7000)
    curve = {r.bin: r.y for r in curves.fit_power_curve(spark, spark.createDataFrame([(float(a), float(b)) for a, b in zip(ws, p)], "ws100 double, power double")).collect()}
    for b in range(24):
        assert curve[b] == pytest.approx(np.median(p[np.floor(ws / 0.5) == b]), abs=1e-12)


def test_time_cut_is_numpys(spark):
    rng = np.random.default_rng(1)
    rows = [(int(z), at(int(t))) for z in range(3) for t in np.unique(rng.integers(0, 300, 90))]
    train, test, cut = models.split_by_time(spark.createDataFrame([*rows, (9, None)], "zone int, ts timestamp_ntz"))
    micros = np.array([(t - dt.datetime(1970, 1, 1)).total_seconds() * 1e6 for _, t in rows])
    assert cut.first()[0] == pytest.approx(np.quantile(micros, 0.7), abs=1) and train.count() + test.count() == len(rows)
    assert train.columns == test.columns == ["zone", "ts"]
    empty = models.split_by_time(spark.createDataFrame([], "zone int, ts timestamp_ntz"))
    assert empty[0].count() == empty[1].count() == 0


def test_weibull_where_newton_alone_does_not_settle(spark):
    rng = np.random.default_rng(12)
    samples = {0: np.concatenate([rng.weibull(9.0, 400) * 8, [400.0, 900.0]]), 1: np.concatenate([np.full(60, 7.0), [7.1, 6.9, 0.001]]), 2: np.concatenate([np.full(400, 1e-6), rng.weibull(2.0, 30)]), 3: rng.weibull(0.3, 300), 4: np.concatenate([np.full(500, 5.0), [5.0000001]]), 5: rng.weibull(2.0, 300) * 1e12}

    def f(k, v):
        x = v / v.max()
        return (x**k * np.log(x)).sum() / (x**k).sum() - 1 / k - np.log(x).mean()

    got = {r.zone: r for r in weibull.fit_mle(spark, spark.createDataFrame([(z, float(v)) for z, x in samples.items() for v in x], "zone int, v double"), "v").collect()}
    for z, v in samples.items():
        lo, hi = 0.2, 20.0
        if not f(lo, v) < 0 < f(hi, v):
            assert got[z].k_mle == got[z].k_mom
            continue
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if f(mid, v) < 0 else (lo, mid)
        assert got[z].k_mle == pytest.approx(lo, rel=1e-7) and got[z].c_mle == pytest.approx(((v / v.max()) ** lo).mean() ** (1 / lo) * v.max(), rel=1e-7)
    assert got[4].k_mle == got[4].k_mom


def test_near_pairs_are_pruned_at_probe_times(spark):
    """Groups of near stations among many, gaps, stations at one time only: the pairs of a full comparison, from few candidates."""
    rng = np.random.default_rng(3)
    rows, base = [], rng.uniform(0, 30, (20, 40))
    for z in range(120):
        v = base[z % 20] + rng.uniform(-0.24, 0.24, 40) if z < 60 else rng.uniform(0, 30, 40)
        keep = rng.random(40) > (0.5 if z % 10 == 0 else 0.05)
        rows += [(z, at(t), float(x), None if z % 7 == 0 else 1.0) for t, x in enumerate(v) if keep[t] and not (z == 119 and t > 0)]
    rows += [(200, at(t), 5.0, 1.0) for t in range(100, 110)] + [(201, at(t), 5.3, 1.0) for t in range(105, 120)] + [(202, at(3), None, None)]
    df = spark.createDataFrame(rows, "zone int, ts timestamp_ntz, u100 double, v100 double")
    by = {}
    for z, t, u, v in rows:
        by.setdefault(z, {})[t] = (u, v)
    want = {}
    for a in by:
        for b in by:
            diffs = [abs(x - y) for t in by[a].keys() & by[b].keys() for x, y in zip(by[a][t], by[b][t]) if x is not None and y is not None] if a < b else []
            if diffs and max(diffs) <= 0.5:
                want[a, b] = max(diffs)
    got = {(r.station_a, r.station_b): r.max_abs_diff for r in independence.near_duplicate_pairs(df, 0.5).collect()}
    assert got == pytest.approx(want, abs=6e-5) and len(want) >= 50
    candidates = independence.near_candidates(df, 0.5)
    assert candidates.count() == candidates.distinct().count() < 0.1 * len(by) ** 2 / 2
    assert independence.near_duplicate_pairs(df.limit(0), 0.5).count() == 0


@pytest.mark.parametrize("tile,times", [(3, 7), (64, 4096)])
def test_tiled_correlation_is_the_joins(spark, tile, times):
    rng = np.random.default_rng(6)
    rows = [(z, at(t), None if rng.random() < 0.2 else float(0.5 if z == 4 else rng.random() + z * (t % 5))) for z in range(1, 12) for t in range(30) if rng.random() > 0.1] + [(50, at(999), 1.0)]
    df = spark.createDataFrame(rows, "zone int, ts timestamp_ntz, power double")
    value = lambda d: {(r.station_a, r.station_b): (r.n, None if r["corr"] is None else round(r["corr"], 9)) for r in d.collect()}
    want = value(independence.correlation_pairs(df))
    assert value(independence.gram_correlation(df, tile=tile, times=times)) == want and len(want) == 55
    assert independence.gram_correlation(df.limit(0)).count() == 0


@pytest.mark.parametrize("hours", [5, 24, 10_000])
def test_chunks_of_time_are_whole_stations(spark, hours):
    """Gaps longer than chunks, runs over several chunks, rows without a time, missing and infinite values."""
    rng = np.random.default_rng(hours)
    rows = []
    for z in range(1, 5):
        t, v = 0, 1.0
        for _ in range(220):
            t += 1 if rng.random() < 0.9 else int(rng.integers(1, 60))
            if rng.random() < (0.12 if z % 2 else 0.6):
                v = float(rng.choice([1.0, 2.0, 9.5, np.inf])) if rng.random() < 0.9 else None
            rows.append((z, at(t), v, "x"))
    rows += [(9, None, 1.0, "x"), (9, at(3), 1.0, "x"), (9, at(900), 1.0, "x"), (8, at(1), None, "x")]
    df = spark.createDataFrame(rows, "zone int, ts timestamp_ntz, v double, jump string").repartition(4)
    same = lambda f: [sorted(map(repr, f(df, chunk_hours=h).collect())) for h in (None, hours)]
    for f in (
        lambda d, **k: features.lag_features(d, "v", **k),
        lambda d, **k: quality.frozen_runs(d, "v", 2, **k),
        lambda d, **k: quality.frozen_check(d, "v", **k),
        lambda d, **k: quality.jump_points(d, "v", **k),
        lambda d, **k: quality.jump_check(d, "v", **k),
        lambda d, **k: quality.station_qc_table(d, "v", **k),
    ):
        whole, chunks = same(f)
        assert whole == chunks and len(whole) > 3
    assert quality.station_qc_table(df.limit(0), "v", chunk_hours=hours).count() == 0
    assert features.lag_features(df, "v", chunk_hours=hours).columns == features.lag_features(df, "v").columns


def test_errors_of_zero_have_no_shares(spark):
    t = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 0.0), (2, 0.1, 0.2, 0.1, 0.0)], "zone int, a_rmse double, b_rmse double, c_mean double, c_sd double").withColumn("leak", F.col("b_rmse") - F.col("c_mean"))
    got = validation.relative_overestimate(validation.leakage_verdict(t)).orderBy("zone").collect()
    assert [(r.verdict, r.overestimate_pct, r.over_c_pct, r.over_a_pct) for r in got] == [("none", None, None, None), ("leak", 50.0, 100.0, 50.0)]


def test_weibull_root_beyond_the_ends(spark):
    v = {1: [9.0] * 300 + [8.9, 9.05], 2: [1e-9] * 40 + [5.0] * 40, 3: list(8 * np.random.default_rng(1).weibull(2.0, 300))}
    df = spark.createDataFrame([(z, float(x)) for z, xs in v.items() for x in xs], "zone int, v double")
    end, moments = ({r.zone: r for r in weibull.fit_mle(spark, df, "v", beyond=b).collect()} for b in ("end", "moments"))
    for z, k in ((1, 20.0), (2, 0.2)):
        x = np.array(v[z]) / max(v[z])
        assert end[z].k_mle == k and end[z].c_mle == pytest.approx((x**k).mean() ** (1 / k) * max(v[z]), rel=1e-9)
        assert moments[z].k_mle == moments[z].k_mom == end[z].k_mom != k
    assert tuple(end[3]) == pytest.approx(tuple(moments[3]), rel=1e-9) and 1.8 < end[3].k_mle < 2.2


def test_a_fit_without_rows_predicts_nothing_but_counts(spark):
    df = spark.createDataFrame([(1, at(i), float(i % 9), 1.0) for i in range(60)] + [(1, at(60), None, 1.0)], "zone int, ts timestamp_ntz, ws100 double, power double")
    got = curves.predict_cubic(df, curves.fit_cubic(df)).select(F.lit("cubic").alias("model"), "ws100", "power", "pred")
    assert {(r.ws100 is None, r.pred) for r in got.collect()} == {(True, None), (False, 0.0)}
    m = metrics.regression_metrics(got).first()
    assert (m.rmse, m.r2, m.accuracy_pct) == (1.0, None, 0.0)
    one = df.withColumn("ws100", F.lit(4.0))
    assert curves.predict_linear(one, curves.fit_linear(one)).select("pred").distinct().collect() == [(0.0,)]


def test_values_that_do_not_vary_are_told_in_parts(spark, tmp_path):
    """A mean of 98 ones, added up from parts, misses 1 by its last digit."""
    rows = [(z, at(i), 1.0) for z in (1, 2) for i in range(784)]
    for n in range(8):
        part = [r for r in rows if at(98 * n) <= r[1] < at(98 * n + 98)]
        spark.createDataFrame(part, "zone int, ts timestamp_ntz, power double").coalesce(1).write.mode("append").parquet(str(tmp_path / "p"))
    df = spark.read.parquet(str(tmp_path / "p"))
    assert [r["corr"] for r in independence.correlation_pairs(df).collect()] == [None]
    m = metrics.regression_metrics(df.withColumns({"model": F.lit("x"), "pred": F.lit(0.5)})).first()
    assert m.r2 is None and m.rmse == 0.5
    assert weibull.fit_moments(df, "power").where("k is not null").count() == 0


@pytest.mark.parametrize("tile,times", [(3, 7), (None, 4096)])
def test_near_pairs_by_tiles_are_the_joins(spark, tile, times):
    rng = np.random.default_rng(8)
    rows = [(z, at(t), None if rng.random() < 0.2 else float(rng.random() + z % 3), None if rng.random() < 0.5 else 1.0) for z in range(1, 14) for t in range(30) if rng.random() > 0.3] + [(50, at(999), 1.0, None)]
    df = spark.createDataFrame(rows, "zone int, ts timestamp_ntz, u100 double, v100 double")
    got = independence.near_pairs_by_tiles(df, 1.2, tile=tile, times=times).collect()
    want = independence.near_duplicate_pairs(df, 1.2).collect()
    assert {(r.station_a, r.station_b): (round(r.m, 4), round(r.s / r.n, 4)) for r in got} == {(r.station_a, r.station_b): (r.max_abs_diff, r.mean_abs_diff) for r in want}
    assert len(got) == len(want) >= 20


def test_near_pairs_of_many_alike_stations_go_by_tiles(spark):
    df = spark.createDataFrame([(z, at(t), float((z * t) % 5), 1.0) for z in range(200) for t in range(z % 4, 12, 2)], "zone int, ts timestamp_ntz, u100 double, v100 double")
    assert independence._near_candidates(df, 9.0, ("u100", "v100"), "zone", "ts", 6) is None
    by = {}
    for r in df.collect():
        by.setdefault(r.zone, {})[r.ts] = r.u100
    want = {(a, b): max(abs(by[a][t] - by[b][t]) for t in by[a].keys() & by[b].keys()) for a in by for b in by if a < b and by[a].keys() & by[b].keys()}
    got = independence.near_duplicate_pairs(df, 9.0, mean=False)
    assert got.columns == ["station_a", "station_b", "max_abs_diff"] and {(r[0], r[1]): r[2] for r in got.collect()} == want


def test_station_checks_in_parts_of_a_number(spark):
    rng = np.random.default_rng(4)
    rows = [(z, at(t), float(rng.integers(0, 3))) for z in (1, 2, None) for t in range(400) if rng.random() > 0.1] + [(1, None, 7.0)]
    df = spark.createDataFrame(rows, "zone int, ts timestamp_ntz, ws100 double")
    whole = quality.station_qc_table(df)
    got = quality.station_qc_table(df, chunk_hours=48, parts=23)
    assert sorted(map(str, got.collect())) == sorted(map(str, whole.collect()))
    assert features.lag_features(df.withColumnRenamed("ws100", "power"), chunk_hours=48, parts=23).rdd.getNumPartitions() == 23


def test_weibull_ends_where_there_are_no_moments(spark):
    few = [2.0, 5.0, 9.0]
    df = spark.createDataFrame([(1, 8.5)] * 12 + [(2, v) for v in few] + [(3, 0.0)] * 12, "zone int, v double")
    end, moments = ({r.zone: r for r in weibull.fit_mle(spark, df, "v", beyond=b).collect()} for b in ("end", "moments"))
    assert end[1].k_mle == 20 and end[1].c_mle == pytest.approx(8.5) and end[1].k_mom is None
    k, m = end[2].k_mle, np.log(few).mean()
    assert np.average(np.log(few), weights=np.power(few, k)) - 1 / k - m == pytest.approx(0, abs=1e-9)
    assert end[3].k_mle is None and all(r.k_mle is None for r in moments.values())


def test_tiles_meet_without_shuffling_stations_for_each_tile(spark):
    df = spark.createDataFrame([(z, at(t), float((z * t) % 7), 1.0) for z in range(120) for t in range(6)], "zone int, ts timestamp_ntz, u100 double, v100 double").repartition(4)
    sc, seen = spark.sparkContext, []

    def shuffled() -> int:
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._gateway.jvm.double, 0), sc._jvm.java.util.ArrayList())
        new = [stages.apply(i) for i in range(stages.size()) if stages.apply(i).stageId() not in seen]
        seen.extend(s.stageId() for s in new)
        return sum(s.shuffleWriteRecords() for s in new)

    shuffled()
    assert independence.near_pairs_by_tiles(df, 9.0, tile=1).count() == 120 * 119 // 2
    assert 720 <= shuffled() < 720 * 4  # 120 tiles: a row for each station and tile would be 14,400
