"""Forests, interval constructions, folds from sums, order statistics and the integrity battery against plain versions."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import clustered, folds, integrity
from plumbline.operators import resample as R
from plumbline.operators.forest import Filler, Forest


def plain_tree(x, y, leaf):
    """Best split by trying all, node by node."""

    def grow(rows):
        best = None
        for f in range(x.shape[1]):
            by = rows[np.argsort(x[rows, f], kind="stable")]
            for k in range(leaf, len(by) - leaf + 1):
                if k < len(by) and x[by[k], f] > x[by[k - 1], f]:
                    a, b = y[by[:k]], y[by[k:]]
                    gain = a.sum() ** 2 / len(a) + b.sum() ** 2 / len(b) - y[rows].sum() ** 2 / len(rows)
                    if gain > 1e-12 and (best is None or gain > best[0] + 1e-12):
                        best = gain, f, (x[by[k], f] + x[by[k - 1], f]) / 2
        if best is None:
            return float(y[rows].mean())
        left = x[rows, best[1]] <= best[2]
        return best[1], best[2], grow(rows[left]), grow(rows[~left])

    return grow(np.arange(len(x)))


def follow(tree, v):
    while isinstance(tree, tuple):
        tree = tree[2] if v[tree[0]] <= tree[1] else tree[3]
    return tree


def test_every_tree_is_the_one_that_trying_all_splits_gives():
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 6, (50, 3)).astype(float), rng.standard_normal(50)
    forest = Forest(6, 3, seed=5).fit(x, y)
    drawn = np.random.default_rng(5).integers(0, 50, (6, 50))
    for k in range(6):
        tree = plain_tree(x[drawn[k]], y[drawn[k]], 3)
        assert np.allclose(forest.each(x)[:, k], [follow(tree, v) for v in x])
    assert np.array_equal(forest.in_bag[2], np.isin(np.arange(50), drawn[2]))


def test_out_of_bag_errors_are_honest():
    rng = np.random.default_rng(1)
    x = rng.random((300, 4))
    y = 3 * x[:, 0] + (x[:, 1] > 0.5) + 0.3 * rng.standard_normal(300)
    forest, fresh = Forest(100, 2).fit(x, y), rng.random((500, 4))
    truth = 3 * fresh[:, 0] + (fresh[:, 1] > 0.5) + 0.3 * rng.standard_normal(500)
    inside, free, out = (np.abs(a - b).mean() for a, b in ((forest.predict(x), y), (forest.out_of_bag(x), y), (forest.predict(fresh), truth)))
    assert inside < 0.7 * free and free == pytest.approx(out, rel=0.15)
    few = Forest(100, 2, features=None).fit(x, y)
    assert np.abs(few.predict(fresh) - truth).mean() < 0.6


def test_constant_features_and_one_row():
    assert np.allclose(Forest(3).fit(np.ones((5, 2)), np.arange(5.0)).predict(np.zeros((1, 2))), [2], atol=1.5)
    assert Forest(3).fit(np.ones((1, 1)), np.array([7.0])).predict(np.ones((2, 1))).tolist() == [7.0, 7.0]


def test_medians_and_marks_of_missing_values():
    fill = Filler(np.array([[1.0, np.nan], [3.0, np.nan], [np.nan, np.nan], [5.0, np.nan]]))
    assert fill(np.array([[np.nan, 2.0], [4.0, np.nan]])).tolist() == [[3.0, 2.0, 1.0, 0.0], [4.0, 0.0, 0.0, 1.0]]


def test_radius_is_the_higher_quantile_one_above():
    assert clustered.radius(np.arange(1.0, 41), 0.1) == 38 and clustered.radius(np.arange(1.0, 6), 0.1) == 5 and clustered.radius(np.array([])) == math.inf


def test_bucketed_radii_fall_back_to_the_pooled_one():
    residuals, predicted = np.arange(1.0, 21), np.r_[np.full(16, 0.2), np.full(4, 0.9)]
    assert clustered.mondrian(residuals, predicted, 0.6, 99.0) == (16.0, 99.0)
    assert clustered.mondrian(residuals, np.r_[np.full(15, 0.2), np.full(5, 0.9)], 0.6, 99.0) == (15.0, 20.0)


def test_six_half_widths_of_a_fold_by_hand():
    rng = np.random.default_rng(3)
    case = np.repeat([f"c{k}" for k in range(8)], 9)
    x, y = rng.random((72, 2)), rng.random(72)
    train = np.flatnonzero(case != "c0")
    cal_cases, cal_rows = np.array(["c1", "c2"]), train[:18]
    whole = clustered.Model(x[train], y[train], 40)
    got = clustered.fold(x, y, case, "c0", cal_cases, cal_rows, whole, 0.5, 40)
    cal, fit = train[np.isin(case[train], cal_cases)], train[~np.isin(case[train], cal_cases)]
    model = clustered.Model(x[fit], y[fit], 40)
    error = np.abs(y[cal] - model(x[cal]))
    assert got["pred"] == pytest.approx(whole(x[:9])) and np.all(got["C_grp"] == clustered.radius(error))
    assert got["G"][0] == pytest.approx(1.645 * np.sqrt(np.mean((y[train] - whole(x[train])) ** 2)))
    assert got["G_cal"][0] == pytest.approx(1.645 * np.std(y[cal] - model(x[cal]), ddof=1))
    rowed = clustered.Model(x[train[18:]], y[train[18:]], 40)
    assert got["C_row"][0] == clustered.radius(np.abs(y[cal_rows] - rowed(x[cal_rows])))
    assert np.all(got["sigma"] >= clustered.LEAST_SIGMA) and np.ptp(got["C_norm"] / got["sigma"]) < 1e-9
    hot = model(x[cal]) >= 0.5
    for p, q in zip(got["pred"], got["C_mond"], strict=True):
        mine = error[hot] if p >= 0.5 else error[~hot]
        assert q == (clustered.radius(mine) if len(mine) >= 5 else clustered.radius(error))


def test_held_out_cases_and_their_coverage(spark):
    rng = np.random.default_rng(4)
    rows = [(int(k), f"c{k % 6}", float(rng.random()), float(rng.random()), None if k % 9 == 0 else float(rng.random())) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, case string, y double, u double, v double")
    scored = clustered.held_out(df, {"one": ["u"], "two": ["u", "v"]}, seeds=3, trees=20)
    got = scored.toPandas()
    assert len(got) == 60 * 2 * 3 and set(got["variant"]) == {"one", "two"}
    again = clustered.held_out(df.repartition(5), {"one": ["u"], "two": ["u", "v"]}, seeds=3, trees=20).toPandas()
    key = ["variant", "seed", "id"]
    assert np.allclose(got.sort_values(key)["C_norm"], again.sort_values(key)["C_norm"])
    table = {(r["variant"], r["construction"]): r for r in clustered.coverage(scored, "variant").collect()}
    one = got[got["variant"] == "two"]
    hit = (one["y"] - one["pred"]).abs() <= one["C_grp"]
    assert table["two", "C_grp"]["coverage"] == pytest.approx(hit.groupby(one["seed"]).mean().mean())
    assert table["two", "C_grp"]["width"] == pytest.approx((2 * one["C_grp"]).groupby(one["seed"]).median().mean())
    assert table["two", "C_grp"]["worn"] == pytest.approx(hit[one["y"] >= 0.6].groupby(one["seed"]).mean().mean())


def test_held_out_cases_are_fitted_by_many_tasks(spark):
    """All cells once went to one task, as their rows are few."""
    rows = [(k, f"c{k % 6}", float(k % 7), float(k % 5)) for k in range(36)]
    df = spark.createDataFrame(rows, "id long, case string, y double, u double")
    scored = clustered.held_out(df, {v: ["u"] for v in ("one", "two", "three")}, seeds=1, trees=2)
    got = scored.groupBy(F.spark_partition_id().alias("p")).agg(F.count_distinct("variant", "case").alias("cells")).collect()
    assert sum(r["cells"] for r in got) == 18 and len(got) >= 9


def test_rows_promise_too_much_when_groups_share_an_effect_and_leaks_make_it_worse(spark):
    got = {(r["split"], r["rho"]): r for r in clustered.simulation(spark, rhos=[0.0, 0.8], repetitions=24, leaks=(0.0, 1.0), trees=40).collect()}
    assert got["group", 0.8]["coverage"] > got["row", 0.8]["coverage"] + 0.05
    assert abs(got["group", 0.0]["coverage"] - got["row", 0.0]["coverage"]) < 0.05
    assert got["leak 0", 0.8]["coverage"] == got["group", 0.8]["coverage"] > got["leak 1", 0.8]["coverage"] + 0.2


def test_order_statistics_by_digits(spark):
    rng = np.random.default_rng(6)
    rows = [(g, int(v)) for g in "abc" for v in np.r_[rng.integers(0, 1 << 40, 400), rng.integers(0, 5, 300), np.full(50, 1 << 30)]]
    values = spark.createDataFrame(rows, "g string, v long")
    ks = [("a", 1), ("b", 375), ("c", 750)]
    got = {r["g"]: r["v"] for r in folds.kth(values, spark.createDataFrame(ks, "g string, k long"), "g").collect()}
    assert got == {g: sorted(v for h, v in rows if h == g)[k - 1] for g, k in ks}


def test_half_widths_against_fits_on_the_rows_themselves(spark):
    rng = np.random.default_rng(7)
    rows = [(i, f"g{i % 5}", float(rng.integers(0, 20)), float(rng.normal())) for i in range(150)]
    rows = [(i, g, x, y + 0.3 * x + "g0g1g2g3g4".index(g)) for i, g, x, y in rows]
    df = spark.createDataFrame(rows, "id long, g string, x double, y double")
    draw = R.draw("split", "rep", "id")
    part = {(r["rep"], r["id"]): r["p"] for r in df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(24)))).select("rep", "id", F.pmod(draw, F.lit(5)).alias("p")).collect()}
    got = {r["g"]: r for r in folds.half_widths(df, draw).collect()}
    ids, g, x, y = (np.array(c) for c in zip(*rows, strict=True))

    def line(m):
        n, mx, my = m.sum(), x[m].mean(), y[m].mean()
        sd = x[m].std(ddof=1)
        z = (x[m] - mx) / sd
        slope = (z @ (y[m] - my)) / (z @ z + 1) / sd
        return slope, my - slope * mx, n

    def miss(m, at):
        slope, base, _ = line(m)
        return np.abs(y[at] - base - slope * x[at])

    def quantile(a):
        return np.sort(a)[min(len(a), math.ceil((len(a) + 1) * 0.9)) - 1]

    for held in ("g0", "g3"):
        train = g != held
        slope, base, _ = line(train)
        assert (got[held]["slope"], got[held]["base"]) == pytest.approx((slope, base))
        assert got[held]["hw_insample"] == pytest.approx(1.6448536269514722 * np.std(y[train] - base - slope * x[train], ddof=1))
        grouped = np.concatenate([miss(train & (g != inner), train & (g == inner)) for inner in set(g) - {held}])
        assert got[held]["hw_group"] == pytest.approx(quantile(grouped), abs=2e-6)
        reps = []
        for rep in range(25):
            p = np.array([part[rep, int(i)] for i in ids])
            reps.append(quantile(np.concatenate([miss(train & (p != k), train & (p == k)) for k in range(5)])))
        assert got[held]["hw_row"] == pytest.approx(np.mean(reps), abs=2e-6)



def test_half_widths_join_no_rows_and_count_residuals_of_any_size(spark):
    """Rows meet lines by themselves (the multiplied rows were joined, and broadcast where their file was small), and residuals
    over 2^48 millionths are counted like others."""
    rng = np.random.default_rng(8)
    rows = [(i, None if i % 50 == 49 else f"g{i % 4}", float(rng.integers(0, 9)), None if i % 40 == 7 else float(rng.normal())) for i in range(160)]
    draw = R.draw("split", "rep", "id")
    plain, huge = (folds.half_widths(spark.createDataFrame([(i, g, x, None if y is None else y * f) for i, g, x, y in rows], "id long, g string, x double, y double"), draw) for f in (1.0, 1e10))
    assert "Join" not in plain._jdf.queryExecution().executedPlan().toString()
    a, b = ({r["g"]: r for r in df.collect()} for df in (plain, huge))
    assert sorted(a) == sorted(b) == ["g0", "g1", "g2", "g3"]
    for g in a:
        for c in ("hw_insample", "hw_group", "hw_row"):
            assert b[g][c] == pytest.approx(1e10 * a[g][c], rel=1e-5)
    assert folds.half_widths(spark.createDataFrame([], "id long, g string, x double, y double"), draw).count() == 0


def panel(spark, shift=0, solar=0.0, drop=None):
    rng = np.random.default_rng(5)
    rows = []
    for day in range(30):
        sun = [max(0.0, math.sin((s - 5) / 14 * math.pi)) * (2 if day >= 15 else 1) * 10 for s in range(24)]
        for s in range(24):
            if (day, s) != drop:
                act = 100 + 10 * math.sin((s - 6) / 24 * 2 * math.pi) + solar * sun[s] + rng.normal() * 0.1
                fc = 100 + 10 * math.sin((s - 6 - shift) / 24 * 2 * math.pi) - 0.05
                rows.append((dt.date(2024, 1, 1) + dt.timedelta(days=day), s, act, fc, sun[s]))
    return spark.createDataFrame(rows, "date date, slot int, act double, fc double, sun double")


def test_battery_tells_a_fault_from_a_property(spark):
    reference = spark.createDataFrame([(100.0,)], "reference double")
    fresh = lambda p: p.select("date", "slot", F.col("act").alias("x"))
    control = panel(spark)

    def verdicts(main, other=None, pulled=None):
        rows = integrity.battery(main, other or control, pulled or fresh(main), reference).collect()
        return {r["test"][:2]: r["passes"] for r in rows}, next(r["test"] for r in rows if r["test"].startswith("conclusion"))

    netted = panel(spark, solar=1.0).cache()
    got, said = verdicts(netted)
    assert all(got[k] for k in ("01", "02", "04", "05", "06", "07", "09", "10")) and got["08"] is None and said.endswith(": a property of the series")
    moved = panel(spark, shift=3).cache()
    got, said = verdicts(moved)
    assert not got["04"] and not got["07"] and "fault" in said
    holed = panel(spark, solar=1.0, drop=(3, 4)).cache()
    got, said = verdicts(holed)
    assert not got["01"] and "fault" in said
    got, said = verdicts(control.cache())
    assert not got["06"] and not got["07"] and "in part" in said
    got, said = verdicts(netted, pulled=fresh(netted).withColumn("x", F.col("x") + 1))
    assert not got["10"] and "fault" in said
    got, _ = verdicts(netted, other=netted)
    assert not got["09"]
    floor = integrity.night_floor(control).first()
    assert floor["mean"] == pytest.approx(0.05, abs=0.02)


def test_platt_recovers_the_slope_of_a_logistic(spark):
    from plumbline.operators.models import platt

    rng = np.random.default_rng(8)
    p = rng.uniform(0.02, 0.98, 6000)
    logit = np.log(p / (1 - p))
    y = rng.random(6000) < 1 / (1 + np.exp(-(0.5 * logit - 0.7)))
    df = platt(spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y, strict=True)], "p double, y int")).toPandas()
    slope, base = np.polyfit(np.log(df["p"] / (1 - df["p"])), np.log(df["platt"] / (1 - df["platt"])), 1)
    assert slope == pytest.approx(0.5, abs=0.06) and base == pytest.approx(-0.7, abs=0.1)
    assert np.abs(np.log(df["platt"] / (1 - df["platt"])) - slope * np.log(df["p"] / (1 - df["p"])) - base).max() < 1e-6


def pooled(p, y):
    """Isotonic fit by pooling adjacent violators, by distinct p."""
    blocks = [[y[p == v].sum(), (p == v).sum(), [v]] for v in np.unique(p)]
    k = 0
    while k + 1 < len(blocks):
        if blocks[k][0] / blocks[k][1] > blocks[k + 1][0] / blocks[k + 1][1]:
            a, b = blocks[k], blocks.pop(k + 1)
            blocks[k] = [a[0] + b[0], a[1] + b[1], a[2] + b[2]]
            k = max(0, k - 1)
        else:
            k += 1
    return {v: s / n for s, n, vs in blocks for v in vs}


def test_isotonic_pools_adjacent_violators(spark):
    from plumbline.operators.models import isotonic

    rng = np.random.default_rng(9)
    p = np.round(rng.random(400), 2)
    y = (rng.random(400) < p**2).astype(float)
    got = isotonic(spark.createDataFrame([(float(a), float(b)) for a, b in zip(p, y, strict=True)], "p double, y double")).collect()
    want = pooled(p, y)
    assert all(r["isotonic"] == pytest.approx(want[r["p"]]) for r in got)


def test_true_models_have_the_thresholds_of_their_tails(spark, small):
    """With the true VaR and ES both statistics centre on zero; fatter tails and rarer levels have lower 5th percentiles."""
    from plumbline.plans import catalog

    got = {(r["alpha"], r["nu"]): r for r in catalog.queries()["t28_exact_null_stability"](spark, small).collect()}
    for alpha in (0.01, 0.025):
        z1 = [got[alpha, nu]["z1_p5"] for nu in (4.0, 8.0, 1e6)]
        assert z1[0] < z1[1] < z1[2] < 0
    assert all(got[0.01, nu]["z2_p5"] < got[0.025, nu]["z2_p5"] < 0 for nu in (4.0, 8.0, 1e6))
