"""Controllers, the walk-forward, copulas and null distributions against plain loops and closed forms."""

import math
from collections import Counter
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.functions import dist
from plumbline.operators import controllers as C
from plumbline.operators import nulls, tail, walk


def plain_band(days, alpha):
    """(stated, level) of a calibrated quantile by a loop over lists; days: (centre, width, outcome), all stated but the first."""
    residuals, widths, size, level, total, before, out = [], [], None, alpha, 0.0, 0.0, []

    def reach(width):
        ratio = 1.0
        if len(widths) > 10:
            ratio = min(3.0, max(0.3, max(width, 1e-6) / max(float(np.median(widths)), 1e-6)))
        widths.append(max(width, 1e-6))
        del widths[:-500]
        return float(np.quantile(residuals, level)) * max(size, 1e-3) * ratio

    def keep(residual):
        nonlocal size
        size = abs(residual) if size is None else 2 / 169 * abs(residual) + (1 - 2 / 169) * size
        residuals.append(residual / max(size, 1e-3))
        del residuals[:-500]

    for i, (centre, width, outcome) in enumerate(days):
        if i == 0:
            keep(outcome - centre)
            continue
        stated = centre + reach(width)
        bound = centre + reach(width)
        error = (outcome < bound) - alpha
        keep(outcome - centre)
        total = min(50.0, max(-50.0, total + error))
        level = min(0.499, max(0.001, alpha - (0.03 * error + 0.0005 * total + 0.003 * (error - before))))
        before = error
        out.append((stated, level))
    return out


def test_band_walks_as_a_plain_loop_does():
    rng = np.random.default_rng(4)
    days = [(0.1 * rng.standard_normal(), 1 + rng.random(), rng.standard_t(4)) for _ in range(700)]
    band, got = C.Band(0.025), []
    for i, (centre, width, outcome) in enumerate(days):
        if i:
            value, band = C.stated(band, centre, width)
        band = C.after_outcome(band, centre, width, outcome, 0.025)
        if i:
            got.append((value, band.level))
    assert np.allclose(got, plain_band(days, 0.025))
    assert len(band.widths) == len(band.residuals) == C.KEEP


def test_a_day_leaves_two_widths_and_the_band_before_is_untouched():
    band = C.Band(0.05)
    for x in np.linspace(-1, 1, 30):
        band = C.absorbed(band, float(x))
    value, seen = C.stated(band, 0.0, 1.0)
    after = C.after_outcome(seen, 0.0, 1.0, value - 5, 0.05)
    assert len(band.widths) == 0 and len(seen.widths) == 1 and len(after.widths) == 2
    assert after.level < 0.05 == band.level
    for _ in range(3000):
        after = C.after_outcome(after, 0.0, 1.0, 5.0, 0.05)
    assert C.LEVEL_BOUNDS[0] <= after.level <= C.LEVEL_BOUNDS[1]


def test_depth_moves_on_breaches_only_and_never_lifts_a_shortfall():
    depth = C.Depth()
    assert C.after_breach(depth, -9.0, -1.0, False) is depth and C.after_breach(depth, -9.0, 0.0, True) is depth
    first = C.after_breach(depth, -1.5, -1.0, True)  # error -0.5, so the factor grows by 0.15, 0.01 and 0.05 of it
    assert first.log == pytest.approx(0.5 * 0.21) and first.moves == 1
    for _ in range(50):
        depth = C.after_breach(depth, -3.0, -1.0, True)
    assert depth.factor == 3.0 and C.deepened(depth, -1.0, -1.5) == -2.5 and C.deepened(depth, -1.0, -0.5) == -1.0
    for _ in range(200):
        depth = C.after_breach(depth, -0.1, -1.0, True)
    assert depth.factor == 0.5


def returns(n, k=3, seed=1):
    rng = np.random.default_rng(seed)
    e, v, out = rng.standard_t(5, (n, k)) * math.sqrt(3 / 5), np.full(k, 1e-4), np.empty((n, k))
    for i in range(n):
        out[i] = np.sqrt(v) * e[i]
        v = 2e-6 + 0.08 * out[i] ** 2 + 0.90 * v
    return out


def test_garch_finds_what_made_the_series():
    g = walk.fit_garch(returns(4000, 1)[:, 0] * 100)
    assert 0.04 < g.a < 0.14 and 0.84 < g.b < 0.95 and 3.5 < g.nu < 8 and abs(g.mu) < 0.05
    plain = walk.fit_garch(returns(4000, 1)[:, 0] * 100, student=False)
    assert plain.nu is None and 0.9 < plain.a + plain.b < 1


def test_the_fit_keeps_a_mean_and_is_no_worse_than_its_neighbours():
    r = returns(600, 1)[:, 0] * 100 + 0.5
    g = walk.fit_garch(r)
    assert g.mu == pytest.approx(0.5, abs=0.15)
    best = walk.loss(r - g.mu, g.omega, g.a, g.b, g.nu)
    for f in (0.8, 1.25):
        assert best <= walk.loss(r - g.mu, f * g.omega, g.a, g.b, g.nu) + 0.05 and best <= walk.loss(r - g.mu, g.omega, f * g.a, g.b, g.nu) + 0.05
        assert best <= walk.loss(r - f * g.mu, g.omega, g.a, g.b, g.nu) + 0.05


def test_t_functions_against_their_series():
    for nu in (2.5, 4.0, 9.0, 60.0):
        x = np.array([-30.0, -3.0, -0.4, 0.0, 0.7, 5.0])
        assert np.allclose(walk.t_cdf(x, nu), [dist.t_cdf(v, nu) for v in x], atol=1e-7)
        p = np.array([1e-4, 0.01, 0.3, 0.5, 0.9, 0.9999])
        assert np.allclose(walk.t_quantile(p, nu), [dist.t_quantile(float(v), nu) for v in p], rtol=1e-4, atol=1e-6)


def test_both_copulas_have_the_same_marginals_and_only_the_t_one_has_joint_extremes():
    corr, nus = np.array([[1, 0.5], [0.5, 1]]), [5.0, 8.0]
    draws = {df: walk.copula_draws(corr, nus, df, draws=200_000, seed=3) for df in (None, 4.0)}
    for k, nu in enumerate(nus):
        for p in (0.01, 0.1, 0.5, 0.95):
            want = dist.t_quantile(p, nu)
            for x in draws.values():
                assert np.quantile(x[:, k], p) == pytest.approx(want, abs=0.03 + 0.03 * abs(want))
    both = {df: np.mean((x < np.quantile(x, 0.005, axis=0)).all(axis=1)) for df, x in draws.items()}
    assert both[4.0] > 1.7 * both[None]


def test_walk_states_possible_pairs_at_about_their_level():
    r, w = returns(1300), np.array([0.5, 0.3, 0.2])
    rows = list(walk.walk(r, w, ["a", "b", "c"], [0.01, 0.025], fit=400, warm=300))
    assert len(rows) == 600 * 2 * 4 * 3
    assert all(es <= var + 1e-12 for _, _, _, _, var, es, *_ in rows)
    hits, n = Counter(), Counter()
    for _, method, alpha, asset, var, _, real, breached, *_ in rows:
        assert breached == (real < var)
        hits[method, alpha, asset] += breached
        n[method, alpha, asset] += 1
    assert all(0.005 <= hits[m, 0.025, a] / n[m, 0.025, a] <= 0.06 for m in ("conformal_pid", "conformal_pid_es") for a in ("", "a", "b", "c"))
    assert all(real == pytest.approx(float(r[i] @ w)) for i, _, _, asset, _, _, real, *_ in rows if asset == "")


def test_calibrated_rows_are_the_controllers_on_the_models_own_forecasts():
    """The walk's book and assets against the pure transitions fed with the uncalibrated rows."""
    r, w = returns(760), np.array([0.5, 0.3, 0.2])
    every = list(walk.walk(r, w, ["a", "b", "c"], [0.025], fit=400, warm=0, refit=50))
    rows = {(i, m, a): (var, es, real) for i, m, _, a, var, es, real, *_ in every}
    joint, variance = walk.fit_joint(r[:400] * 100)
    band, depth = C.Band(0.025), C.Depth()
    for i in range(400, 440):
        if i > 400:
            variance = np.array([g.next(x, v) for g, x, v in zip(joint.marginals, r[i - 1] * 100, variance, strict=True)])
        base = walk.Empirical(joint.draws * (np.sqrt(variance) / 100) @ w)
        sees, plain, real = walk.signal(base), base.quantile(0.025), float(r[i] @ w)
        var = plain
        if len(band.residuals):
            var, band = C.stated(band, *sees)
        es = base.below(var)
        assert rows[i, "distributional", ""] == pytest.approx((plain, base.below(plain), real))
        assert rows[i, "conformal_pid", ""] == pytest.approx((var, es, real))
        stated = C.deepened(depth, var, es)
        assert rows[i, "conformal_pid_es", ""] == pytest.approx((var, stated, real))
        depth = C.after_breach(depth, real, stated, real < var)
        band = C.after_outcome(band, *sees, real, 0.025)


def test_books_are_walked_one_by_one(spark):
    r = returns(560, 2)
    frame = pd.DataFrame([(b, pd.Timestamp("2020-01-01") + pd.Timedelta(days=i), a, float(r[i, k])) for b in ("x", "y") for i in range(560) for k, a in enumerate("AB")], columns=["book", "date", "asset", "r"])
    df = spark.createDataFrame(frame).withColumn("date", F.to_date("date"))
    got = walk.walk_books(df, {"A": 0.6, "B": 0.4}, [0.025], fit=400, warm=150).toPandas()
    want = list(walk.walk(r, np.array([0.6, 0.4]), ["A", "B"], [0.025], fit=400, warm=150))
    for book in ("x", "y"):
        mine = got[got["book"] == book]
        assert np.allclose(sorted(mine["var"]), sorted(x[4] for x in want)) and len(mine) == len(want)


def test_parametric_rows_against_a_loop(spark):
    r, weights = returns(130), {"A": 0.5, "B": 0.3, "C": 0.2}
    rows = [(pd.Timestamp("2020-01-01") + pd.Timedelta(days=i), a, float(r[i, k])) for i in range(130) for k, a in enumerate("ABC")]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["date", "asset", "r"])).withColumn("date", F.to_date("date"))
    got = {(str(x["date"]), x["asset"]): x for x in tail.parametric(df, weights, [0.01], rows=100).collect()}
    assert len(got) == 30 * 4
    n, w = NormalDist(), np.array([0.5, 0.3, 0.2])
    for i in range(100, 130):
        day, past = str((pd.Timestamp("2020-01-01") + pd.Timedelta(days=i)).date()), r[i - 100 : i]
        v = past[0] ** 2
        for x in past[1:]:
            v = 0.94 * v + 0.06 * x * x
        cov = np.corrcoef(past.T) * np.outer(np.sqrt(v), np.sqrt(v))
        for asset, sigma in zip(["", "A", "B", "C"], [math.sqrt(w @ cov @ w), *np.sqrt(v)], strict=True):
            assert got[day, asset]["sigma"] == pytest.approx(sigma)
            assert got[day, asset]["var"] == pytest.approx(sigma * n.inv_cdf(0.01), abs=1e-11) and got[day, asset]["es"] == pytest.approx(-sigma * n.pdf(n.inv_cdf(0.01)) / 0.01)


def test_simulated_paths_have_the_counts_of_independent_days(spark):
    """By gaps or day by day: mean and spread of breaches and of successive ones, and counts that add up."""
    cells = spark.createDataFrame([("x", 0.05, 400), ("y", 0.0, 50)], "m string, alpha double, n int")
    got = tail.simulated_breaches(cells.withColumn("p", F.col("alpha")), 3000, "s", "m", "alpha").toPandas()
    x, y = got[got["m"] == "x"], got[got["m"] == "y"]
    assert len(x) == len(y) == 3000 and (y["breaches"] == 0).all() and (y["n00"] == 49).all()
    assert (x[["n00", "n01", "n10", "n11"]].sum(axis=1) == 399).all()
    assert x["breaches"].mean() == pytest.approx(20, abs=0.4) and x["breaches"].std() == pytest.approx(math.sqrt(19), abs=0.3)
    assert x["n11"].mean() == pytest.approx(399 * 0.0025, abs=0.1)
    assert ((x["n01"] + x["n11"] - x["breaches"]).isin([0, -1])).all()


def test_p_values_against_a_plain_simulation(spark):
    rng = np.random.default_rng(8)
    hits = (rng.random(500) < 0.04) | np.r_[False, rng.random(499) < 0.02]
    rows = [(0.025, i, bool(h)) for i, h in enumerate(hits)]
    stats = tail.breach_stats(spark.createDataFrame(rows, "alpha double, date int, breached boolean"), "alpha")
    p = tail.simulated_p_values(stats, "alpha", draws=2000).first()

    def ratio(x):
        n, k = len(x), int(x.sum())
        ll = lambda k, n, q: (k * math.log(q) if k else 0.0) + ((n - k) * math.log(1 - q) if n - k else 0.0)
        pof = max(0.0, -2 * (ll(k, n, 0.025) - ll(k, n, k / n)))
        a, b = x[:-1], x[1:]
        n01, n11, n0, n1 = int((~a & b).sum()), int((a & b).sum()), int((~a).sum()), int(a.sum())
        q = (n01 + n11) / (n - 1)
        ind = max(0.0, -2 * (ll(n01 + n11, n - 1, q) - ll(n01, n0, n01 / n0) - (ll(n11, n1, n11 / n1) if n1 else 0.0)))
        return pof, ind

    seen = ratio(hits)
    at_alpha = [ratio(rng.random(500) < 0.025) for _ in range(1500)]
    at_rate = [ratio(rng.random(500) < hits.mean()) for _ in range(1500)]
    assert p["kupiec_p"] == pytest.approx(np.mean([x[0] >= seen[0] - 1e-9 for x in at_alpha]), abs=0.04)
    assert p["independence_p"] == pytest.approx(np.mean([x[1] >= seen[1] - 1e-9 for x in at_rate]), abs=0.05)
    assert p["conditional_p"] == pytest.approx(np.mean([sum(x) >= sum(seen) - 1e-9 for x in at_alpha]), abs=0.04)


def test_statistics_and_zones_by_hand():
    x = np.array([[-2.0, 1.0, -4.0], [1.0, 1.0, 1.0]])
    z1, z2 = nulls.statistics(x, np.full(3, -1.5), np.full(3, -2.0), 0.5)
    assert z1[0] == pytest.approx(-1.5 + 1) and math.isnan(z1[1])
    assert z2.tolist() == pytest.approx([-3 / 1.5 + 1, 1.0])
    null = np.arange(1000.0)
    assert nulls.zoned(60.0, null)[3] == "green" and nulls.zoned(10.0, null)[3] == "yellow" and nulls.zoned(-1.0, null)[3] == "red"
    assert nulls.zoned(math.nan, null)[3] is None and nulls.zoned(49.0, null)[0] == pytest.approx(0.05)
    assert nulls.df_of("t_moment", np.full(5, 0.05)) is None and nulls.df_of("t_moment", np.full(5, 6.0)) == 5.0 and nulls.df_of("t_moment", np.full(5, 60.0)) == 4.5


@pytest.fixture(scope="module")
def swept(spark):
    """A right normal model, one that states too little, and both broken ones."""
    rng = np.random.default_rng(2)
    n, z, k = 900, NormalDist().inv_cdf(0.025), NormalDist()
    sigma = 0.01 * (1 + 0.3 * np.sin(np.arange(n) / 50))
    x = sigma * rng.standard_normal(n)
    rows = [(pd.Timestamp("2020-01-01") + pd.Timedelta(days=i), m, 0.025, f * z * s, -f * s * k.pdf(z) / 0.025, float(v), 0.0, f * s, 0.0) for m, f in (("right", 1.0), ("low", 0.6)) for i, (s, v) in enumerate(zip(sigma.tolist(), x, strict=True))]
    book = spark.createDataFrame(pd.DataFrame(rows, columns=["date", "method", "alpha", "var", "es", "realized", "mu", "sigma", "kurt"]))
    return nulls.sweep(nulls.with_broken(book, "right"), draws=400)


def test_sweep_passes_a_right_model_and_fails_a_low_one(swept):
    got = {(r["method"], r["null"]): r for r in swept.collect()}
    assert len(got) == 4 * len(nulls.NULLS)
    assert got["right", "gaussian"]["z1_zone"] == got["right", "gaussian"]["z2_zone"] == "green"
    assert got["low", "gaussian"]["z2_zone"] == "red" and got["low", "empirical"]["z2_zone"] != "red"
    assert got["right", "t_moment"]["df"] is None or math.isnan(got["right", "t_moment"]["df"])
    # fatter nulls have lower thresholds, and a normal model's normal twin is itself
    assert got["right", "t_df5"]["z1_green"] < got["right", "t_df15"]["z1_green"] < got["right", "gaussian"]["z1_green"] + 0.02
    assert got["broken_normal", "gaussian"]["z1"] == pytest.approx(got["right", "gaussian"]["z1"])
    z1, z2, n, b = (got["low", "gaussian"][c] for c in ("z1", "z2", "n", "breaches"))
    assert z2 == pytest.approx(1 + b / (n * 0.025) * (z1 - 1))


def test_flips_and_findings_by_hand(spark):
    zones = {"gaussian": ("red", "green"), "t_moment": ("yellow", "green"), "t_df5": ("green", "green"), "t_df8": ("yellow", "green"), "t_df15": ("red", "green"), "empirical": ("green", "red")}
    rows = [(m, 0.01, n, *z, -1.0, 0.1) for m in ("one", "broken_normal", "broken_scaled") for n, z in zones.items()]
    df = spark.createDataFrame(rows, "method string, alpha double, null string, z1_zone string, z2_zone string, z1 double, z1_green double")
    got = {(r["method"], r["statistic"]): (r["zones"], r["zone_changes"], r["pass_changes"]) for r in nulls.flips(df).collect()}
    assert got["one", "z1"] == (3, True, True) and got["one", "z2"] == (1, False, False)
    found = {r["statistic"]: (r["share_changed"], r["missed"]) for r in nulls.test_findings(df).collect()}
    assert found == {"z1": (1.0, 0), "z2": (0.0, 2)}
    effects = nulls.process_effects(df.withColumn("z1", F.lit(-1.5)), df, "one").first()
    assert effects["model_effect"] == 0.5 and effects["reference_effect"] == 0.0 and effects["zone_model_alone"] == "red"


def test_closed_forms_of_the_distribution_table():
    for nu, p, q, cdf, es in dist.table([0.01, 0.05], [None, 6.0]):
        assert cdf == pytest.approx(p, abs=1e-9) and es < q
        x = np.linspace(-60, q, 400_001)
        f = np.array([NormalDist().pdf(v) for v in x[::100]]) if nu is None else np.array([dist.t_density(v * math.sqrt(6 / 4), nu) * math.sqrt(6 / 4) for v in x[::100]])
        assert np.trapezoid(x[::100] * f, x[::100]) / p == pytest.approx(es, rel=2e-2)


def test_stream_states_what_the_batch_states(spark, tmp_path):
    import datetime as dt

    from plumbline.streaming.calibrated import calibrated_stream

    rng = np.random.default_rng(14)
    days = [(float(c), float(w), float(x)) for c, w, x in zip(0.1 * rng.standard_normal(90), 1 + rng.random(90), rng.standard_normal(90), strict=True)]
    rows = [(b, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), c, w, x + k) for k, b in enumerate("xy") for i, (c, w, x) in enumerate(days)]
    df = spark.createDataFrame(rows, "book string, ts timestamp, centre double, width double, outcome double")
    for n in range(3):  # files in the order of time
        hour = (F.unix_timestamp("ts") - 1704067200) / 3600
        df.where((hour >= 30 * n) & (hour < 30 * (n + 1))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = calibrated_stream(stream, 0.05).writeStream.format("memory").queryName("calibrated_out").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    out.awaitTermination(120)
    for k, book in enumerate("xy"):
        got = spark.table("calibrated_out").where(F.col("book") == book).orderBy("ts").collect()
        want = plain_band([(c, w, x + k) for c, w, x in days], 0.05)
        assert len(got) == len(want) == 89
        assert np.allclose([r["stated"] for r in got], [v for v, _ in want])
        assert np.allclose([r["level"] for r in got[1:]], [v for _, v in want[:-1]])
