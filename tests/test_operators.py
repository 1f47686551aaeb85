"""Closed forms, identities, rule tables and negative controls."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import dist, ordered
from plumbline.operators import bands, groups, panel, probs, resample, rules, sequential, tail


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_global_ranks_need_no_single_sort(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 503).alias("v"), "id").repartition(6)
    got = ordered.rank0(df, ["v", "id"]).orderBy("v", "id").collect()
    assert [r["rank0"] for r in got] == list(range(500))


@pytest.mark.parametrize("values", [[], [None], [3.0], [1.0, 2.0], [0.5, None, 0.5, 0.1, 7.25, -3.0, 1e300], [0.0, -0.0, math.inf, math.nan, -math.inf, math.nan], [float(i % 37) / 7 for i in range(400)]])
def test_quantile_is_the_percentile_without_its_single_task(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for q in (0.0, 0.3, 0.8, 1.0):
        want, got = df.agg(F.percentile("v", F.lit(q))).first()[0], ordered.quantile(df, "v", {"t": q}).first()[0]
        assert got == want or repr(got) == repr(want)  # NaN


def test_quantiles_of_groups(spark):
    rows = [(None if i % 5 == 4 else i % 5, None if i % 11 == 3 else float(i * 37 % 101) / 9) for i in range(300)]
    df = spark.createDataFrame(rows, "g long, v double")
    want = {r["g"]: tuple(r["q"]) for r in df.groupBy("g").agg(F.percentile("v", F.array(F.lit(0.1), F.lit(0.9))).alias("q")).collect()}
    assert {r["g"]: (r["low"], r["high"]) for r in ordered.quantile(df, "v", {"low": 0.1, "high": 0.9}, "g").collect()} == want


def test_bounded_fill_stops_at_its_reach(spark):
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate([1.0, None, None, None, None, 2.0])], "k int, t int, v double")
    filled, own = panel.bounded_fill("v", 3, by=["k"], order="t")
    assert [tuple(r) for r in df.select(filled, own).collect()] == [(1.0, True), (1.0, False), (1.0, False), (1.0, False), (None, False), (2.0, True)]


def test_row_sum_is_null_only_if_all_are(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (1.0, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(panel.row_sum("a", "b")).collect()] == [1.0, None, 3.0]


def test_days_of_a_clock_change_have_92_and_100_quarters(spark):
    for day, n in ((dt.date(2024, 3, 31), 92), (dt.date(2024, 10, 27), 100)):
        at = dt.datetime(day.year, day.month, day.day)
        utc = spark.createDataFrame([(at + dt.timedelta(minutes=15 * k),) for k in range(-96, 192)], "ts timestamp")
        local = utc.select(*panel.local_calendar("ts", "Europe/Berlin")).where(F.col("date") == F.lit(day))
        assert local.count() == n


def test_later_stress_window_wins(spark):
    windows = [("a", dt.date(2020, 1, 1), dt.date(2020, 1, 10)), ("b", dt.date(2020, 1, 5), dt.date(2020, 1, 6))]
    df = spark.createDataFrame([(dt.date(2020, 1, d),) for d in (1, 5, 10, 11)], "day date")
    assert [r[0] for r in df.select(panel.stress_tag("day", windows)).collect()] == ["a", "b", "a", ""]


def panel_of(spark, err):
    return spark.createDataFrame([(dt.date(2020, 1, 1) + dt.timedelta(days=i), "s", None if math.isnan(e) else float(e)) for i, e in enumerate(err)], "date date, slot string, err double")


def test_trailing_bands_against_numpy(spark):
    rng = np.random.default_rng(1)
    err = rng.standard_normal(200)
    err[rng.random(200) < 0.1] = np.nan
    got = {r["date"]: r for r in bands.trailing(panel_of(spark, err)).collect()}
    for i in range(200):
        past = err[max(0, i - 90) : i]
        past = past[~np.isnan(past)]
        r = got.get(dt.date(2020, 1, 1) + dt.timedelta(days=i))
        assert (r is not None) == (len(past) >= 60 and not math.isnan(err[i]))
        if r is not None:
            assert r["mean"] == pytest.approx(past.mean()) and r["sd"] == pytest.approx(past.std(ddof=1))
            assert r["q"] == pytest.approx([np.quantile(past, p) for t in bands.LEVELS.values() for p in (t, 1 - t)])


def test_adaptive_band_against_a_plain_loop_and_without_gain(spark):
    rng = np.random.default_rng(2)
    err = np.round(rng.standard_normal(220) * np.linspace(1, 3, 220), 6)
    err[30:35] = np.nan
    a, want = 0.1, []
    for i in range(len(err)):
        past = err[max(0, i - 90) : i]
        past = past[~np.isnan(past)]
        if len(past) >= 60 and not math.isnan(err[i]):
            t = min(max(a, 0.001), 0.45)
            lo, hi = np.round(np.quantile(past, [t / 2, 1 - t / 2]), 9)
            a += 0.02 * (0.1 - (not lo <= err[i] <= hi))
            want.append((lo, hi, a))
    got = [(lo, hi, s) for _, lo, hi, _, s in sequential.adaptive(err, 0.1)]
    assert np.allclose(got, want)
    p = panel_of(spark, err)
    still = sequential.adaptive_bands(p, [0.9], [0.0]).select("date", "lo", "hi").collect()
    rolling = bands.score(bands.trailing(p), ["conformal"]).where("level = 0.9").select("date", "lo", "hi").collect()
    assert [r[0] for r in sorted(map(tuple, still))] == [r[0] for r in sorted(map(tuple, rolling))]
    assert np.allclose([r[1:] for r in sorted(map(tuple, still))], [r[1:] for r in sorted(map(tuple, rolling))])


def test_stream_gives_the_batch_bands(spark, tmp_path):
    from plumbline.streaming.adaptive import adaptive_stream

    rng = np.random.default_rng(3)
    err = np.round(rng.standard_normal(120), 6)
    rows = [(f"s{k}", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), float(e) + k) for k in range(2) for i, e in enumerate(err)]
    df = spark.createDataFrame(rows, "slot string, ts timestamp, err double")
    for n in range(3):  # files in the order of time
        df.where((F.unix_timestamp("ts") - 1704067200) / 3600 >= 40 * n).where((F.unix_timestamp("ts") - 1704067200) / 3600 < 40 * (n + 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = adaptive_stream(stream, 0.9).writeStream.format("memory").queryName("adaptive_out").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    out.awaitTermination(120)
    got = spark.table("adaptive_out").where("slot = 's1'").orderBy("ts").collect()
    want = list(sequential.adaptive(err + 1, 0.1))
    assert len(got) == len(want)
    assert np.allclose([(r["lo"], r["hi"], r["a_t"]) for r in got], [(lo, hi, s) for _, lo, hi, _, s in want])


def test_two_conformal_radii(spark):
    for n, alpha, rank, higher in ((10, 0.5, 6, 7), (40, 0.1, 37, 38), (5, 0.1, math.inf, 5)):
        df = spark.range(1, n + 1).select(F.col("id").cast("double").alias("v"))
        assert groups.conformal_rank(df, "v", 1 - alpha).first()["radius"] == rank
        assert groups.conformal_higher(df, "v", alpha).first()["radius"] == higher == np.quantile(np.arange(1, n + 1), min(1, math.ceil(round((n + 1) * (1 - alpha), 9)) / n), method="higher")


@pytest.mark.parametrize(("vb", "change", "waste", "late", "inert"), [([0.1, 0.7, 0.8], None, 0, 1, 1), ([0.1, 0.2, 0.3], 1, 2, 0, 0), ([0.1, 0.2, 0.7], 1, 2, 0, 0), ([0.1, 0.7, 0.8], 3, 0, 1, 0), ([0.1, 0.2], None, 0, 0, 1)])
def test_change_outcomes_branch_by_branch(spark, vb, change, waste, late, inert):
    df = spark.createDataFrame([(1, i + 1, v) for i, v in enumerate(vb)], "case int, cut_index int, vb double")
    rule = F.min(F.lit(None).cast("int")) if change is None else groups.fixed_change(change)
    (r,) = groups.change_outcomes(df, 0.6, {"r": rule}).collect()
    assert (r["waste"], r["late"], r["inert"], r["cuts"]) == (waste, late, inert, len(vb))


def test_bins_of_equal_mass_are_slices(spark):
    for n, b in ((10, 10), (37, 10), (103, 8)):
        edges = np.linspace(0, n, b + 1).astype(int)
        want = [int(np.searchsorted(edges, r, side="right") - 1) for r in range(n)]
        got = spark.range(n).select(probs.equal_mass_bin(F.col("id"), F.lit(n), b).alias("b")).collect()
        assert [r["b"] for r in got] == want


def test_auroc_with_ties_and_one_class(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.4, 1), (0.9, 1)], "p double, y int")
    assert probs.auroc(df).first()["auroc"] == 0.875
    assert probs.auroc(df.where("y = 1")).first()["auroc"] is None


def test_temperature_recovers_the_scale(spark):
    rng = np.random.default_rng(7)
    z = rng.standard_normal((3000, 5)) * 1.5
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    y = [int(rng.choice(5, p=q)) for q in p]
    sharp = np.exp(2 * z) / np.exp(2 * z).sum(1, keepdims=True)
    df = spark.createDataFrame([(q.tolist(), k) for q, k in zip(sharp, y, strict=True)], "p array<double>, y int")
    assert probs.fit_temperature(df) == pytest.approx(2.0, rel=0.12)


def test_shortfall_identity_and_controls(spark):
    rng = np.random.default_rng(8)
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(days=i), float(x), 0.025, -0.0196, -0.0234) for i, x in enumerate(rng.standard_normal(1500) * 0.01)]
    df = spark.createDataFrame(rows, "date date, pnl double, alpha double, var double, es double").withColumn("breached", F.col("pnl") < F.col("var"))
    r = df.agg(tail.z1().alias("z1"), tail.z2().alias("z2"), F.sum(F.col("breached").cast("int")).alias("b")).first()
    assert r["z2"] == pytest.approx(1 + r["b"] / (1500 * 0.025) * (r["z1"] - 1)) and abs(r["z1"]) < 0.15
    broken = df.withColumns({"es": 0.6 * F.col("es")}).agg(tail.z1().alias("z1")).first()
    assert broken["z1"] < r["z1"] - 0.3
    none = df.withColumn("breached", F.lit(False)).agg(tail.z1().alias("z1"), tail.z2().alias("z2")).first()
    assert none["z1"] is None and none["z2"] == 1.0


def test_likelihood_ratios(spark):
    assert one(spark, tail.kupiec(F.lit(250), F.lit(0), F.lit(0.01))) == pytest.approx(-2 * 250 * math.log(0.99))
    assert one(spark, tail.kupiec(F.lit(100), F.lit(1), F.lit(0.01))) == pytest.approx(0, abs=1e-12)
    assert one(spark, tail.independence(F.lit(95), F.lit(3), F.lit(2), F.lit(0))) >= 0


def test_supervisory_tables(spark):
    got = spark.range(12).select(tail.zone(F.col("id")).alias("z"), tail.step_table(F.col("id"), tail.ADDEND).alias("a"), tail.step_table(F.col("id"), tail.ADDON_2027).alias("b")).collect()
    assert [r["z"] for r in got] == ["green"] * 5 + ["yellow"] * 5 + ["red"] * 2
    assert [r["a"] for r in got] == [0] * 5 + [0.40, 0.50, 0.65, 0.75, 0.85, 1.00, 1.00]
    assert [r["b"] for r in got] == [0] * 5 + [0.20, 0.26, 0.33, 0.38, 0.42, 0.50, 0.50]
    assert tail.p_outside_green() == pytest.approx(0.1078, abs=2e-4)


def test_wilson_bounds(spark):
    lo, hi = tail.wilson(F.lit(0), F.lit(10))
    assert one(spark, lo) == 0.0 and one(spark, hi) == pytest.approx(0.2775, abs=1e-4)


def test_severities(spark):
    L = F.lit  # noqa: N806
    cases = [
        (rules.band(L(True), L(9.0), L(9.0)), "Observation"), (rules.band(L(False), L(1.25), L(1.01)), "Material"), (rules.band(L(False), L(1.25), L(1.0)), "Significant"), (rules.band(L(False), L(1.2), L(1.1)), "Significant"),
        (rules.tolerance(L(0.011), L(9.0)), "Material"), (rules.tolerance(L(0.01), L(1.32)), "Significant"), (rules.tolerance(L(0.0), L(1.33)), "Observation"),
        (rules.stated_range(L(0.9), L(0.8), L(0.95), L(0.1)), "Observation"), (rules.stated_range(L(0.9), L(0.6), L(0.8), L(0.7)), "Material"), (rules.stated_range(L(0.9), L(0.6), L(0.8), L(None).cast("double")), "Significant"),
        (rules.structure(L(True), L(True)), "Material"), (rules.structure(L(False), L(True)), "Significant"), (rules.structure(L(False), L(False)), "Observation"),
        (rules.model(L(True), L(0.5), L(True), L(0.9), L(0.9), 0.1), "Observation"), (rules.model(L(False), L(0.5), L(True), L(0.25), L(0.2), 0.1), "Material"), (rules.model(L(True), L(0.04), L(True), L(0.24), L(0.2), 0.1), "Significant"),
        (rules.model(L(False), L(0.5), L(False), L(0.9), L(0.9), 0.1), "Significant"), (rules.model(L(False), L(0.5), L(True), L(0.9), L(0.1), 0.1), "Significant"),
        (rules.test(L(0.0), L(0)), "Observation"), (rules.test(L(0.1), L(0)), "Significant"), (rules.test(L(0.5), L(0)), "Significant"), (rules.test(L(0.51), L(0)), "Material"), (rules.test(L(0.0), L(1)), "Material"),
        (rules.pair_integrity(L(0.011)), "Material"), (rules.pair_integrity(L(0.01)), "Observation"),
        (rules.process(L(False), L(1.0), L(9.0), L(False)), "Observation"), (rules.process(L(True), L(0.01), L(-0.1), L(False)), "Material"), (rules.process(L(True), L(0.01), L(-0.1), L(True)), "Significant"),
    ]
    got = spark.range(1).select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(cases)]).first()
    assert list(got) == [want for _, want in cases]


def test_register_takes_the_worst_and_the_headline_on_ties(spark):
    rows = [("b", 0.8, "Material"), ("b", 0.9, "Observation"), ("a", 0.8, "Significant"), ("a", 0.9, "Significant"), ("a", 0.95, "Observation")]
    got = rules.register(spark.createDataFrame(rows, "m string, level double, severity string"), "m", "level", 0.9).orderBy("id").collect()
    assert [(r["id"], r["m"], r["level"]) for r in got] == [("F-01", "b", 0.8), ("F-02", "a", 0.9)]


def test_integrity_gate_fires(spark):
    good = spark.createDataFrame([("s", float(i % 50) + 100, float(i % 50) + 101) for i in range(300)], "slot string, act double, fc double")
    assert bands.integrity(good, "slot").first()["passes"]
    assert not bands.integrity(good.withColumn("fc", 0.6 * F.col("fc")), "slot").first()["passes"]


def test_block_interval_is_wider_under_correlation(spark):
    def width(stream, values):
        units = spark.createDataFrame([(i, 20, int(v)) for i, v in enumerate(values)], "day int, n int, x int")
        rates = resample.redrawn(units, stream, 300, "day").groupBy("b").agg((F.sum("x") / F.sum("n")).alias("r"))
        (r,) = resample.interval(rates, "r").collect()
        return r["hi"] - r["lo"]

    rng = np.random.default_rng(9)
    assert width("w", 20 * (rng.random(100) < 0.9)) > 2.5 * width("w", rng.binomial(20, 0.9, 100))


def test_distributions():
    assert dist.t_quantile(0.975, 10) == pytest.approx(2.228138852, abs=1e-7)
    assert dist.t_cdf(1.0, 1) == pytest.approx(0.75) and dist.normal_es(0.025) == pytest.approx(-2.3378, abs=1e-4)
    assert dist.t_es(0.025, 1e6) == pytest.approx(dist.normal_es(0.025), abs=1e-4)


def test_ridge_leaves_a_constant_feature_alone(spark):
    from plumbline.operators.models import ridge

    rows = [(i % 5, float(i), 1.0, 2.0 * i + 3) for i in range(100)]
    df = ridge(spark.createDataFrame(rows, "g long, x double, c double, y double"), "g", ["x", "c"], "y")
    assert df.agg(F.max(F.abs(F.col("y") - F.col("pred")))).first()[0] < 3.0


def test_plateau_and_flat_signals(spark):
    rows = [(1, i, 1.0 if 200 <= i < 700 else 0.01) for i in range(1000)] + [(2, i, 5.0) for i in range(30)] + [(3, i, 5.0) for i in range(5)]
    df = spark.createDataFrame(rows, "s int, i int, v double")
    ends = {r["s"]: (r["first"], r["last"]) for r in groups.plateau(df, "s", ["i"], "v").collect()}
    assert 240 <= ends[1][0] <= 260 and 640 <= ends[1][1] <= 660
    got = {r["s"]: r for r in groups.signal_summary(df, "s", ["i"], "v").collect()}
    assert got[2]["mean"] == 5.0 and got[2]["kurtosis"] is None and got[3]["mean"] is None


def test_sums_of_weighted_items_are_those_of_draws_made_one_by_one(spark):
    """Draws times items were once a join whose condition hashed each pair a dozen times."""
    import hashlib

    keys = [str(k) for k in (0, 7, 42, 99, 100, 12345, 10**12)] + ["\u00e4" * 30, "x" * 60, None]
    items = [(k, None if i == 2 else i + 0.5) for i, k in enumerate(keys)]
    df = spark.createDataFrame(items, "k string, v double").repartition(3)
    got = {r["b"]: (r["w"], r["s"]) for r in resample.weighted_sums(df, "items", 120, "k", "v").collect()}
    shown = {(r["b"], r["k"]): r["d"] for r in df.crossJoin(spark.range(120).withColumnRenamed("id", "b")).select("b", "k", resample.draw("items", "b", "k").alias("d")).collect()}
    assert len(got) == 120
    for b, (w, total) in got.items():
        times = []
        for k in keys[:-1]:
            bits = int(hashlib.md5(f"items|{b}|{k}".encode()).hexdigest()[:8], 16)
            assert bits == shown[b, k]
            times.append(sum((bits + 0.5) / 2**32 >= c for c in resample.POISSON))
        assert w == sum(times)
        there = [(t, v) for t, (_, v) in zip(times, items, strict=False) if v is not None]
        assert total is None if not any(t for t, _ in there) else total == pytest.approx(sum(t * v for t, v in there))
