"""Whether two series are a forecast and its own outcome: ten tests, and what their verdicts say together.

A panel has date, slot (0 to 23), act, fc and sun, a regressor that one series may be net of.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NIGHT, NOON, LAGS, SLOTS = (0, 5), (11, 13), 3, 24
#: Day of the month after which a day counts as the season in which the regressor is strong.
STRONG = 15


def both(panel: DataFrame) -> DataFrame:
    return panel.where("act IS NOT NULL AND fc IS NOT NULL").withColumn("gap", F.col("act") - F.col("fc"))


def raw_series(panel: DataFrame) -> DataFrame:
    """t1: every day has its slots within 2 %, once each, and under 1 % of outcomes are missing."""
    cells = panel.groupBy("date", "slot").agg(F.count(F.lit(1)).alias("n"), F.count("act").alias("k"))
    days = cells.groupBy("date").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.sum("k").alias("k"))
    off, missing = F.max(F.abs(F.col("n") - SLOTS) / SLOTS), 1 - F.sum("k") / F.sum("n")
    return days.agg(((off <= 0.02) & (F.max("most") == 1) & (missing < 0.01)).alias("t1"))


def resolution(panel: DataFrame) -> DataFrame:
    """t2: all slots occur, the fullest no more than 2 % over the emptiest."""
    n = both(panel).groupBy("slot").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(((F.count(F.lit(1)) == SLOTS) & (F.max("n") / F.min("n") <= 1.02)).alias("t2"))


def unit(panel: DataFrame, reference: DataFrame) -> DataFrame:
    """t3: both means within 15 % of a reference that does not come from the panel."""
    means = both(panel).agg(F.avg("act").alias("a"), F.avg("fc").alias("f")).crossJoin(reference)  # one row each
    near = lambda c: (F.col(c) / F.col("reference")).between(0.85, 1.15)
    return means.select((near("a") & near("f")).alias("t3"))


def phase_gain(panel: DataFrame) -> DataFrame:
    """gain: how much a circular shift of the forecast's mean profile betters its correlation with the outcome's."""
    prof = both(panel).groupBy("slot").agg(F.avg("act").alias("a"), F.avg("fc").alias("f"))
    shifted = prof.select(F.explode(F.sequence(F.lit(-LAGS), F.lit(LAGS))).alias("k"), "slot", "f")
    shifted = shifted.select("k", F.pmod(F.col("slot") + F.col("k"), F.lit(SLOTS)).cast("int").alias("slot"), "f")
    by = shifted.join(prof.select("slot", "a"), "slot").groupBy("k").agg(F.corr("a", "f").alias("c"))
    return by.agg((F.max("c") - F.max(F.when(F.col("k") == 0, F.col("c")))).alias("gain"))


def clock_change(panel: DataFrame, after: int = 14) -> DataFrame:
    """t5: the day of a clock change has its slots, and the gap does not jump there: the largest change in its first hours is
    under the 99th percentile of all changes."""
    day = panel.agg(F.date_add(F.min("date"), after).alias("day"))
    order = Window.partitionBy(F.lit(0)).orderBy("date", "slot")  # one series: its hours are the calendar's
    jumps = both(panel).withColumn("j", F.abs(F.col("gap") - F.lag("gap").over(order))).crossJoin(F.broadcast(day))  # one row
    edge = jumps.agg(F.max(F.when((F.col("date") == F.col("day")) & (F.col("slot") <= 3), F.col("j"))).alias("near"), F.percentile("j", F.lit(0.99)).alias("p99"))
    rows = panel.crossJoin(F.broadcast(day)).agg(F.count(F.when(F.col("date") == F.col("day"), 1)).alias("rows"))  # one row
    return edge.crossJoin(rows).select(((F.col("rows") == SLOTS) & (F.col("near") < F.col("p99"))).alias("t5"))  # one row each


def shaped(panel: DataFrame) -> DataFrame:
    """shaped: the gap at noon is over three times that at night, and larger in the strong season."""
    b = both(panel)
    by_slot = b.groupBy("slot").agg(F.avg("gap").alias("g"))
    mean = lambda within: F.avg(F.when(F.col("slot").between(*within), F.col("g")))
    ratio = by_slot.agg(F.try_divide(mean(NOON), F.nullif(mean(NIGHT), F.lit(0.0))).alias("ratio"))
    noon, strong = F.col("slot").between(*NOON), F.dayofmonth("date") > STRONG
    season = b.agg(F.avg(F.when(noon & strong, F.col("gap"))).alias("late"), F.avg(F.when(noon & ~strong, F.col("gap"))).alias("early"))
    return ratio.crossJoin(season).select(((F.col("ratio") > 3) & (F.col("late") > F.col("early"))).alias("shaped"))  # one row each


def netting(panel: DataFrame) -> DataFrame:
    """slope and R2 of the gap on the regressor."""
    return both(panel).agg(F.regr_slope("gap", "sun").alias("slope"), F.regr_r2("gap", "sun").alias("r2"))


def night_floor(panel: DataFrame) -> DataFrame:
    """mean, sd and share of the mean outcome of the daily gap at night: test 8 characterises, it has no criterion."""
    by_day = both(panel).groupBy("date").agg(F.avg(F.when(F.col("slot").between(*NIGHT), F.col("gap"))).alias("n"), F.avg("act").alias("a"))
    return by_day.agg(F.avg("n").alias("mean"), F.stddev_samp("n").alias("sd"), (F.avg("n") / F.avg("a")).alias("share"))


def independent_pull(panel: DataFrame, fresh: DataFrame) -> DataFrame:
    """t10: outcomes pulled anew (date, slot, x) are the panel's, on the same times."""
    joined = fresh.join(panel.select("date", "slot", "act"), ["date", "slot"], "full")
    return joined.agg((F.count(F.when(F.coalesce("x", F.lit(0.0)) != F.coalesce("act", F.lit(0.0)), 1)) == 0).alias("t10"))


def conclusion(v: dict[str, Column]) -> Column:
    """A fault needs a failure in what exercises the code; else it is the regressor's doing, wholly or in part."""
    clean = v["t1"] & v["t2"] & v["t4"] & v["t5"] & v["t10"]
    return F.when(~clean, "a fault in the pull or the panel").when(v["t7"] & v["t9"], "a property of the series").otherwise("only in part a property of the series")


def battery(main: DataFrame, control: DataFrame, fresh: DataFrame, reference: DataFrame) -> DataFrame:
    """test, passes: the ten tests and a row for the conclusion."""
    one = raw_series(main)
    for part in (resolution(main), unit(main, reference), phase_gain(main).select((F.col("gain") <= 0.02).alias("t4")), clock_change(main), shaped(main).withColumnRenamed("shaped", "t6")):
        one = one.crossJoin(part)  # one row each, here and below
    one = one.crossJoin(netting(main).select((F.col("slope").between(0.7, 1.3) & (F.col("r2") > 0.6)).alias("t7")))
    still = phase_gain(control).crossJoin(shaped(control)).crossJoin(netting(control))
    one = one.crossJoin(still.select(((F.col("gain") <= 0.02) & ~F.coalesce("shaped", F.lit(False)) & (F.col("r2") < 0.3)).alias("t9"))).crossJoin(independent_pull(main, fresh))
    v = {c: F.coalesce(F.col(c), F.lit(False)) for c in ("t1", "t2", "t3", "t4", "t5", "t6", "t7", "t9", "t10")}
    none = F.lit(None).cast("boolean")
    rows = [
        ("01 raw series", v["t1"]), ("02 resolution", v["t2"]), ("03 unit and scale", v["t3"]), ("04 phase shift", v["t4"]), ("05 clock change", v["t5"]),
        ("06 gap shape", v["t6"]), ("07 netting", v["t7"]), ("08 intercept", none), ("09 control", v["t9"]), ("10 independent pull", v["t10"]),
    ]
    cells = [F.struct(F.lit(n).alias("test"), p.alias("passes")) for n, p in rows] + [F.struct(F.concat(F.lit("conclusion: "), conclusion(v)).alias("test"), none.alias("passes"))]
    return one.select(F.explode(F.array(*cells)).alias("r")).select("r.*")
