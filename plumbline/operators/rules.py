"""Severities by fixed rules, and the register of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OBSERVATION, SIGNIFICANT, MATERIAL = "Observation", "Significant", "Material"


def grade(material: Column, significant: Column) -> Column:
    """The first grade whose condition holds; a null condition doesn't."""
    return F.when(material, MATERIAL).when(significant, SIGNIFICANT).otherwise(OBSERVATION)


def band(nominal_inside: Column, concentration: Column, low: Column, trigger: float = 1.25) -> Column:
    return grade(~nominal_inside & (concentration >= trigger) & (low > 1.0), ~nominal_inside)


def tolerance(outside_low: Column, cpk: Column, floor: float = 0.01, least: float = 1.33) -> Column:
    return grade(outside_low > floor, cpk < least)


def untested(nearest_sd: Column, most: float = 6.0) -> Column:
    """Whether a limit is so far off that the records never tried it."""
    return nearest_sd > most


def stated_range(stated: Column, low: Column, high: Column, regime_high: Column) -> Column:
    outside = ~stated.between(low, high)
    return grade(outside & F.coalesce(regime_high < stated, F.lit(False)), outside)


def structure(blocks: Column, ambiguous: Column) -> Column:
    return grade(blocks, ambiguous)


def model(rate_inside: Column, independence_p: Column, headline: Column, share: Column, share_low: Column, expected: float, trigger: float = 0.25, p: float = 0.05) -> Column:
    """A stated breach rate and independence of breaches; time outside green counts at the headline level only."""
    fails = ~rate_inside | (independence_p < p)
    return grade(fails & headline & share.isNotNull() & (share >= trigger) & (share_low > expected), fails)


def test(share_changed: Column, controls_missed: Column, trigger: float = 0.50) -> Column:
    return grade((controls_missed > 0) | (share_changed > trigger), share_changed > 0)


def pair_integrity(worst_share: Column, floor: float = 0.01) -> Column:
    return grade(worst_share > floor, F.lit(False))


def process(together: Column, model_effect: Column, reference_effect: Column, model_passes: Column) -> Column:
    return grade(together & (F.abs(reference_effect) > F.abs(model_effect)) & ~model_passes, together)


def rank(severity: Column) -> Column:
    return F.when(severity == MATERIAL, 2).when(severity == SIGNIFICANT, 1).otherwise(0)


def register(findings: DataFrame, subject: str, level: str, headline: float) -> DataFrame:
    """The worst finding of each subject, the headline level's where grades tie, then the lowest level's; with ids by severity."""
    order = Window.partitionBy(subject).orderBy(F.desc(rank(F.col("severity"))), F.desc((F.col(level) == headline).cast("int")), level)
    worst = findings.withColumn("k_", F.row_number().over(order)).where("k_ = 1").drop("k_")
    ids = F.row_number().over(Window.orderBy(F.desc(rank(F.col("severity"))), subject))  # a row a subject: a short list by nature
    return worst.withColumn("id", F.format_string("F-%02d", ids))
