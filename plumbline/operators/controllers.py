"""Calibrated tail forecasts as pure transitions: a day's forecast and outcome turn one small state into the next.

`Band` is what a calibrated quantile carries over the days, `Depth` what a calibrated shortfall does.  Both are immutable,
so a batch walk and a stream keep them alike, and a state can be tested on its own.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import numpy as np

# How many residuals and widths count, the span of the residuals' mean size and its least value, the gains on
# a day's error, on the errors summed up and on their change, and the bounds of the sum, the level and the width's ratio.
KEEP, SPAN, LEAST_SIZE = 500, 168, 1e-3
GAINS, SUM_BOUND = (0.03, 0.0005, 0.003), 50.0
LEVEL_BOUNDS, RATIO_BOUNDS, RATIO_AFTER = (0.001, 0.499), (0.3, 3.0), 10
# The same of a shortfall, whose errors move the logarithm of a factor.
DEPTH_GAINS, DEPTH_SUM_BOUND, DEPTH_BOUNDS = (0.15, 0.01, 0.05), 25.0, (0.5, 3.0)

EMPTY = np.empty(0)


def held(x: float, bounds: tuple[float, float]) -> float:
    return min(max(x, bounds[0]), bounds[1])


def pushed(error: float, total: float, before: float, gains: tuple[float, float, float], bound: float) -> tuple[float, float]:
    """What an error asks for in all, and the new sum of errors."""
    total = held(total + error, (-bound, bound))
    return gains[0] * error + gains[1] * total + gains[2] * (error - before), total


def quantile(values: np.ndarray, q: float) -> float:
    """Type 7, as NumPy's default, of unsorted values."""
    place = (len(values) - 1) * q
    low = math.floor(place)
    high = min(low + 1, len(values) - 1)
    two = np.partition(values, (low, high))
    return float(two[low] + (place - low) * (two[high] - two[low]))


@dataclass(frozen=True)
class Band:
    """residuals: latest ones, each over the mean size of its time; widths: of forecasts, two a day."""

    level: float
    residuals: np.ndarray = field(default_factory=lambda: EMPTY)
    widths: np.ndarray = field(default_factory=lambda: EMPTY)
    size: float | None = None
    total: float = 0.0
    error: float = 0.0


def absorbed(band: Band, residual: float) -> Band:
    weight = 2 / (SPAN + 1)
    size = abs(residual) if band.size is None else band.size + weight * (abs(residual) - band.size)
    scaled = residual / max(size, LEAST_SIZE)
    return replace(band, size=size, residuals=np.append(band.residuals, scaled)[-KEEP:])


def stated(band: Band, centre: float, width: float) -> tuple[float, Band]:
    """The calibrated quantile of a forecast, and the band that has seen its width."""
    width = max(width, 1e-6)
    ratio = held(width / max(float(np.median(band.widths)), 1e-6), RATIO_BOUNDS) if len(band.widths) > RATIO_AFTER else 1.0
    reach = quantile(band.residuals, band.level) * max(band.size, LEAST_SIZE) * ratio
    return centre + reach, replace(band, widths=np.append(band.widths, width)[-KEEP:])


def after_outcome(band: Band, centre: float, width: float, outcome: float, alpha: float) -> Band:
    """The band after a day's outcome.  The bound that the outcome is held against is made anew, so a day on which a
    quantile was stated leaves two widths."""
    if not len(band.residuals):
        return absorbed(band, outcome - centre)
    bound, band = stated(band, centre, width)
    error = float(outcome < bound) - alpha
    asked, total = pushed(error, band.total, band.error, GAINS, SUM_BOUND)
    return replace(absorbed(band, outcome - centre), level=held(alpha - asked, LEVEL_BOUNDS), total=total, error=error)


@dataclass(frozen=True)
class Depth:
    """log: of the factor on how far a shortfall lies beyond its quantile."""

    log: float = 0.0
    total: float = 0.0
    error: float = 0.0
    moves: int = 0

    @property
    def factor(self) -> float:
        return held(math.exp(self.log), DEPTH_BOUNDS)


def deepened(depth: Depth, var: float, es: float) -> float:
    """Only the excess is scaled, so a shortfall is never shallower than its quantile."""
    return var + depth.factor * min(es - var, 0.0)


def after_breach(depth: Depth, outcome: float, es: float, breached: bool) -> Depth:
    """es: what was stated, so that a correction changes the next error; days without a breach say nothing."""
    if not breached or abs(es) < 1e-12:
        return depth
    error = outcome / abs(es) + 1
    asked, total = pushed(error, depth.total, depth.error, DEPTH_GAINS, DEPTH_SUM_BOUND)
    return Depth(held(depth.log - asked, (math.log(DEPTH_BOUNDS[0]), math.log(DEPTH_BOUNDS[1]))), total, error, depth.moves + 1)
