"""Adaptive bands, whose state moves from row to row of a key.

A generator goes over one key's rows in order, run by applyInPandas; keys are
(slot, level, gain): one key's history is a time series and so is bounded by time, not by data.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

GAMMA = 0.02
TAIL_LOW, TAIL_HIGH = 0.001, 0.45


def type7(ordered: list[float] | np.ndarray, q: float) -> float:
    """NumPy's default quantile of sorted values."""
    at = (len(ordered) - 1) * q
    low = math.floor(at)
    high = min(low + 1, len(ordered) - 1)
    return ordered[low] + (at - low) * (ordered[high] - ordered[low])


def adaptive(errors: np.ndarray, alpha: float, gamma: float = GAMMA, window: int = 90, least: int = 60, digits: int = 9):
    """(row, low, high, miss, alpha after) of every scored row.

    The band uses the tail level held to its bounds, the state itself moves on unheld; rows without an
    outcome or with too short a history leave it as it is.  The window is kept sorted, so a row costs a few moves."""
    state, held, recent = alpha, [], deque()
    for i, e in enumerate(errors):
        if len(held) >= least and not math.isnan(e):
            tail = min(max(state, TAIL_LOW), TAIL_HIGH)
            low, high = round(type7(held, tail / 2), digits), round(type7(held, 1 - tail / 2), digits)
            miss = not low <= e <= high
            state += gamma * (alpha - miss)
            yield i, low, high, miss, state
        recent.append(e)
        if not math.isnan(e):
            insort(held, e)
        if len(recent) > window:
            gone = recent.popleft()
            if not math.isnan(gone):
                del held[bisect_left(held, gone)]


def adaptive_bands(panel: DataFrame, levels: list[float], gammas: list[float] | None = None, window: int = 90, least: int = 60) -> DataFrame:
    """slot, date, level, gamma, err, lo, hi, inside, a_t for a densified panel (date, slot, err)."""
    from pyspark.sql import functions as F

    gammas = [GAMMA] if gammas is None else gammas
    kind = panel.schema["slot"].dataType.simpleString()
    cells = panel.select("date", "slot", F.col("err").cast("double").alias("err"), F.explode(F.array(*[F.lit(v) for v in levels])).alias("level"))
    cells = cells.select("*", F.explode(F.array(*[F.lit(g) for g in gammas])).alias("gamma"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date", kind="stable").reset_index(drop=True)
        level, gamma = float(pdf["level"].iloc[0]), float(pdf["gamma"].iloc[0])
        errors = pdf["err"].to_numpy(float)
        rows = list(adaptive(errors, round(1 - level, 12), gamma, window, least))
        at = [r[0] for r in rows]
        return pd.DataFrame({"slot": pdf["slot"].iloc[at], "date": pdf["date"].iloc[at], "level": level, "gamma": gamma, "err": errors[at], "lo": [r[1] for r in rows], "hi": [r[2] for r in rows], "inside": [not r[3] for r in rows], "a_t": [r[4] for r in rows]})

    return cells.groupBy("slot", "level", "gamma").applyInPandas(run, f"slot {kind}, date date, level double, gamma double, err double, lo double, hi double, inside boolean, a_t double")
