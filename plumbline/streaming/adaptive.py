"""Adaptive bands over a stream: the batch operator's state, kept by key between micro-batches."""

from __future__ import annotations

import math
from bisect import insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plumbline.operators.sequential import GAMMA, TAIL_HIGH, TAIL_LOW, type7

OUT = "slot string, ts timestamp, err double, lo double, hi double, inside boolean, a_t double"
STATE = "a_t double, recent array<double>"


def adaptive_stream(errors: DataFrame, level: float, late: str = "1 day", window: int = 90, least: int = 60, gamma: float = GAMMA) -> DataFrame:
    """slot, ts, err, lo, hi, inside, a_t for a stream of (slot, ts, err); rows later than the watermark are dropped,
    rows of one micro-batch are taken in the order of their time."""
    alpha = round(1 - level, 12)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        a_t, recent = state.get if state.exists else (alpha, [])
        recent = list(recent)
        rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
        out = []
        for ts, e in zip(rows["ts"], rows["err"], strict=True):
            held: list[float] = []
            for x in recent:
                if not math.isnan(x):
                    insort(held, x)
            if len(held) >= least and not math.isnan(e):
                tail = min(max(a_t, TAIL_LOW), TAIL_HIGH)
                low, high = round(type7(held, tail / 2), 9), round(type7(held, 1 - tail / 2), 9)
                inside = low <= e <= high
                a_t += gamma * (alpha - (not inside))
                out.append((key[0], ts, e, low, high, inside, a_t))
            recent = [*recent, float(e)][-window:]
        state.update((a_t, recent))
        yield pd.DataFrame(out, columns=["slot", "ts", "err", "lo", "hi", "inside", "a_t"])

    return errors.withWatermark("ts", late).groupBy("slot").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
