"""Calibrated quantiles over a stream: the same transitions as the batch walk, with a book's band kept between micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plumbline.operators import controllers as C

OUT = "book string, ts timestamp, stated double, outcome double, breached boolean, level double"
STATE = "level double, residuals array<double>, widths array<double>, size double, total double, error double"


def calibrated_stream(days: DataFrame, alpha: float, late: str = "1 day") -> DataFrame:
    """book, ts, stated, outcome, breached, level for a stream of (book, ts, centre, width, outcome): a forecast's centre and
    width and what came of it.  A book's first row has nothing to be calibrated on and only enters the state; rows later than
    the watermark are dropped, rows of one micro-batch are taken in the order of their time."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        band = C.Band(alpha)
        if state.exists:
            level, residuals, widths, size, total, error = state.get
            band = C.Band(level, np.array(residuals, float), np.array(widths, float), size, total, error)
        out = []
        for day in pd.concat(list(frames)).sort_values("ts", kind="stable").itertuples():
            if len(band.residuals):
                value, band = C.stated(band, day.centre, day.width)
                out.append((key[0], day.ts, value, day.outcome, day.outcome < value, band.level))
            band = C.after_outcome(band, day.centre, day.width, day.outcome, alpha)
        state.update((band.level, band.residuals.tolist(), band.widths.tolist(), band.size, band.total, band.error))
        yield pd.DataFrame(out, columns=["book", "ts", "stated", "outcome", "breached", "level"])

    return days.withWatermark("ts", late).groupBy("book").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
