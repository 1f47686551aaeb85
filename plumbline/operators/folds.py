"""Ranges around a one-feature ridge line for a held-out group, from sums alone, and exact order statistics without a sort."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.ordered import fanned
from plumbline.functions.settle import settle

PENALTY, LEVEL, REPEATS, FOLDS = 1.0, 0.90, 25, 5
SUMS = ["n", "sx", "sy", "sxx", "sxy", "syy"]
#: Residuals are compared in steps of a millionth; digits of 16 bits, three of them.
SCALE, DIGIT, DIGITS = 1e6, 16, 3
#: Bits of a residual that one pass over the rows counts, and held-out groups that a pass counts for.
PASS_BITS, BLOCK = 11, 64


def sums(rows: DataFrame, *by: str) -> DataFrame:
    """by and the sums that a line is fitted from; rows has x and y."""
    x, y = F.col("x"), F.col("y")
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy"), F.sum(y * y).alias("syy"))


def line(n: Column, sx: Column, sy: Column, sxx: Column, sxy: Column, syy: Column, penalty: float = PENALTY) -> dict[str, Column]:
    """slope, base and in-sample sd of residuals of a ridge on the standardised feature (a constant one gets no slope)."""
    xx, xy, yy = sxx - sx * sx / n, sxy - sx * sy / n, syy - sy * sy / n
    slope = F.when(xx > 1e-9, xy / xx * (n - 1) / (n - 1 + penalty)).otherwise(0.0)
    rest = F.greatest(F.lit(0.0), yy - 2 * slope * xy + slope * slope * xx)
    return {"slope": slope, "base": sy / n - slope * sx / n, "sd": F.sqrt(rest / (n - 1))}


def kth(values: DataFrame, ks: DataFrame, *by: str, value: str = "v") -> DataFrame:
    """by and the k-th smallest value (from 1) of each group; values are whole numbers from 0, ks has by and k.

    Digit by digit from the first: counts of a digit's values, with partial sums before the shuffle, say which holds the
    k-th, and the next digit is counted among those alone.  Whatever the number of rows, what moves are counts."""
    found = ks.select(*by, F.col("k").alias("k_"), F.lit(0).cast("long").alias("head_"))
    for place in reversed(range(DIGITS)):
        shift = DIGIT * place
        rows = values.join(found, [*by]).where(F.shiftright(value, shift + DIGIT) == F.col("head_"))
        digit = F.shiftright(value, shift).bitwiseAND(F.lit((1 << DIGIT) - 1)).cast("long").alias("digit_")
        counts = rows.groupBy(*by, "k_", "head_", digit).agg(F.count(F.lit(1)).alias("c_"))
        upto = F.sum("c_").over(Window.partitionBy(*by).orderBy("digit_"))  # a group has 2^16 digits at most
        here = counts.withColumn("upto_", upto).where((F.col("upto_") >= F.col("k_")) & (F.col("upto_") - F.col("c_") < F.col("k_")))
        found = here.select(*by, (F.col("k_") - F.col("upto_") + F.col("c_")).alias("k_"), (F.col("head_") * (1 << DIGIT) + F.col("digit_")).alias("head_"))
    return found.select(*by, F.col("head_").alias(value))


def _line(n: np.ndarray, sx: np.ndarray, sy: np.ndarray, sxx: np.ndarray, sxy: np.ndarray, syy: np.ndarray, penalty: float = PENALTY) -> dict[str, np.ndarray]:
    """`line` on arrays; what no rows are left for is not finite."""
    with np.errstate(divide="ignore", invalid="ignore"):
        xx, xy, yy = sxx - sx * sx / n, sxy - sx * sy / n, syy - sy * sy / n
        slope = np.where(xx > 1e-9, xy / xx * (n - 1) / (n - 1 + penalty), 0.0)
        rest = np.maximum(0.0, yy - 2 * slope * xy + slope * slope * xx)
        return {"slope": slope, "base": sy / n - slope * sx / n, "sd": np.sqrt(rest / (n - 1))}


def conformal_k(n: Column, level: float = LEVEL) -> Column:
    return F.least(n, F.ceil(F.round((n + 1) * level, 9))).cast("long")


def _counts(table: DataFrame, groups, held: np.ndarray, slope: np.ndarray, base: np.ndarray, head: np.ndarray, shift: int) -> DataFrame:
    """h, counts: a task's counts of the next PASS_BITS bits of the residuals of each held-out group (by whole groups, then by
    repetition) whose leading bits are `head`.  slope and base: held-out groups x (groups, then parts of repetitions)."""
    bins, first, sets = 1 << PASS_BITS, len(groups), head.shape[1]

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        total = np.zeros((len(held), sets, bins), np.int32)
        at = (np.arange(len(held)) * bins)[:, None]
        for b in batches:
            code = pc.fill_null(pc.index_in(b["g"], value_set=groups), -1).to_numpy()
            x, y = (b[c].to_numpy(zero_copy_only=False) for c in "xy")
            parts = b["parts"].flatten().to_numpy(zero_copy_only=False).reshape(len(code), sets - 1)
            mine = (code == held[:, None]) | (code < 0)
            for i in range(sets):
                cell = code if i == 0 else first + (i - 1) * FOLDS + parts[:, i - 1].astype(np.int64)
                miss = np.abs(y - base[:, cell] - slope[:, cell] * x) * SCALE
                whole = np.floor(miss)
                whole += miss - whole >= 0.5
                np.minimum(whole, 2.0**62, out=whole)
                whole *= 2.0**-shift
                whole -= head[:, i : i + 1] * bins
                seen = (whole >= 0) & (whole < bins) & ~mine  # false where a value is missing
                total[:, i] += np.bincount((whole + at)[seen].astype(np.int64), minlength=len(held) * bins).reshape(len(held), bins)
        yield pa.RecordBatch.from_pydict({"h": pa.array(range(len(held)), pa.int32()), "counts": pa.array([t.tobytes() for t in total], pa.binary())})

    return table.select("g", "x", "y", "parts").mapInArrow(run, "h int, counts binary")


def _digits(counts: DataFrame, k: np.ndarray) -> DataFrame:
    """h, i, digit, below: the bin that holds the k-th residual of each held-out group and set, and how many lie in bins below it."""

    def run(key, pdf):
        import pandas as pd

        upto = sum(np.frombuffer(c, np.int32).astype(np.int64) for c in pdf["counts"]).reshape(k.shape[1], -1).cumsum(axis=1)
        digit = (upto < k[key[0]][:, None]).sum(axis=1)
        below = np.where(digit > 0, upto[np.arange(len(digit)), np.maximum(digit, 1) - 1], 0)
        return pd.DataFrame({"h": np.full(len(digit), key[0], np.int32), "i": np.arange(len(digit), dtype=np.int32), "digit": digit, "below": below})

    return counts.groupBy("h").applyInPandas(run, "h int, i int, digit long, below long")


def _smallest(table: DataFrame, groups, held: np.ndarray, slope: np.ndarray, base: np.ndarray, ks: np.ndarray, most: float) -> np.ndarray:
    """held-out groups x (whole groups, then repetitions): the ks-th smallest residual in steps of a millionth, NaN where there
    are not so many.  Every pass reads all rows and keeps the bin that holds it; only counts move, whatever the number of rows."""
    sets, bins = 1 + REPEATS, 1 << PASS_BITS
    head, left = np.zeros((len(held), sets)), np.repeat(ks[:, None], sets, axis=1)
    places = -(-max(1, int(min(2.0**62, most * 1.001 * SCALE + 2)).bit_length()) // PASS_BITS)
    for place in reversed(range(places)):
        counts = _counts(table, groups, held, slope, base, head, place * PASS_BITS)
        for h, i, digit, below in _digits(counts, left.copy()).collect():  # BLOCK x (1 + REPEATS) rows at most
            head[h, i] = head[h, i] * bins + digit if digit < bins else math.nan
            left[h, i] -= below
    return head


def half_widths(rows: DataFrame, draw: Column, level: float = LEVEL) -> DataFrame:
    """g, slope, base, hw_insample, hw_group, hw_row for each held-out group of `rows` (id, g, x, y).

    All fits come from sums by group, less those of the rows left out; no fold is ever copied.  draw: a hash of (rep, id), by
    which rows fall into FOLDS parts in each of REPEATS random splits.  The driver holds the sums of groups and of (rep, part,
    group), never rows; the lines of BLOCK held-out groups go to the rows, and what comes back are counts."""
    spark = rows.sparkSession
    dealt = fanned(rows.select("id", "g", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))
    for rep in range(REPEATS):
        kept = dealt.columns
        dealt = dealt.withColumn("rep", F.lit(rep)).select(*kept, F.pmod(draw, F.lit(FOLDS)).cast("tinyint").alias(f"part_{rep}"))
    table = settle(dealt.select("g", "x", "y", F.array(*[f"part_{rep}" for rep in range(REPEATS)]).alias("parts")))
    own = sums(table, "g").toArrow()
    cells = sums(table.select("g", "x", "y", F.posexplode("parts").alias("rep", "part")), "rep", "part", "g").toArrow()
    far = table.agg(F.max(F.abs("x")), F.max(F.abs("y"))).first()

    import pyarrow.compute as pc

    figures = lambda t: np.stack([pc.fill_null(t[c], 0).to_numpy().astype(float) for c in SUMS])
    by_group, by_cell = figures(own), figures(cells)
    named = pc.is_valid(own["g"]).to_numpy()
    groups = own["g"].combine_chunks().filter(pc.is_valid(own["g"]).combine_chunks())
    total, single = by_group.sum(axis=1), by_group[:, named]
    code = pc.fill_null(pc.index_in(cells["g"], value_set=groups), len(groups)).to_numpy()
    place = cells["rep"].to_numpy().astype(int) * FOLDS + cells["part"].to_numpy()
    split = np.zeros((len(SUMS), len(groups) + 1, REPEATS * FOLDS))  # the last group has no name
    split[:, code, place] = by_cell
    rest, of_part = total[:, None] - single, split.sum(axis=1)

    z, out = NormalDist().inv_cdf(0.5 + level / 2), []
    for start in range(0, len(groups), BLOCK):
        held = np.arange(start, min(start + BLOCK, len(groups)))
        left = rest[:, held]
        fit, inner = _line(*left), _line(*(left[:, :, None] - single[:, None, :]))
        outer = _line(*(left[:, :, None] - (of_part[:, None, :] - split[:, held, :])))
        slope, base = (np.concatenate((inner[c], outer[c]), axis=1) for c in ("slope", "base"))
        ks = np.array([min(int(n), math.ceil(round((n + 1) * level, 9))) for n in left[0]])
        reach = (far[1] or 0.0) + np.abs(base) + np.abs(slope) * (far[0] or 0.0)
        v = _smallest(table, groups, held, slope, base, ks, float(reach[np.isfinite(reach)].max(initial=0.0)))
        for j, h in enumerate(held):
            if ks[j] > 0:
                by_rep = v[j, 1:][np.isfinite(v[j, 1:])]
                figure = (fit["slope"][j], fit["base"][j], z * fit["sd"][j], v[j, 0] / SCALE, by_rep.mean() / SCALE if len(by_rep) else math.nan)
                out.append((groups[int(h)].as_py(), *[float(f) if math.isfinite(f) else None for f in figure]))
    return spark.createDataFrame(out, T.StructType([T.StructField("g", rows.schema["g"].dataType), *[T.StructField(c, T.DoubleType()) for c in ("slope", "base", "hw_insample", "hw_group", "hw_row")]]))
