"""Keyed draws and block resampling.

A draw is a hash of its key, so it is the same on any number of partitions, and adding
a statistic moves no other one.

Units that a calendar or a design bounds (days, months, clusters) are redrawn as often as there are of them.  Items, of which
there may be any number, are weighted in place: each is drawn a Poisson(1) number of times, so that draws
times items are summed up where the items are and never shuffled.
"""

from __future__ import annotations

import hashlib
import math
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.ordered import fanned, rank0


def draw(*key: str | int | Column) -> Column:
    """32 random bits of a key; the first part is the name of the stream, the others columns."""
    parts = [F.lit(k) if i == 0 and isinstance(k, str) else F.col(k) if isinstance(k, str) else F.lit(k) if isinstance(k, int) else k for i, k in enumerate(key)]
    said = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(said), 1, 8), 16, 10).cast("long")


def uniform(*key: str | int | Column) -> Column:
    return (draw(*key) + 0.5) / 4294967296.0


#: Distribution function of the Poisson law of mean one, up to where 32 bits tell it from one.
POISSON = [math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1)) for k in range(12)]
DRAWS = 2_000


#: The least of 32 bits from which a uniform is at least each of POISSON.
_STEPS = np.array([t for t in (math.ceil(Fraction(c) * 2**32 - Fraction(1, 2)) for c in POISSON) if t < 2**32], np.uint32)
_SHIFTS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_WORDS = [i for i in range(16)] + [(5 * i + 1) % 16 for i in range(16)] + [(3 * i + 5) % 16 for i in range(16)] + [(7 * i) % 16 for i in range(16)]
#: Hashes made at once: some 256 KB an operand.
_CELLS = 1 << 16


def hashed(heads: np.ndarray, tails: np.ndarray) -> np.ndarray:
    """heads x tails: `draw` of each head followed by each tail (rows of bytes), that is the first 32 bits of their MD5."""
    size, cut = heads.shape[1] + tails.shape[1], heads.shape[1]
    if size > 55:  # more than one block
        return np.array([[int.from_bytes(hashlib.md5(h.tobytes() + t.tobytes()).digest()[:4], "big") for t in tails] for h in heads], np.uint32).reshape(len(heads), len(tails))
    one, other = np.zeros((len(heads), 64), np.uint8), np.zeros((len(tails), 64), np.uint8)
    one[:, :cut], other[:, cut:size], other[:, size] = heads, tails, 0x80
    other[:, 56:58] = 8 * size % 256, 8 * size // 256
    one, other = one.view("<u4").astype(np.uint32), other.view("<u4").astype(np.uint32)
    whole = (len(heads), len(tails))
    a, b, c, d = (np.full(whole, v, np.uint32) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    t, u, words = np.empty(whole, np.uint32), np.empty(whole, np.uint32), []
    for k in range(16):
        x, y = one[:, k : k + 1], other[:, k]
        words.append((x if not y.any() else y if not x.any() else x | y) if x.any() or y.any() else np.uint32(0))
    for i in range(61):  # later rounds leave the first word alone
        if i < 16:
            np.bitwise_xor(c, d, out=t), np.bitwise_and(t, b, out=t), np.bitwise_xor(t, d, out=t)
        elif i < 32:
            np.bitwise_xor(b, c, out=t), np.bitwise_and(t, d, out=t), np.bitwise_xor(t, c, out=t)
        elif i < 48:
            np.bitwise_xor(b, c, out=t), np.bitwise_xor(t, d, out=t)
        else:
            np.invert(d, out=t), np.bitwise_or(t, b, out=t), np.bitwise_xor(t, c, out=t)
        t += a
        with np.errstate(over="ignore"):
            t += words[_WORDS[i]] + _SINES[i]
        np.left_shift(t, _SHIFTS[i], out=u), np.right_shift(t, 32 - _SHIFTS[i], out=t)
        t |= u
        t += b
        a, b, c, d, t = d, t, b, c, a
    return (b + np.uint32(0x67452301)).byteswap()


def weighted_sums(items: DataFrame, stream: str, draws: int, key: str, value: str) -> DataFrame:
    """b, w, s: for each draw the times that items are drawn, and the sum of their values, each as often.

    An item is drawn a Poisson(1) number of times, from `draw` of (stream, b, key); items without a key are not drawn, and
    missing values add nothing.  A task hashes its items for all draws in blocks of _CELLS, and only sums move."""
    rows = fanned(items.select(F.col(key).cast("string").alias("key"), F.col(value).cast("double").alias("value")).where("key IS NOT NULL"))

    def run(batches):
        import pyarrow as pa

        total = np.zeros((draws, 3))  # times, times where there is a value, sum
        heads = [np.frombuffer(f"{stream}|{b}|".encode(), np.uint8) for b in range(draws)]
        same = np.flatnonzero(np.diff([0, *map(len, heads)])).tolist() + [draws]  # draws whose numbers are of one length
        for batch in batches:
            said = [k.encode() for k in batch["key"].to_pylist()]
            v = batch["value"].to_numpy(zero_copy_only=False)
            there = batch["value"].is_valid().to_numpy(zero_copy_only=False)
            table = np.stack((np.ones(len(v)), there, np.where(there, v, 0.0)), axis=1)
            size = np.array([len(k) for k in said])
            for n in np.unique(size):
                mine = np.flatnonzero(size == n)
                tails = np.frombuffer(b"".join(said[i] for i in mine), np.uint8).reshape(len(mine), n)
                step = max(1, _CELLS // len(mine))
                for first, last in zip(same, same[1:], strict=False):
                    for b in range(first, last, step):
                        bits = hashed(np.stack(heads[b : min(b + step, last)]), tails)
                        times = np.zeros(bits.shape, np.uint8)
                        for least in _STEPS:
                            times += bits >= least
                        total[b : b + len(bits)] += times.astype(float) @ table[mine]
        some = total[:, 1] > 0
        yield pa.RecordBatch.from_pydict({"b": pa.array(range(draws), pa.int64()), "w": pa.array(total[:, 0].astype(np.int64)), "s": pa.array(total[:, 2], mask=~some)})

    return rows.mapInArrow(run, "b long, w long, s double").groupBy("b").agg(F.sum("w").alias("w"), F.sum("s").alias("s"))


def redrawn(units: DataFrame, stream: str, draws: int, order: str) -> DataFrame:
    """b, i and a unit's columns: `draws` samples with replacement of as many units as there are.

    `units` has one row a unit (a day, a cluster, an item) with sufficient statistics: never its rows.
    The samples' (b, i) are made where they are joined, and only numbers are shuffled."""
    spark = units.sparkSession
    numbered = rank0(units, [order], "u_")
    n = units.agg(F.count(F.lit(1)).alias("n_"))
    wanted = spark.range(draws).withColumnRenamed("id", "b").crossJoin(F.broadcast(n))  # one row
    wanted = wanted.select("b", "n_", F.explode(F.sequence(F.lit(0), F.col("n_") - 1)).alias("i")).where("n_ > 0")
    return wanted.withColumn("u_", (draw(stream, "b", "i") % F.col("n_")).cast("long")).join(numbered, "u_").drop("u_", "n_")


def interval(values: DataFrame, value: str, *by: str, tail: float = 0.025, digits: int = 6) -> DataFrame:
    """lo and hi over the draws; draws where the statistic is undefined are left out."""
    q = F.percentile(F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double")), F.array(F.lit(tail), F.lit(1 - tail)))
    return values.groupBy(*by).agg(q.alias("q_")).select(*by, F.round(F.element_at("q_", 1), digits).alias("lo"), F.round(F.element_at("q_", 2), digits).alias("hi"))


def moving_blocks(series: DataFrame, value: str, stream: str, draws: int, *by: str, order: str = "date", block: int = 5) -> DataFrame:
    """by, b, rate: means of blocks of successive rows from any start, cut to the series' length, by prefix sums.

    A series shorter than three blocks takes blocks of a third of it (two rows at least); under six rows it has none."""
    w = Window.partitionBy(*by).orderBy(order)
    sums = series.select(*by, F.row_number().over(w).cast("long").alias("p_"), F.sum(F.col(value).cast("double")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s_"))
    sizes = sums.groupBy(*by).agg(F.max("p_").alias("n_")).where("n_ >= 6")
    length = F.greatest(F.lit(2), F.least(F.lit(block), F.floor(F.col("n_") / 3))).cast("long")
    cells = sizes.withColumn("l_", length).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(draws - 1).cast("long"))))
    blocks = cells.withColumn("j_", F.explode(F.sequence(F.lit(0).cast("long"), (F.ceil(F.col("n_") / F.col("l_")) - 1).cast("long"))))
    start = draw(stream, *by, "b", "j_") % (F.col("n_") - F.col("l_") + 1)
    ends = blocks.withColumn("from_", start.cast("long")).withColumn("to_", F.col("from_") + F.least(F.col("l_"), F.col("n_") - F.col("j_") * F.col("l_")))
    before = sums.select(*by, F.col("p_").alias("from_"), F.col("s_").alias("a_"))
    upto = sums.select(*by, F.col("p_").alias("to_"), F.col("s_").alias("z_"))
    held = ends.join(upto, [*by, "to_"]).join(before, [*by, "from_"], "left")
    return held.groupBy(*by, "b").agg((F.sum(F.col("z_") - F.coalesce("a_", F.lit(0.0))) / F.first("n_")).alias("rate"))
