"""Panels: grids, alignment, bounded fills, calendars and reshaping."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dedup_first(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key in a stated order (dropDuplicates promises none)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("first_", F.row_number().over(w)).where("first_ = 1").drop("first_")


def grid(df: DataFrame, ts: str, step: str) -> DataFrame:
    """ts: every step from the first to the last time, as one column."""
    ends = df.agg(F.min(ts).alias("a"), F.max(ts).alias("b"))
    return ends.select(F.explode(F.sequence("a", "b", F.expr(f"interval {step}"))).alias(ts))


def reindex(df: DataFrame, axis: DataFrame, on: str) -> DataFrame:
    return axis.join(df, on, "left")


def densify(df: DataFrame, date_col: str, slot: str) -> DataFrame:
    """A row for each date and slot that occur; windows over rows then count days.
    Both sides of the product are distinct keys; the slots of a day are few, so Spark broadcasts them if they are small."""
    return df.select(date_col).distinct().crossJoin(df.select(slot).distinct()).join(df, [date_col, slot], "left")


def bounded_fill(value: str, reach: int, *, by: list[str], order: str) -> tuple[Column, Column]:
    """The last value no more than `reach` rows back, and whether the row has its own."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-reach, 0)
    return F.last(value, ignorenulls=True).over(w), F.col(value).isNotNull()


def row_sum(*names: str) -> Column:
    """Sum across columns; null only if all are."""
    some = F.coalesce(*[F.col(n) for n in names]).isNotNull()
    total = F.lit(0.0)
    for n in names:
        total = total + F.coalesce(F.col(n).cast("double"), F.lit(0.0))
    return F.when(some, total)


def pick(df: DataFrame, keyword: str) -> str:
    """The first column whose name holds the keyword, in any case."""
    for name in df.columns:
        if keyword.lower() in name.lower():
            return name
    raise KeyError(keyword)


def local_calendar(ts: str, zone: str) -> list[Column]:
    """date, slot (quarter-hour of the day) and month of a UTC time in a zone."""
    local = F.from_utc_timestamp(F.col(ts), zone)
    return [F.to_date(local).alias("date"), (F.hour(local) * 4 + F.floor(F.minute(local) / 15)).cast("int").alias("slot"), F.date_format(local, "yyyy-MM").alias("month")]


def season(day: str) -> Column:
    m = F.month(day)
    return F.when(m.isin(12, 1, 2), "DJF").when(m.isin(3, 4, 5), "MAM").when(m.isin(6, 7, 8), "JJA").otherwise("SON")


def regime(wear: str, fresh: float = 0.30, limit: float = 0.60) -> Column:
    return F.when(F.col(wear) < fresh, "fresh").when(F.col(wear) < limit, "mid").otherwise("worn")


#: Name, first and last day of each stress window of the test data.
STRESS_WINDOWS = [("first squeeze", date(1996, 2, 1), date(1996, 4, 30)), ("long slide", date(1998, 7, 1), date(1998, 12, 31)), ("late shock", date(2000, 3, 1), date(2000, 5, 31))]


def stress_tag(day: str, windows: list = STRESS_WINDOWS) -> Column:
    """Name of the window that a day lies in, '' if none; a later window wins."""
    tag = F.lit("")
    for name, first, last in windows:
        tag = F.when(F.col(day).between(F.lit(first), F.lit(last)), name).otherwise(tag)
    return tag


def to_wide(df: DataFrame, row: str, column: str, value: str, columns: list, how: str = "avg") -> DataFrame:
    """Long to wide; `columns` are stated, so no extra pass finds them.  how: avg or first non-null."""
    agg = F.avg(value) if how == "avg" else F.first(value, ignorenulls=True)
    return df.groupBy(row).pivot(column, columns).agg(agg)


def to_long(df: DataFrame, ids: list[str], values: list[str], name: str, value: str) -> DataFrame:
    return df.unpivot(ids, values, name, value)


def clip(value: Column, low: float, high: float) -> Column:
    """Null stays null (greatest and least would skip it)."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def trimmed(df: DataFrame, day: str, first: str, last: str) -> DataFrame:
    """Rows of a reporting window; a plain predicate, so that it reaches the scan."""
    return df.where(F.col(day).between(F.lit(first).cast("date"), F.lit(last).cast("date")))
