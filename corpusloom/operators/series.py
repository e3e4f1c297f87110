"""Metric series as windows over (series, order): trends, plateaus, regressions, breaches, spikes, averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALL = (Window.unboundedPreceding, Window.currentRow)


class Series:
    """Columns over one series; ``value`` is read as higher-is-better."""

    def __init__(self, series: str, order: list[str], value: str):
        self.w = Window.partitionBy(series).orderBy(*order)
        self.v = F.col(value)
        self.n = F.row_number().over(self.w)

    def improvement(self, window: int) -> Column:
        """The value less the best of the ``window`` before it; 0 at the first."""
        best = F.max(self.v).over(self.w.rowsBetween(-window, -1))
        return F.coalesce(self.v - best, F.lit(0.0))

    def plateaued(self, patience: int, delta: float) -> Column:
        """The last ``patience`` values gained no more than ``delta`` on the best before them."""
        recent = F.max(self.v).over(self.w.rowsBetween(-(patience - 1), 0))
        base = F.max(self.v).over(self.w.rowsBetween(Window.unboundedPreceding, -patience))
        return F.coalesce(recent <= base + delta, F.lit(False))

    def stable_above(self, threshold: float, window: int) -> Column:
        rows = self.w.rowsBetween(-(window - 1), 0)
        return (F.count(self.v).over(rows) == window) & (F.min(self.v).over(rows) >= threshold)

    def regressed(self, drop: float, lookback: int = 0) -> Column:
        """The value lies ``drop`` or more below the peak before it."""
        start = -lookback if lookback else Window.unboundedPreceding
        return F.coalesce(F.max(self.v).over(self.w.rowsBetween(start, -1)) - self.v >= drop, F.lit(False))

    def spike(self, factor: float, window: int, least: int = 4) -> Column:
        """The value exceeds ``factor`` times the mean of the ``window`` before it, of ``least`` or more."""
        rows = self.w.rowsBetween(-window, -1)
        mean = F.avg(self.v).over(rows)
        return F.coalesce((F.count(self.v).over(rows) >= least) & (mean > 0) & (self.v > mean * factor), F.lit(False))

    def delta(self) -> Column:
        return self.v - F.lag(self.v).over(self.w)


def with_slope(df: DataFrame, series: str, order: list[str], value: str) -> DataFrame:
    """Adds slope: the running least-squares slope of the value over its place, 0 below two points."""
    w = Window.partitionBy(series).orderBy(*order)
    df = df.withColumn("__x", (F.row_number().over(w) - 1).cast("double"))
    slope = F.regr_slope(F.col(value), F.col("__x")).over(w.rowsBetween(*ALL))
    return df.withColumn("slope", F.coalesce(slope, F.lit(0.0))).drop("__x")


def breaches(df: DataFrame, series: str, order: list[str], bad: Column, k: int, name: str = "breaches") -> DataFrame:
    """Adds the length of the run of bad values up to each row, and whether it has reached ``k``: islands between resets."""
    w = Window.partitionBy(series).orderBy(*order)
    df = df.withColumn("__bad", F.coalesce(bad, F.lit(False))).withColumn("__island", F.sum(F.when(F.col("__bad"), 0).otherwise(1)).over(w.rowsBetween(*ALL)))
    run = F.sum(F.col("__bad").cast("int")).over(Window.partitionBy(series, "__island").orderBy(*order).rowsBetween(*ALL))
    return df.withColumn(name, F.when(F.col("__bad"), run).otherwise(F.lit(0)).cast("int")).withColumn("alarm", F.col(name) >= k).drop("__bad", "__island")


def throughput_collapse(df: DataFrame, series: str, order: list[str], value: str, least_ratio: float, warmup: int, k: int) -> DataFrame:
    w = Window.partitionBy(series).orderBy(*order)
    peak = F.max(value).over(w.rowsBetween(*ALL))
    df = df.withColumn("__low", (F.row_number().over(w) >= warmup) & (peak > 0) & (F.col(value) < peak * least_ratio))
    return breaches(df, series, order, F.col("__low"), k).drop("__low")


def ema(df: DataFrame, series: str, order: list[str], value: str, alpha: float, block: int = 100_000) -> DataFrame:
    """Adds ema: a recursive average that begins with a series' first value.

    Blocks of a series are averaged side by side from nothing; what a block begins with fades by (1 - alpha) a row, so its
    rows are mended when the ends of the blocks before, a row each, are known.  A null makes the rest of its series null.
    """
    import pandas as pd

    n = F.row_number().over(Window.partitionBy(series).orderBy(*order)) - 1
    rows = df.select(series, *order, F.col(value).cast("double").alias(value)).withColumn("__n", n).withColumn("__b", F.floor(F.col("__n") / block))
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in rows.columns)

    def local(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("__n")
        held, out, first = 0.0, [], part["__n"].iloc[0] == 0
        for i, x in enumerate(part[value]):
            held = x if first and i == 0 else alpha * x + (1 - alpha) * held
            out.append(held)
        return part.assign(__e=out, __d=[0.0 if first else (1 - alpha) ** (k + 1) for k in range(len(out))])

    def carry(ends: pd.DataFrame) -> pd.DataFrame:
        ends = ends.sort_values("__b")
        held, out = 0.0, []
        for e, d in zip(ends["__e"], ends["__d"]):
            out.append(held)
            held = e + d * held
        return ends.assign(__c=out)[[series, "__b", "__c"]]

    made = rows.groupBy(series, "__b").applyInPandas(local, f"{schema}, __e double, __d double")
    ends = made.groupBy(series, "__b").agg(F.max_by("__e", "__n").alias("__e"), F.max_by("__d", "__n").alias("__d"))
    begun = ends.groupBy(series).applyInPandas(carry, f"`{series}` {kinds[series]}, __b bigint, __c double")
    return made.join(begun, [series, "__b"]).select(series, *order, value, (F.col("__e") + F.col("__d") * F.col("__c")).alias("ema"))


def carried_forward(df: DataFrame, series: str, order: list[str], value: str, every: int) -> DataFrame:
    """Adds held: the value at every ``every``-th row, carried on to the rows between."""
    w = Window.partitionBy(series).orderBy(*order)
    df = df.withColumn("__n", F.row_number().over(w) - 1)
    at = F.when(F.col("__n") % every == 0, F.col(value))
    return df.withColumn("held", F.last(at, ignorenulls=True).over(w.rowsBetween(*ALL))).drop("__n")
