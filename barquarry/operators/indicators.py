"""Per-bar indicators as window functions. One sort by (symbol, bar_no) serves them all."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def in_order():
    """Each symbol's bars in order; made when used, as windows need a session."""
    return Window.partitionBy("symbol").orderBy("bar_no")


def last(n: int):
    return in_order().rowsBetween(-(n - 1), 0)


def enough(x: Column, out: Column, n: int, least: int) -> Column:
    """out where the last n rows hold at least `least` values of x."""
    return F.when(F.count(x).over(last(n)) >= least, out)


def mean(x: Column, n: int, least: int | None = None) -> Column:
    return enough(x, F.avg(x).over(last(n)), n, least or n)


def true_range() -> Column:
    before = F.lag("close").over(in_order())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def with_true_range(bars: DataFrame) -> DataFrame:
    return bars.withColumn("tr", true_range())


def with_atr_sma(bars: DataFrame, n: int = 14) -> DataFrame:
    return with_true_range(bars).withColumn("atr_sma", mean(F.col("tr"), n, max(2, n // 2)))


def with_atr_wilder(bars: DataFrame, n: int = 14, block: int = 256) -> DataFrame:
    """Wilder's average: a(0) = tr(0), a(t) = a(t-1) + (tr(t) - a(t-1)) / n; null before n values.

    In blocks of bars: a(t) is the weighted sum of its own block up to t and the average at the block before's end,
    which follows from the blocks' own sums.  Those of so many blocks are folded that what came before weighs less
    than 1e-17 of its value, whatever n is: no frame grows with the history, and no frame is longer than 38 n / block.
    """
    q = 1 - 1 / n
    block = min(block, max(8, int(600 / -math.log(q)) if n > 1 else block))  # powers of q stay in range
    back = 1 + math.ceil(39 * n / block)
    rows = with_true_range(bars).withColumns({"_block": F.expr(f"bar_no div {block}"), "_at": (F.col("bar_no") % block).cast("double")})
    if n == 1:
        return rows.withColumn("atr", F.col("tr")).drop("_block", "_at")
    share = F.when(F.col("bar_no") == 0, F.col("tr")).otherwise(F.col("tr") / n) * F.pow(F.lit(q), -F.col("_at"))
    inside = Window.partitionBy("symbol", "_block").orderBy("bar_no")
    rows = rows.withColumn("_own", F.sum(share).over(inside) * F.pow(F.lit(q), F.col("_at")))
    ends = rows.where(F.col("_at") == block - 1).select("symbol", (F.col("_block") + 1).alias("_block"), F.col("_own").alias("_end"))
    order = Window.partitionBy("symbol").orderBy("_block").rowsBetween(-back, 0)
    folded = F.aggregate(F.collect_list("_end").over(order), F.lit(0.0), lambda a, x: a * (q**block) + x)
    rows = rows.join(ends.select("symbol", "_block", folded.alias("_before")), ["symbol", "_block"], "left")
    whole = F.col("_own") + F.coalesce("_before", F.lit(0.0)) * F.pow(F.lit(q), F.col("_at") + 1)
    return rows.withColumn("atr", F.when(F.col("bar_no") >= n - 1, whole)).select(*bars.columns, "tr", "atr")


def percentile_rank(x: Column, n: int, least: int | None = None) -> Column:
    """Share of the last n rows that are not above the current value; rows without a value count in the total."""
    rows = F.collect_list(x).over(last(n))
    share = F.size(F.filter(rows, lambda v: v <= x)) / F.count(F.lit(1)).over(last(n))
    return F.when(x.isNotNull(), enough(x, share, n, least or max(3, n // 4)))


def slope(x: Column, n: int, least: int | None = None) -> Column:
    """Least-squares slope over the last n rows; null if any of them has no value, 0 for a flat frame."""
    whole = F.count(x).over(last(n)) == F.count(F.lit(1)).over(last(n))
    return F.when(whole, enough(x, F.coalesce(F.regr_slope(x, F.col("bar_no").cast("double")).over(last(n)), F.lit(0.0)), n, least or max(2, n // 2)))


def in_blocks(x: Column, n: int, names: str, step, merge, finish, block: int = 16) -> Column:
    """A fold over the last n rows that have x, in the order in which the SQL twins' engine takes a frame: rows before
    the first whole block of bar numbers, whole blocks merged one by one, rows after the last.

    Where frames tie (the same values in another order), rounding decides, so that order is part of the result.
    """
    zero = F.struct(*[F.lit(0.0).alias(name) for name in names.split()])
    rows = F.filter(F.collect_list(F.struct(F.col("bar_no").alias("at"), x.cast("double").alias("x"))).over(last(n)), lambda e: e["x"].isNotNull())
    first = F.ceil((F.greatest(F.col("bar_no") - (n - 1), F.lit(0))) / block) * block
    end = F.floor((F.col("bar_no") + 1) / block) * block
    starts = F.when(first < end, F.sequence(first, end - block, F.lit(block).cast("long"))).otherwise(F.array().cast("array<long>"))

    def fold(held: Column) -> Column:
        head = F.aggregate(F.filter(held, lambda e: e["at"] < first), zero, step)
        whole = F.transform(starts, lambda b: F.aggregate(F.filter(held, lambda e: (e["at"] >= b) & (e["at"] < b + block)), zero, step))
        joined = F.aggregate(F.filter(whole, lambda t: t["n"] > 0), head, lambda s, t: F.when(s["n"] == 0, t).otherwise(merge(s, t)))
        return F.aggregate(F.filter(held, lambda e: e["at"] >= F.greatest(first, end)), joined, step, finish)

    return F.transform(F.array(rows), fold)[0]  # so that the rows are collected once


def bandwidth(x: Column, n: int = 20, width: float = 2.0, least: int | None = None) -> Column:
    def step(s, e):
        mean = s["mean"] + (e["x"] - s["mean"]) / (s["n"] + 1)
        return F.struct((s["n"] + 1).alias("n"), mean.alias("mean"), (s["sq"] + (e["x"] - mean) * (e["x"] - s["mean"])).alias("sq"), (s["sum"] + e["x"]).alias("sum"))

    def merge(s, t):
        total, apart = s["n"] + t["n"], t["mean"] - s["mean"]
        return F.struct(total.alias("n"), (s["mean"] + apart * t["n"] / total).alias("mean"), (t["sq"] + s["sq"] + apart * apart * t["n"] * s["n"] / total).alias("sq"), (s["sum"] + t["sum"]).alias("sum"))

    def finish(s):
        rows = F.nullif(s["n"], F.lit(0.0))
        return 2 * width * F.sqrt(s["sq"] / rows) / F.nullif(s["sum"] / rows, F.lit(0.0))

    ratio = in_blocks(x, n, "n mean sq sum", step, merge, finish)
    return enough(x, ratio, n, least or max(2, n // 2))


def falling(x: Column, n: int, least: int | None = None) -> Column:
    """Whether the least-squares slope over the last n rows is below 0; null if any of them has no value."""

    def step(s, e):
        at = e["at"].cast("double")
        mean = s["mean"] + (e["x"] - s["mean"]) / (s["n"] + 1)
        return F.struct((s["n"] + 1).alias("n"), (s["mid"] + (at - s["mid"]) / (s["n"] + 1)).alias("mid"), mean.alias("mean"), (s["co"] + (at - s["mid"]) * (e["x"] - mean)).alias("co"))

    def merge(s, t):
        total = s["n"] + t["n"]
        both = [((t["n"] * t[c] + s["n"] * s[c]) / total).alias(c) for c in ("mid", "mean")]
        return F.struct(total.alias("n"), *both, (t["co"] + s["co"] + (s["mid"] - t["mid"]) * (s["mean"] - t["mean"]) * t["n"] * s["n"] / total).alias("co"))

    whole = F.count(x).over(last(n)) == F.count(F.lit(1)).over(last(n))
    return F.when(whole, enough(x, in_blocks(x, n, "n mid mean co", step, merge, lambda s: s["co"] < 0), n, least or max(2, n // 2)))


def change(x: Column, n: int = 1, skip: int = 0) -> Column:
    now = F.lag(x, skip).over(in_order()) if skip else x
    return F.try_divide(now, F.lag(x, n).over(in_order())) - 1


def realised_vol(x: Column, n: int = 20) -> Column:
    return enough(x, F.stddev_samp(x).over(last(n)), n, n)


def vwap_distance(n: int = 120) -> Column:
    frame = last(n)
    vwap = F.sum(F.col("close") * F.col("volume")).over(frame) / F.nullif(F.sum("volume").over(frame), F.lit(0.0))
    span = F.nullif(F.max("high").over(frame) - F.min("low").over(frame), F.lit(0.0))
    return F.when(F.col("bar_no") >= n - 1, (F.col("close") - vwap) / span)


def close_location() -> Column:
    h, lo, c = F.col("high"), F.col("low"), F.col("close")
    value = ((c - lo) - (h - c)) / (h - lo)
    return F.when(h - lo <= 1e-12, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value)))


def flow_imbalance(n: int = 5) -> Column:
    return mean((F.col("vbuy") - F.col("vsell")) / (F.col("vbuy") + F.col("vsell") + 1e-12), n)


def drawdown(x: Column) -> Column:
    return x / F.max(x).over(in_order().rowsBetween(Window.unboundedPreceding, 0)) - 1


def with_runs(bars: DataFrame, flag: str) -> DataFrame:
    """run_id and run_length (bars so far) of unbroken runs in which a flag holds; 0 length where it does not."""
    off = F.sum((~F.coalesce(F.col(flag), F.lit(False))).cast("int")).over(in_order().rowsBetween(Window.unboundedPreceding, 0))
    out = bars.withColumn("run_id", off)
    inside = Window.partitionBy("symbol", "run_id").orderBy("bar_no")
    return out.withColumn("run_length", F.sum(F.coalesce(F.col(flag), F.lit(False)).cast("int")).over(inside))


def runs(bars: DataFrame, flag: str) -> DataFrame:
    """One row per run in which a flag holds: symbol, start, end, n_bars."""
    held = with_runs(bars, flag).where(F.coalesce(F.col(flag), F.lit(False)))
    return held.groupBy("symbol", "run_id").agg(F.min("bar_no").alias("start"), F.max("bar_no").alias("end"), F.count(F.lit(1)).alias("n_bars")).drop("run_id")
