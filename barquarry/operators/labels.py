"""Labels and cross-sectional panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barquarry.operators import indicators as ind
from barquarry.operators.indicators import in_order


def sampled(bars: DataFrame, lookback: int = 120, stride: int = 3, horizon: int = 20) -> DataFrame:
    """Decision bars: from lookback - 1 on, every stride bars, with a whole horizon ahead."""
    n = F.max("bar_no").over(Window.partitionBy("symbol")) + 1
    out = bars.withColumn("n", n)
    return out.where((F.col("bar_no") >= lookback - 1) & ((F.col("bar_no") - (lookback - 1)) % stride == 0) & (F.col("bar_no") < F.col("n") - horizon)).drop("n")


def with_forward_return(bars: DataFrame, horizon: int = 20) -> DataFrame:
    return bars.withColumn("forward", F.lead("close", horizon).over(in_order()) / F.col("close") - 1)


def factor_samples(bars: DataFrame, lag: int = 20, horizon: int = 20, stride: int = 5) -> DataFrame:
    """symbol, row_no, x (change over `lag` bars) and y (forward return) of every stride-th bar that has both.

    stride 1 takes every bar, as the reference does.  The default of 5 is what the queries with an SQL twin sample; a label
    then reaches over ceil(horizon / stride) samples, which is what splits have to purge.
    """
    out = with_forward_return(bars.withColumn("x", ind.change(F.col("close"), lag)), horizon)
    out = sampled(out, lag + 1, stride, horizon).where("x is not null and forward is not null")
    return out.select("symbol", F.expr(f"(bar_no - {lag}) div {stride}").alias("row_no"), "x", F.col("forward").alias("y"))


def triple_barrier(bars: DataFrame, horizon: int = 20, profit: float = 2.0, stop: float = 2.0, side: int = 1, stride: int = 3, lookback: int = 120) -> DataFrame:
    """First touch of a profit or stop barrier (in ATR shares of the entry's close) within the horizon; the stop wins ties."""
    share = F.col("atr_sma") / F.col("close")
    every = ind.with_atr_sma(bars)
    bets = sampled(every, lookback, stride, 0).select("symbol", "bar_no", F.col("close").alias("price"), F.when(share > 0, share).otherwise(0.01).alias("v"), F.lit(side).alias("side"))
    return triple_barrier_at(bars, bets, horizon, profit, stop).drop("side").withColumnRenamed("bar_no", "entry")


def triple_barrier_at(bars: DataFrame, bets: DataFrame, horizon: int = 20, profit: float = 2.0, stop: float = 2.0) -> DataFrame:
    """Bets (symbol, bar_no, price, v, side) with what becomes of them: outcome, ret, win, exit (bar), holding (bars).

    Bets and bars meet by symbol and span of `horizon` bars: a bet is compared with at most two spans however long the
    history is.  A bet on the last bar ends where it began, with outcome 0 and return 0.
    """
    long = F.col("side") > 0
    up = F.col("price") * (1 + F.when(long, profit).otherwise(stop) * F.col("v"))
    down = F.col("price") * (1 - F.when(long, stop).otherwise(profit) * F.col("v"))
    span = F.explode(F.sequence(F.expr(f"bar_no div {horizon}"), F.expr(f"(bar_no + {horizon}) div {horizon}")))
    bets = bets.select("symbol", F.col("bar_no").alias("entry"), "price", "side", up.alias("up"), down.alias("down"), span.alias("span"))
    ahead = bars.select("symbol", "bar_no", "high", "low", "close", F.expr(f"bar_no div {horizon}").alias("span"))
    met = bets.join(ahead, ["symbol", "span"]).where(F.col("bar_no").between(F.col("entry"), F.col("entry") + horizon))
    later = F.col("bar_no") > F.col("entry")  # the entry's own bar only keeps bets without a later one
    hit_up, hit_down = later & (F.col("high") >= F.col("up")), later & (F.col("low") <= F.col("down"))
    lost, won = (long & hit_down) | (~long & hit_up), (long & hit_up) | (~long & hit_down)
    out = met.groupBy("symbol", "entry", "price", "side", "up", "down").agg(F.min(F.when(lost, F.col("bar_no"))).alias("lost"), F.min(F.when(won, F.col("bar_no"))).alias("won"), F.max(F.struct("bar_no", "close")).alias("end"))
    out = out.withColumn("outcome", F.when(F.col("lost").isNotNull() & (F.col("won").isNull() | (F.col("lost") <= F.col("won"))), -1).when(F.col("won").isNotNull(), 1).otherwise(0))
    stop_price, goal = F.when(long, F.col("down")).otherwise(F.col("up")), F.when(long, F.col("up")).otherwise(F.col("down"))
    price = F.when(F.col("outcome") == -1, stop_price).when(F.col("outcome") == 1, goal).otherwise(F.col("end.close"))
    at = F.when(F.col("outcome") == -1, F.col("lost")).when(F.col("outcome") == 1, F.col("won")).otherwise(F.col("end.bar_no"))
    ret = F.col("side") * (price / F.col("price") - 1)
    return out.select("symbol", F.col("entry").alias("bar_no"), "side", "outcome", ret.alias("ret"), (ret > 0).cast("int").alias("win"), at.alias("exit"), (at - F.col("entry")).alias("holding"))


def holding_histogram(labels: DataFrame, horizon: int = 20) -> DataFrame:
    """Per symbol and holding period (1 to the horizon): bets and wins; with them the mean holding of won and lost bets."""
    held = F.greatest(F.lit(1), F.least(F.lit(horizon), F.col("holding"))).cast("long")
    by = labels.groupBy("symbol", held.alias("holding")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("win").cast("long")).alias("wins"))
    means = labels.groupBy("symbol").agg(F.avg(F.when(F.col("win") == 1, F.col("holding"))).alias("mean_won"), F.avg(F.when(F.col("win") == 0, F.col("holding"))).alias("mean_lost"))
    return by.join(means, "symbol")


def holding_stats(labels: DataFrame, horizon: int = 20) -> DataFrame:
    """Per symbol: labels, win rate, mean holding, its quartiles and the share that ran to the horizon."""
    return labels.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("win").cast("double")).alias("win_rate"), F.avg("holding").alias("mean_holding"),
        F.percentile("holding", 0.25).alias("q1"), F.percentile("holding", 0.5).alias("q2"), F.percentile("holding", 0.75).alias("q3"),
        F.avg(F.when(F.col("holding") >= horizon, 1.0).otherwise(0.0)).alias("capped"),
    )


def average_rank(x: str, by: list[str]):
    """Rank from 1, ties sharing the mean of their ranks."""
    return F.rank().over(Window.partitionBy(*by).orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, x)) - 1) / 2.0


def panel(bars: DataFrame, horizon: int = 20, rebalance: int = 5, least: int = 5) -> DataFrame:
    """Per rebalance date and name, four factors as centred ranks (average ties) in [-0.5, 0.5], and the forward return."""
    c, v = F.col("close"), F.col("volume")
    out = bars.withColumn("ret", ind.change(c))
    out = out.withColumns({"mom": ind.change(c, 20), "mom_long": ind.change(c, 120, 20), "vol": ind.realised_vol(F.col("ret"), 60), "trend": ind.mean(v, 20) / F.nullif(ind.mean(v, 60), F.lit(0.0)) - 1})
    out = with_forward_return(out, horizon)
    # a row for each date, however many names there are
    days = bars.select("ts").distinct().withColumn("day", F.row_number().over(Window.orderBy("ts")) - 1).where(F.col("day") % rebalance == 0).drop("day")
    names = ["mom", "mom_long", "vol", "trend"]
    out = out.join(days, "ts").where(" and ".join(f"{x} is not null" for x in [*names, "forward"]))
    out = out.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("ts"))).where(F.col("k") >= least)
    for x in names:
        out = out.withColumn(f"r_{x}", (average_rank(x, ["ts"]) - 1) / (F.col("k") - 1) - 0.5)
    return out.select("ts", "symbol", *[f"r_{x}" for x in names], "forward")
