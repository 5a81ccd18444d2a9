"""Costs, paper orders, equity and trade statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barquarry.operators.indicators import drawdown, in_order

SPAN = 32  # bars in which orders and bars meet


def fill_price(price: Column, side: Column, slippage_bps: float = 5.0, spread_bps: float = 0.0) -> Column:
    return price * (1 + side * (slippage_bps + spread_bps / 2) / 1e4)


def commission(price: Column, shares: Column, bps: float = 0.0, per_share: float = 0.0) -> Column:
    return shares * price * bps / 1e4 + shares * per_share


def resolve_orders(orders: DataFrame, bars: DataFrame, max_hold: int | None = 20) -> DataFrame:
    """Long or short paper orders (symbol, decision bar, side, stop, target) after their decision bar. max_hold None: a column of the orders.

    Entry at the next bar's open; the first bar that touches stop or target closes the order (the stop wins
    ties), else the close of the max_hold-th bar; open if bars run out before, or none has come at all.

    Bars and orders meet by symbol and span of SPAN bars, so an order is compared with about max_hold + SPAN bars.
    """
    hold = F.col("max_hold") if max_hold is None else F.lit(max_hold)
    keys = ["symbol", "decision", "side", "stop", "target"]
    asked = orders.select(*keys, hold.cast("long").alias("hold"))
    asked = asked.withColumn("span", F.explode(F.sequence(F.expr(f"decision div {SPAN}"), F.expr(f"(decision + hold) div {SPAN}"))))
    at = bars.select("symbol", "bar_no", "open", "high", "low", "close", F.expr(f"bar_no div {SPAN}").alias("span"))
    met = asked.join(at, ["symbol", "span"]).where(F.col("bar_no").between(F.col("decision"), F.col("decision") + F.col("hold")))
    long, later = F.col("side") > 0, F.col("bar_no") > F.col("decision")  # the decision's own bar only keeps orders without a later one
    lost = later & F.when(long, F.col("low") <= F.col("stop")).otherwise(F.col("high") >= F.col("stop"))
    won = later & F.when(long, F.col("high") >= F.col("target")).otherwise(F.col("low") <= F.col("target"))
    out = met.groupBy(*keys, "hold").agg(
        F.min(F.when(later, F.struct("bar_no", "open")))["open"].alias("fill"), F.min(F.when(lost, F.col("bar_no"))).alias("lost"), F.min(F.when(won, F.col("bar_no"))).alias("won"), F.max(F.struct("bar_no", "close")).alias("end")
    )
    status = F.when(F.col("lost").isNotNull() & (F.col("won").isNull() | (F.col("lost") <= F.col("won"))), "loss").when(F.col("won").isNotNull(), "win").when(F.col("end.bar_no") == F.col("decision") + F.col("hold"), "timeout").otherwise("open")
    out = out.withColumn("status", status)
    exit_price = F.when(F.col("status") == "loss", F.col("stop")).when(F.col("status") == "win", F.col("target")).when(F.col("status") == "timeout", F.col("end.close"))
    held = F.when(F.col("status") == "loss", F.col("lost")).when(F.col("status") == "win", F.col("won")).when(F.col("status") == "timeout", F.col("end.bar_no")) - F.col("decision")
    r = F.col("side") * (exit_price - F.col("fill")) / F.nullif(F.abs(F.col("fill") - F.col("stop")), F.lit(0.0))
    fill = F.when(F.col("status") != "open", F.col("fill")) if max_hold is None else F.col("fill")
    return out.select("symbol", "decision", "side", "status", fill.alias("fill"), exit_price.alias("exit_price"), held.alias("held"), r.alias("r_multiple"))


def trade_stats(trades: DataFrame) -> DataFrame:
    """Per symbol over closed trades: count, win rate, profit factor in R, expectancy."""
    r = F.col("r_multiple")
    won, lost = F.sum(F.when(r > 0, r).otherwise(0.0)), -F.sum(F.when(r < 0, r).otherwise(0.0))
    return trades.where("status != 'open' and r_multiple is not null").groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(r > 0, 1.0).otherwise(0.0)).alias("win_rate"), F.when(lost > 0, won / lost).when(won > 0, float("inf")).otherwise(0.0).alias("profit_factor"), F.avg(r).alias("expectancy")
    )


#: Bars a year by interval.
BARS_PER_YEAR = {
    "1d": 252, "1wk": 52, "1mo": 12,
    "1h": 252 * 7, "60m": 252 * 7, "30m": 252 * 13,
    "15m": 252 * 26, "5m": 252 * 78, "2m": 252 * 195, "1m": 252 * 390,
}


def equity_stats(curve: DataFrame, interval: str = "1d") -> DataFrame:
    """Per symbol of an equity curve in `close`: total return, largest drawdown, annualised Sharpe ratio (0 if there is none)."""
    rows = curve.withColumn("dd", drawdown(F.col("close"))).withColumn("ret", F.col("close") / F.lag("close").over(in_order()) - 1)
    out = rows.groupBy("symbol").agg(F.min_by("close", "bar_no").alias("a"), F.max_by("close", "bar_no").alias("z"), F.min("dd").alias("max_drawdown"), F.avg("ret").alias("m"), F.stddev_samp("ret").alias("s"), F.count("ret").alias("k"))
    sharpe = F.when((F.col("k") >= 2) & (F.col("s") > 0), F.col("m") / F.col("s") * F.sqrt(F.lit(float(BARS_PER_YEAR.get(interval.lower(), 252))))).otherwise(0.0)
    return out.select("symbol", (F.col("z") / F.col("a") - 1).alias("total_return"), "max_drawdown", sharpe.alias("sharpe"))


def aggregate_curve(bars: DataFrame) -> DataFrame:
    """Equal-weight mean of all names rebased to 100 at the first date on which all have a bar; only such dates."""
    names = bars.agg(F.countDistinct("symbol").alias("names"))
    common = bars.groupBy("ts").agg(F.countDistinct("symbol").alias("k")).join(F.broadcast(names), F.col("k") == F.col("names")).select("ts")
    rows = bars.join(common, "ts")
    first = F.first_value("close").over(Window.partitionBy("symbol").orderBy("ts"))
    return rows.withColumn("value", 100 * F.col("close") / first).groupBy("ts").agg(F.avg("value").alias("value"))
