"""Results as flat tables, JSON and text, and the tables that figures are drawn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_json(df: DataFrame, keys: list[str], name: str = "body") -> DataFrame:
    """The keys and the rest of each row as one JSON object."""
    return df.select(*keys, F.to_json(F.struct(*[c for c in df.columns if c not in keys])).alias(name))


def located(price: Column, low: Column, high: Column) -> Column:
    """Where a price stands to a value area: above_value, below_value or in_value (the edges belong to it)."""
    return F.when(price > high, "above_value").when(price < low, "below_value").otherwise("in_value")


def events(found: DataFrame, kind: str | None = None) -> DataFrame:
    """The events of decisions as rows, of one kind if given."""
    rows = found.select("symbol", "bar_no", F.explode("events").alias("e")).select("symbol", "bar_no", "e.*")
    return rows if kind is None else rows.where(F.col("kind") == kind)


def recent(rows: DataFrame, n: int = 1) -> DataFrame:
    """Per symbol and decision its n events with the latest anchors, the latest first; of equal anchors by kind."""
    order = Window.partitionBy("symbol", "bar_no").orderBy(F.col("anchor").desc(), "kind", "direction")
    return rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n)


def summary(results: DataFrame) -> DataFrame:
    """A line of text for each backtest result."""
    pf = F.when(F.col("profit_factor") == float("inf"), "inf").otherwise(F.format_number("profit_factor", 2))
    text = F.concat_ws(" | ", F.format_string("return %.2f%%", "total_return_pct"), F.format_string("trades %d", F.col("n_trades").cast("long")), F.format_string("win %.1f%%", F.col("win_rate") * 100), F.concat(F.lit("PF "), pf), F.format_string("max DD %.2f%%", "max_drawdown_pct"), F.format_string("Sharpe %.2f", "sharpe"))
    return results.withColumn("text", text)


def strength_bar(strength: Column, width: int = 10) -> Column:
    return F.repeat(F.lit("█"), F.round(strength * width).cast("int"))


def histogram_of(rows: DataFrame, by: list[str], x: str, bins: int = 20) -> DataFrame:
    """Counts of x in `bins` bins of equal width between its least and greatest value: what a distribution is drawn from."""
    ends = rows.groupBy(*by).agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col(x) - F.col("lo")) / width))).otherwise(0).cast("int")
    both = rows.join(F.broadcast(ends), by) if by else rows.crossJoin(F.broadcast(ends))  # one row a group
    return both.withColumn("bin", at).groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.first(F.col("lo") + at * width).alias("left"))


def drawdown_frame(curve: DataFrame, keys: list[str]) -> DataFrame:
    """An equity curve with its running peak and drawdown in percent: what the equity figure reads."""
    peak = F.max("equity").over(Window.partitionBy(*keys).orderBy("bar_no").rowsBetween(Window.unboundedPreceding, 0))
    return curve.withColumn("peak", peak).withColumn("drawdown_pct", (F.col("equity") / F.col("peak") - 1) * 100)


def chart_frame(bars: DataFrame, decision: DataFrame) -> DataFrame:
    """Bars with the levels of the symbol's latest decision and whether each bar closes inside its value area."""
    back = Window.partitionBy("symbol").orderBy(F.col("bar_no").desc())
    newest = decision.withColumn("nth", F.row_number().over(back)).where("nth = 1").select("symbol", "poc", "vah", "val")
    out = bars.join(newest, "symbol")
    return out.withColumn("where", located(F.col("close"), F.col("val"), F.col("vah")))
