"""The forward paper walk: decide with what is known, note the order once, resolve it with the bars that come later."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barquarry.operators import backtest, decisions
from barquarry.operators.models import upsert

LEDGER = ["symbol", "decision", "decision_date", "side", "stop", "target", "max_hold", "quality", "bias_score"]


def build_orders(plans: DataFrame, bars: DataFrame, max_hold: int = 20) -> DataFrame:
    """Actionable plans (see decisions.signals) as open orders on their first target, dated by their bar; a bar without a date is an error."""
    dated = plans.where("action in ('LONG', 'SHORT') and stop is not null and size(targets) > 0").join(bars.select("symbol", "bar_no", "ts"), ["symbol", "bar_no"])
    date = F.when(F.col("ts").isNull(), F.raise_error(F.lit("a decision without a date"))).otherwise(F.col("ts").cast("date"))
    return dated.select("symbol", F.col("bar_no").alias("decision"), date.alias("decision_date"), "side", "stop", F.col("targets")[0].alias("target"), F.lit(max_hold).alias("max_hold"), "quality", "bias_score")


def latest(bars: DataFrame, as_of=None, lookback: int = 120) -> DataFrame:
    """Of each symbol the last `lookback` bars up to a date, numbered from 0; none of symbols with fewer than two."""
    rows = bars if as_of is None else bars.where(F.col("ts") <= F.lit(as_of))
    back = Window.partitionBy("symbol").orderBy(F.col("bar_no").desc())
    return rows.withColumn("nth", F.row_number().over(back)).where(F.col("nth") <= lookback).drop("nth")


def walk(bars: DataFrame, as_ofs: list, ledger: DataFrame | None = None, styles: list[str] | None = None, lookback: int = 120, max_hold: int = 20) -> DataFrame:
    """The ledger after a decision on each of these dates, with every order resolved as far as the bars reach.

    A decision sees the `lookback` bars up to its date.  All dates are decided in one pass; an order that the ledger has
    already (by symbol and decision) is not written again.
    """
    dates = bars.sparkSession.createDataFrame([(x,) for x in as_ofs], "as_of date")
    last = bars.join(F.broadcast(dates), F.col("ts").cast("date") <= F.col("as_of")).groupBy("symbol", "as_of").agg(F.max("bar_no").alias("bar_no")).select("symbol", "bar_no").distinct()
    need = last.select("symbol", F.explode(F.sequence(F.greatest(F.col("bar_no") - (lookback - 1), F.lit(0).cast("long")), F.col("bar_no"))).alias("bar_no")).distinct()
    plans = decisions.signals(bars.join(need, ["symbol", "bar_no"]), styles, lookback, stride=1).join(last, ["symbol", "bar_no"])
    orders = build_orders(plans, bars, max_hold).dropDuplicates(["symbol", "decision"])
    book = orders if ledger is None else upsert(ledger.select(*LEDGER), orders.select(*LEDGER))
    return resolved(book, bars)


def resolved(book: DataFrame, bars: DataFrame) -> DataFrame:
    """The ledger's orders with status, fill, exit and R multiple; running it again changes nothing."""
    out = backtest.resolve_orders(book.select("symbol", "decision", "side", "stop", "target", "max_hold"), bars, None)
    return book.select(*LEDGER).join(out.drop("side"), ["symbol", "decision"])


def save(ledger: DataFrame, path: str) -> None:
    """One JSON object a line."""
    ledger.write.mode("overwrite").json(path)


def load(spark, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def ranking(plans: DataFrame) -> DataFrame:
    """The latest decision of each symbol, best quality first; symbols without one last."""
    back = Window.partitionBy("symbol").orderBy(F.col("bar_no").desc())
    newest = plans.withColumn("nth", F.row_number().over(back)).where("nth = 1").drop("nth")
    return newest.orderBy(F.col("quality").desc_nulls_last(), "symbol")
