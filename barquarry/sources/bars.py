"""Bar tables: one long frame keyed by symbol and ordered by bar_no."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BAR_SCHEMA = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"


def daily_bars(trades: DataFrame, symbol: str = "l_linenumber") -> DataFrame:
    """Daily OHLCV of a cumulative price walk over trades, in exact integer cents; vbuy and vsell by return flag."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    size = F.col("l_quantity").cast("long")
    flag = F.col("l_returnflag")
    day = trades.groupBy(F.col(symbol).alias("symbol"), F.to_date("l_shipdate").alias("ts")).agg(
        F.sum(cents).alias("cents"),
        F.count(F.lit(1)).alias("n"),
        F.sum(size).alias("qty"),
        F.sum(F.when(flag == "A", size).otherwise(0)).alias("buy"),
        F.sum(F.when(flag == "R", size).otherwise(0)).alias("sell"),
    )
    by = Window.partitionBy("symbol").orderBy("ts")
    day = day.withColumn("close_c", 10_000_000 + F.sum(F.expr("(cents div n) div 100 - 52950")).over(by))
    day = day.withColumn("open_c", F.lag("close_c", 1, 10_000_000).over(by)).withColumn("half", F.expr("50 * (qty div n)"))
    return day.select(
        "symbol",
        "ts",
        (F.row_number().over(by) - 1).cast("long").alias("bar_no"),
        (F.col("open_c") / 100.0).alias("open"),
        ((F.greatest("open_c", "close_c") + F.col("half")) / 100.0).alias("high"),
        ((F.least("open_c", "close_c") - F.col("half")) / 100.0).alias("low"),
        (F.col("close_c") / 100.0).alias("close"),
        F.col("qty").cast("double").alias("volume"),
        F.col("buy").cast("double").alias("vbuy"),
        F.col("sell").cast("double").alias("vsell"),
    )


def number_bars(raw: DataFrame) -> DataFrame:
    """bar_no from 0 in time order of each symbol."""
    by = Window.partitionBy("symbol").orderBy("ts")
    return raw.withColumn("bar_no", (F.row_number().over(by) - 1).cast("long"))


def event_bars(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """Hourly OHLCV of events: price is value, volume is props.k + 1. Works on batch and stream alike."""
    size = F.get_json_object("props", "$.k").cast("double") + 1
    at = events.select(F.col("ts").cast("timestamp").alias("t"), F.col("event_type").alias("symbol"), "value", size.alias("size"))
    if events.isStreaming:
        at = at.withWatermark("t", width)
    return at.groupBy(F.window("t", width).alias("w"), "symbol").agg(
        F.min_by("value", "t").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "t").alias("close"), F.sum("size").alias("volume"), F.count(F.lit(1)).alias("n_events")
    ).select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume", "n_events")


def normalize(raw: DataFrame, sequence: str) -> DataFrame:
    """Numeric columns by force, the last of rows that repeat (symbol, ts) by sequence, rows without H, L or C dropped, volume 0 for none."""
    out = raw.toDF(*[c.lower().replace(" ", "_") for c in raw.columns])
    for c in ("open", "high", "low", "close", "volume"):
        x = F.expr(f"try_cast({c} as double)")
        out = out.withColumn(c, F.when(~F.isnan(x), x))
    newest = Window.partitionBy("symbol", "ts").orderBy(F.col(sequence).desc())
    out = out.withColumn("_nth", F.row_number().over(newest)).where("_nth = 1").drop("_nth")
    return out.na.drop(subset=["high", "low", "close"]).withColumn("volume", F.coalesce("volume", F.lit(0.0)))


def validate(bars: DataFrame, min_bars: int = 20) -> DataFrame:
    """One row per symbol: n_bars, total_volume and status (ok, too_few_bars, no_volume)."""
    by = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_bars"), F.sum("volume").alias("total_volume"))
    status = F.when(F.col("n_bars") < min_bars, "too_few_bars").when(F.coalesce("total_volume", F.lit(0.0)) <= 0, "no_volume").otherwise("ok")
    return by.withColumn("status", status)


def valid(bars: DataFrame) -> DataFrame:
    """Bars with finite H, L, C, V, volume above 0 and high not below low."""
    finite = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf")) for c in ("high", "low", "close", "volume")]
    keep: Column = (F.col("volume") > 0) & (F.col("high") >= F.col("low"))
    for x in finite:
        keep = keep & x
    return bars.where(keep)


def back_adjusted(raw: DataFrame) -> DataFrame:
    """Prices scaled by adj_close / close (1 where that is no finite number); close becomes adj_close."""
    f = F.try_divide("adj_close", "close")
    f = F.when(f.isNotNull() & ~F.isnan(f) & (F.abs(f) < float("inf")), f).otherwise(1.0)
    return raw.withColumns({c: F.col(c) * f for c in ("open", "high", "low")} | {"close": F.col("adj_close")}).drop("adj_close")


def parse_crypto(payload: DataFrame) -> DataFrame:
    """JSON payloads (symbol, body) with unix seconds to typed bars; of a repeated timestamp the last in the body stays."""
    kind = "struct<Data:array<struct<TIMESTAMP:bigint,OPEN:double,HIGH:double,LOW:double,CLOSE:double,VOLUME:double,VOLUME_BUY:double,VOLUME_SELL:double>>>"
    rows = payload.select("symbol", F.posexplode(F.from_json("body", kind)["Data"]).alias("at", "x"))
    newest = Window.partitionBy("symbol", "x.TIMESTAMP").orderBy(F.col("at").desc())
    rows = rows.withColumn("nth", F.row_number().over(newest)).where("nth = 1")
    names = {"OPEN": "open", "HIGH": "high", "LOW": "low", "CLOSE": "close", "VOLUME": "volume", "VOLUME_BUY": "vbuy", "VOLUME_SELL": "vsell"}
    return rows.select("symbol", F.timestamp_seconds("x.TIMESTAMP").alias("ts"), *[F.col("x")[k].alias(v) for k, v in names.items()])


#: The longest history, in days, of an intraday interval, and the days of a period.
INTERVAL_DAYS = {"1m": 7, "2m": 60, "5m": 60, "15m": 60, "30m": 60, "60m": 730, "90m": 60, "1h": 730}
PERIOD_DAYS = {"1d": 1, "5d": 5, "7d": 7, "1mo": 31, "3mo": 93, "6mo": 186, "1y": 366, "2y": 730, "5y": 1827, "10y": 3653, "ytd": 366, "max": 1_000_000}


def clamp_periods(spark: SparkSession, wanted: DataFrame) -> DataFrame:
    """(period, interval) with the largest standard period (not ytd or max) that the interval's source still serves.

    Daily and longer intervals, and periods that are not known, pass unchanged.
    """
    caps = spark.createDataFrame(list(INTERVAL_DAYS.items()), "interval string, cap int")
    days = spark.createDataFrame(list(PERIOD_DAYS.items()), "name string, days int")
    own = wanted.withColumn("name", F.lower("period")).join(F.broadcast(caps), "interval", "left").join(F.broadcast(days.withColumnRenamed("days", "own")), "name", "left")
    fit = caps.join(F.broadcast(days), (F.col("days") <= F.col("cap")) & ~F.col("name").isin("ytd", "max")).groupBy("interval").agg(F.max_by("name", "days").alias("largest"))
    over = F.coalesce(F.col("own") > F.col("cap"), F.lit(False))
    return own.join(F.broadcast(fit), "interval", "left").select("period", "interval", F.when(over, F.coalesce("largest", F.lit("1d"))).otherwise(F.col("period")).alias("clamped"))
