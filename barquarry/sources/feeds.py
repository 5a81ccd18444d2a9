"""Feeds of bars: files, paged interfaces, a cache, and names that died.

The network is not part of the library: a feed is given the function that gets a page, so a
test or an offline cluster puts its own in its place.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barquarry.sources import bars as src
from barquarry.sources.bars import INTERVAL_DAYS, PERIOD_DAYS

DAILY = ("1d", "5d", "1wk", "1mo", "3mo")
OHLCV = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"


class FeedError(Exception):
    """A feed could not be read."""


def clamp(period: str, interval: str) -> str:
    """The period, or the largest standard one that an intraday interval's source still serves."""
    cap, own = INTERVAL_DAYS.get(interval), PERIOD_DAYS.get(period.lower())
    if cap is None or own is None or own <= cap:
        return period
    return max((p for p, d in PERIOD_DAYS.items() if d <= cap and p not in ("ytd", "max")), key=PERIOD_DAYS.get, default="1d")


def retried(get: Callable[[], object], tries: int = 4, backoff: float = 2.0, wait: Callable[[float], None] = time.sleep) -> object:
    """What get returns; after an error or an empty answer again, waiting twice as long each time, `tries` times in all."""
    last: Exception | None = None
    for k in range(tries):
        if k:
            wait(backoff * 2 ** (k - 1))
        try:
            got = get()
        except Exception as e:  # whatever the interface raises
            last = e
            continue
        if got is not None and len(got):  # type: ignore[arg-type]
            return got
        last = FeedError("empty answer")
    raise FeedError(f"no data after {tries} tries") from last


def paged(get: Callable[[int | None], list[dict]], limit: int, page: int = 100) -> list[dict]:
    """Rows with TIMESTAMP, oldest first: pages are asked for backwards, each ending before the oldest row seen.

    Ends at an empty page, at one that goes no further back, or with `limit` rows; of rows with one time the later answer stays.
    """
    if limit < 1:
        raise ValueError("limit must be at least 1")
    found: dict[int, dict] = {}
    end: int | None = None
    for _ in range(-(-limit // page) + 1):
        rows = get(end)
        if not rows:
            break
        found |= {int(r["TIMESTAMP"]): r for r in rows}
        oldest = min(int(r["TIMESTAMP"]) for r in rows)
        if (end is not None and oldest >= end) or len(found) >= limit:
            break
        end = oldest - 1
    if not found:
        raise FeedError("no rows")
    return [found[t] for t in sorted(found)[-limit:]]


def fetch_paged(spark: SparkSession, symbols: list[str], get: Callable[[str, int | None], list[dict]], limit: int = 2000) -> DataFrame:
    """Bars of several symbols by pages, each symbol in a task of its own."""
    kind = "symbol string, ts timestamp, open double, high double, low double, close double, volume double, vbuy double, vsell double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for symbol in batch["symbol"]:
                rows = pd.DataFrame(paged(lambda end, s=symbol: get(s, end), limit))
                out = rows[["OPEN", "HIGH", "LOW", "CLOSE", "VOLUME", "VOLUME_BUY", "VOLUME_SELL"]].astype(float)
                out.columns = ["open", "high", "low", "close", "volume", "vbuy", "vsell"]
                yield out.assign(symbol=symbol, ts=pd.to_datetime(rows["TIMESTAMP"].astype("int64"), unit="s", utc=True))[["symbol", "ts", "open", "high", "low", "close", "volume", "vbuy", "vsell"]]

    names = spark.createDataFrame([(s,) for s in symbols], "symbol string")
    return names.repartition(max(1, len(symbols)), "symbol").mapInPandas(run, kind)


def read_csv(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """CSV files symbol, date, open, high, low, close, adj_close, volume (with a header), back-adjusted; both dates inclusive."""
    kind = "symbol string, ts date, open double, high double, low double, close double, adj_close double, volume double"
    out = src.back_adjusted(spark.read.schema(kind).option("header", True).csv(path))
    if start is not None:
        out = out.where(F.col("ts") >= F.lit(start).cast("date"))
    return out if end is None else out.where(F.col("ts") <= F.lit(end).cast("date"))


def read_eod_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON documents {symbol, historical: [{date, open, high, low, close, volume}, ...]}, one a file; a document without rows is an error."""
    kind = "symbol string, historical array<struct<date:string,open:double,high:double,low:double,close:double,volume:double>>"
    body = spark.read.schema(kind).option("multiLine", True).json(path)
    rows = F.when(F.coalesce(F.size("historical"), F.lit(0)) > 0, F.col("historical")).otherwise(F.raise_error(F.concat(F.lit("no historical data for "), F.coalesce("symbol", F.lit("a document")))))
    return body.select("symbol", F.explode(rows).alias("r")).select("symbol", F.to_date("r.date").alias("ts"), "r.open", "r.high", "r.low", "r.close", "r.volume")


def cache_key(*parts: object) -> str:
    return hashlib.sha1("|".join(map(str, parts)).encode()).hexdigest()


def cached(spark: SparkSession, folder: str, key: str, make: Callable[[], DataFrame], ttl: float = 3600.0, refresh: bool = False, now: Callable[[], float] = time.time) -> DataFrame:
    """What make gives, kept as Parquet under the key's folder and read again until it is `ttl` seconds old."""
    path = f"{folder.rstrip('/')}/{key}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    fs = done.getFileSystem(spark._jsc.hadoopConfiguration())
    fresh = fs.exists(done) and now() - fs.getFileStatus(done).getModificationTime() / 1000 < ttl
    if refresh or not fresh:
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def fetch(spark: SparkSession, symbols: list[str], load: Callable[[str, str, str], pd.DataFrame], period: str = "6mo", interval: str = "1d", min_bars: int = 20, tries: int = 4, backoff: float = 2.0, cache: str | None = None, ttl: float = 3600.0, refresh: bool = False) -> DataFrame:
    """Normalised bars of each symbol from load(symbol, period, interval), with `status` as validate says it.

    The interval is checked, the period clamped, loads are tried again, and with a cache folder the answer is kept.
    """
    if interval not in INTERVAL_DAYS and interval not in DAILY:
        raise ValueError(f"unknown interval {interval}")
    asked = clamp(period, interval)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for symbol in batch["symbol"]:
                df = retried(lambda s=symbol: load(s, asked, interval), tries, backoff)
                out = df.rename(columns=str.lower)[["ts", "open", "high", "low", "close", "volume"]]
                yield out.assign(symbol=symbol, sequence=range(len(out)))[["symbol", "ts", "open", "high", "low", "close", "volume", "sequence"]]

    def make() -> DataFrame:
        names = spark.createDataFrame([(s,) for s in symbols], "symbol string").repartition(max(1, len(symbols)), "symbol")
        raw = names.mapInPandas(run, OHLCV + ", sequence long")
        rows = src.normalize(raw, "sequence").drop("sequence")
        return rows.join(src.validate(rows, min_bars).select("symbol", "status"), "symbol")

    return make() if cache is None else cached(spark, cache, cache_key(sorted(symbols), asked, interval), make, ttl, refresh)


def delisted(spark: SparkSession, names: int, n: int = 1259, seed: int = 0) -> DataFrame:
    """Names that died: a calm phase, then a volatile decline towards a floor, with volume on the days that fall most.

    symbol 'dead-<k>', bar_no, ts (business days), OHLCV.  Each name follows from (seed, k) alone.
    """
    kind = "symbol string, bar_no long, ts date, open double, high double, low double, close double, volume double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in batch["id"]:
                rng = np.random.default_rng([seed, int(k)])
                calm, wild = rng.uniform(0.012, 0.022), rng.uniform(0.03, 0.06)
                falls = np.arange(n) >= int(rng.uniform(0.2, 0.5) * n)
                sigma = np.where(falls, wild, calm)
                steps = rng.normal(np.where(falls, -rng.uniform(0.002, 0.005), 0.0), sigma)
                close = np.maximum(rng.uniform(40.0, 160.0) * np.exp(steps.cumsum()), 0.20)
                open_ = np.append(close[:1], close[:-1])
                high, low = close * (1 + np.abs(rng.normal(0, sigma))), close * (1 - np.abs(rng.normal(0, sigma)))
                volume = rng.uniform(2e6, 8e6) * (1 + 3 * np.maximum(0, -steps) / (wild + 1e-9))
                days = pd.bdate_range("2012-09-04", periods=n).date
                yield pd.DataFrame({"symbol": f"dead-{k}", "bar_no": np.arange(n), "ts": days, "open": open_, "high": np.maximum(high, close), "low": np.minimum(low, close), "close": close, "volume": volume})

    return spark.range(names).mapInPandas(run, kind)
