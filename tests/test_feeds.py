import json

import numpy as np
import pandas as pd
import pytest

from barquarry.sources import feeds


def row(t, c=1.0):
    return {"TIMESTAMP": t, "OPEN": c, "HIGH": c + 1, "LOW": c - 0.5, "CLOSE": c, "VOLUME": 2.0, "VOLUME_BUY": 1.0, "VOLUME_SELL": 1.0}


class Pages:
    """An interface with rows 0, 10, 20, ... that gives three rows ending at a time."""

    def __init__(self, n):
        self.times, self.asked = [10 * i for i in range(n)], []

    def __call__(self, end):
        self.asked.append(end)
        return [row(t) for t in self.times if end is None or t <= end][-3:]


def test_pages_are_followed_back_until_there_are_enough():
    get = Pages(20)
    got = feeds.paged(get, 7, 3)
    assert [r["TIMESTAMP"] for r in got] == [130, 140, 150, 160, 170, 180, 190] and get.asked == [None, 169, 139]
    few = Pages(4)
    assert [r["TIMESTAMP"] for r in feeds.paged(few, 100, 3)] == [0, 10, 20, 30]
    stuck = lambda end: [row(50)]
    assert len(feeds.paged(stuck, 10, 3)) == 1
    with pytest.raises(feeds.FeedError):
        feeds.paged(lambda end: [], 5)
    with pytest.raises(ValueError):
        feeds.paged(stuck, 0)


def test_retries_wait_twice_as_long_each_time():
    answers, waits = [ValueError("no"), [], [1]], []

    def get():
        x = answers.pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    assert feeds.retried(get, 4, 2.0, waits.append) == [1] and waits == [2.0, 4.0]
    with pytest.raises(feeds.FeedError):
        feeds.retried(lambda: [], 2, 0.0, waits.append)


def test_fetch_normalises_checks_and_caches(spark, tmp_path):
    def load(symbol, period, interval):
        n = 30 if symbol == "a" else 5
        return pd.DataFrame({"Ts": pd.date_range("2024-01-01", periods=n), "Open": 1.0, "High": 2.0, "Low": 0.5, "Close": [float(len(period))] * n, "Volume": 3.0})

    got = feeds.fetch(spark, ["a", "b"], load, "1y", "1m", backoff=0.0, cache=str(tmp_path))
    assert {r["symbol"]: r["status"] for r in got.select("symbol", "status").distinct().collect()} == {"a": "ok", "b": "too_few_bars"}
    assert got.first()["close"] == 2.0 and got.count() == 35  # the period was clamped to 7d

    def other(symbol, period, interval):
        raise RuntimeError("not asked again")

    assert feeds.fetch(spark, ["b", "a"], other, "1y", "1m", backoff=0.0, cache=str(tmp_path)).count() == 35
    with pytest.raises(ValueError):
        feeds.fetch(spark, ["a"], load, "1y", "7m")


def test_paged_bars_of_several_symbols(spark):
    pages = {x: [row(100, c), row(200, c)] for x, c in (("x", 5.0), ("y", 6.0))}
    got = feeds.fetch_paged(spark, ["x", "y"], lambda symbol, end: pages[symbol] if end is None else [], 10)
    assert sorted((r["symbol"], r["close"]) for r in got.collect()) == [("x", 5.0), ("x", 5.0), ("y", 6.0), ("y", 6.0)]


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("symbol,date,open,high,low,close,adj_close,volume\na,2020-01-02,10,12,8,10,5,7\na,2020-01-03,10,12,8,0,6,7\na,2020-02-03,10,12,8,10,10,7\n")
    got = feeds.read_csv(spark, str(tmp_path / "a.csv"), "2020-01-01", "2020-01-31").orderBy("ts").collect()
    assert [(r["open"], r["high"], r["close"]) for r in got] == [(5.0, 6.0, 5.0), (10.0, 12.0, 6.0)]
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.json").write_text(json.dumps({"symbol": "a", "historical": [{"date": "2020-01-02", "open": 1, "high": 2, "low": 1, "close": 2, "volume": 3}] * 2}))
    assert feeds.read_eod_json(spark, str(tmp_path / "j")).count() == 2
    (tmp_path / "j" / "b.json").write_text(json.dumps({"symbol": "b", "historical": []}))
    with pytest.raises(Exception, match="no historical data for b"):
        feeds.read_eod_json(spark, str(tmp_path / "j")).collect()


def test_names_that_died_follow_from_their_seed(spark):
    a, b = (feeds.delisted(spark, 3, 1259, seed=4).toPandas().sort_values(["symbol", "bar_no"], ignore_index=True) for _ in range(2))
    pd.testing.assert_frame_equal(a, b)
    assert (a["low"] <= a["close"]).all() and (a["high"] >= a["close"]).all() and a["close"].min() >= 0.2 and (a["volume"] > 0).all()
    ends = a.groupby("symbol")["close"].agg(["first", "last"])
    assert len(ends) == 3 and (ends["last"] < 0.5 * ends["first"]).all()
