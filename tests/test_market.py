import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from barquarry.operators import backtest, indicators, labels, profile, validation
from barquarry.sources import bars as src


def frame(spark, rows, symbol="a"):
    """Rows of (open, high, low, close, volume)."""
    return spark.createDataFrame([(symbol, i, *map(float, r)) for i, r in enumerate(rows)], "symbol string, bar_no long, open double, high double, low double, close double, volume double")


def values(df, column):
    return [r[column] for r in df.orderBy("bar_no").select(column).collect()]


def test_true_range_and_wilder(spark):
    b = frame(spark, [(9.5, 10, 9, 9.5, 1), (10.5, 11, 9.5, 10.5, 1)])
    assert values(indicators.with_atr_wilder(b, 2), "tr") == [1.0, 1.5]
    assert values(indicators.with_atr_wilder(b, 2), "atr") == [None, 1.25]


def test_percentile_rank_slope_bandwidth(spark):
    b = frame(spark, [(0, 1, 0, c, 1) for c in (3, 1, 2)])
    assert values(b.withColumn("r", indicators.percentile_rank(F.col("close"), 3, 1)), "r") == [1.0, 0.5, pytest.approx(2 / 3)]
    b = frame(spark, [(0, 1, 0, c, 1) for c in range(4)])
    assert values(b.withColumn("s", indicators.slope(F.col("close"), 4)), "s")[-1] == pytest.approx(1.0)
    b = frame(spark, [(0, 1, 0, 10, 1)] * 5)
    assert values(b.withColumn("w", indicators.bandwidth(F.col("close"), 3)), "w")[-1] == 0


def test_close_location(spark):
    b = frame(spark, [(0, 10, 8, 10, 1), (0, 10, 8, 8, 1), (0, 10, 8, 9, 1), (0, 10, 10, 10, 1)])
    assert values(b.withColumn("v", indicators.close_location()), "v") == [1.0, -1.0, 0.0, 0.0]


def test_profile_conserves_volume_and_area_holds_its_share(spark):
    b = frame(spark, [(100, 101 + i % 5, 99 - i % 3, 100, 10 + i) for i in range(40)])
    e = profile.bins(b)
    h = profile.histogram(b, e)
    assert h.agg(F.sum("volume")).first()[0] == pytest.approx(sum(10 + i for i in range(40)))
    a = profile.value_area(h).first()
    assert a["val_bin"] <= a["poc_bin"] <= a["vah_bin"] and a["inside"] >= 0.7 * a["total"] - 1e-6


def test_constant_price_profile(spark):
    b = frame(spark, [(50, 50, 50, 50, 1000)] * 30)
    assert profile.histogram(b, profile.bins(b)).agg(F.sum("volume")).first()[0] == 30_000


def test_dirty_rows_and_validation(spark):
    b = frame(spark, [(1, float("nan"), 1, 1, 5), (1, 2, 1, 1, 0), (1, 1, 2, 1, 5), (1, 2, 1, 1, 5)])
    assert src.valid(b).count() == 1
    assert src.validate(b, 5).first()["status"] == "too_few_bars"
    assert src.validate(b.withColumn("volume", F.lit(0.0)), 2).first()["status"] == "no_volume"


def test_normalize_keeps_last_and_drops_nulls(spark):
    raw = spark.createDataFrame([("a", 1, "1", "2", "1", "x", "3", 0), ("a", 1, "1", "2", "1", "1.5", None, 1), ("a", 2, "1", None, "1", "1", "1", 2)], "Symbol string, Ts int, Open string, High string, Low string, Close string, Volume string, Seq int")
    out = src.normalize(raw, "seq").collect()
    assert [(r["close"], r["volume"]) for r in out] == [(1.5, 0.0)]


def test_clamped_period_is_the_longest_that_fits(spark):
    days, caps = src.PERIOD_DAYS, src.INTERVAL_DAYS
    asked = [(p, i) for p in [*days, "a year"] for i in [*caps, "1d", "3mo"]]
    got = {(r["period"], r["interval"]): r["clamped"] for r in src.clamp_periods(spark, spark.createDataFrame(asked, "period string, interval string")).collect()}
    for p, i in asked:
        if i not in caps or p not in days or days[p] <= caps[i]:
            assert got[p, i] == p
        else:
            fits = {q: n for q, n in days.items() if n <= caps[i] and q not in ("ytd", "max")}
            assert fits[got[p, i]] == max(fits.values())
    assert got["1y", "1m"] == "7d" and got["max", "1h"] == "2y"


def test_parse_crypto_keeps_last(spark):
    bar = '{"TIMESTAMP":%d,"OPEN":1,"HIGH":2,"LOW":1,"CLOSE":%s,"VOLUME":2,"VOLUME_BUY":1,"VOLUME_SELL":1}'
    body = '{"Data":[' + ",".join([bar % (300, "1.0"), bar % (200, "1.5"), bar % (300, "1.7")]) + "]}"
    out = src.parse_crypto(spark.createDataFrame([("x", body), ("y", '{"Data":[]}')], "symbol string, body string")).orderBy("ts").collect()
    assert [r["close"] for r in out] == [1.5, 1.7] and out[0]["ts"] == dt.datetime(1970, 1, 1, 0, 3, 20)


def first_touch(bars, entry, v, horizon, profit, stop, side):
    """(outcome, return, exit bar) by walking the bars one by one."""
    price = bars[entry][3]
    goal, floor = price * (1 + side * profit * v), price * (1 - side * stop * v)
    last = min(entry + horizon, len(bars) - 1)
    for j in range(entry + 1, last + 1):
        _, h, lo, _, _ = bars[j]
        if (lo <= floor) if side > 0 else (h >= floor):
            return -1, side * (floor / price - 1), j
        if (h >= goal) if side > 0 else (lo <= goal):
            return 1, side * (goal / price - 1), j
    return 0, side * (bars[last][3] / price - 1), last


def test_triple_barrier_against_a_walk(spark):
    rng = random.Random(11)
    bars, c = [], 80.0
    for _ in range(140):
        o, c = c, c * (1 + rng.gauss(0, 0.02))
        bars.append((o, max(o, c) * (1 + rng.random() * 0.02), min(o, c) * (1 - rng.random() * 0.02), c, 10))
    bets = [(i, 0.005 * (1 + i % 5), 1 if i % 2 else -1) for i in range(0, 140, 3)] + [(139, 0.01, 1)]
    asked = spark.createDataFrame([("a", i, bars[i][3], v, s) for i, v, s in bets], "symbol string, bar_no long, price double, v double, side int")
    got = {(r["bar_no"], r["side"]): r for r in labels.triple_barrier_at(frame(spark, bars), asked, 9, 1.5, 1.0).collect()}
    assert len(got) == len(set((i, s) for i, _, s in bets))
    for i, v, s in bets:
        outcome, ret, at = first_touch(bars, i, v, 9, 1.5, 1.0, s)
        r = got[i, s]
        assert (r["outcome"], r["exit"], r["holding"], r["win"]) == (outcome, at, at - i, int(ret > 0)) and r["ret"] == pytest.approx(ret, abs=1e-12)


def test_wilder_keeps_a_spike_however_long_its_memory(spark):
    bars = [(10, 11, 9, 10, 1)] * 3 + [(10, 5000, 9, 10, 1)] + [(10, 11 + i % 3, 9, 10, 1) for i in range(900)]
    for n in (1, 2, 14, 200):
        want, a = [], None
        for i, (_, h, lo, _, _) in enumerate(bars):
            tr = h - lo if not i else max(h - lo, abs(h - bars[i - 1][3]), abs(lo - bars[i - 1][3]))
            a = tr if a is None else a + (tr - a) / n
            want.append(a if i >= n - 1 else None)
        got = values(indicators.with_atr_wilder(frame(spark, bars), n), "atr")
        assert [x is None for x in got] == [x is None for x in want]
        assert max(abs(x - y) / y for x, y in zip(got, want) if y is not None) < 1e-11


def test_an_order_without_a_later_bar_stays_open(spark):
    b = frame(spark, [(100, 101, 99, 100, 1)] * 3)
    orders = spark.createDataFrame([("a", 2, 1, 90.0, 110.0), ("a", 1, -1, 110.0, 90.0)], "symbol string, decision long, side int, stop double, target double")
    got = {r["decision"]: r for r in backtest.resolve_orders(orders, b, 5).collect()}
    assert {k: r["status"] for k, r in got.items()} == {1: "open", 2: "open"} and got[2]["fill"] is None and got[1]["fill"] == 100


def test_runs(spark):
    b = frame(spark, [(0, 1, 0, 1, 1)] * 10).withColumn("f", F.col("bar_no").isin(0, 1, 2, 5, 6, 9))
    assert sorted((r["start"], r["end"]) for r in indicators.runs(b, "f").collect()) == [(0, 2), (5, 6), (9, 9)]


def test_splits(spark):
    rows = spark.createDataFrame([("a", i) for i in range(60)], "symbol string, row_no long")
    m = validation.cpcv(rows, purge=3, embargo=0.1).collect()
    assert len({r["split"] for r in m}) == 15 and len(m) == 900
    for split in range(15):
        own = {r["row_no"]: r["role"] for r in m if r["split"] == split}
        test = {k for k, v in own.items() if v == "test"}
        assert len(test) == 20
        for a in test:
            if a - 1 not in test:
                assert all(own[k] != "train" for k in range(max(0, a - 3), a))
            if a + 1 not in test:
                assert all(own[k] != "train" for k in range(a + 1, min(60, a + 7)))


def test_factor_samples_take_every_bar_on_request(spark):
    closes = [10.0 + i * i % 7 for i in range(60)]
    b = frame(spark, [(x, x, x, x, 1) for x in closes])
    for stride in (1, 3, 5):
        got = sorted(tuple(r) for r in labels.factor_samples(b, stride=stride).select("row_no", "x", "y").collect())
        at = range(20, 40, stride)
        assert got == [(k, pytest.approx(closes[i] / closes[i - 20] - 1), pytest.approx(closes[i + 20] / closes[i] - 1)) for k, i in enumerate(at)]


def test_auc_against_pairs(spark):
    pts = [("g", 0.1, 0), ("g", 0.4, 1), ("g", 0.4, 0), ("g", 0.9, 1), ("g", 0.2, 1)]
    want = sum((p > n) + 0.5 * (p == n) for _, p, y in pts if y for _, n, z in pts if not z) / 6
    assert validation.auc(spark.createDataFrame(pts, "g string, s double, y int"), "g", "s", "y").first()["auc"] == pytest.approx(want)


def test_paper_orders(spark):
    b = frame(spark, [(100, 101, 99, 100, 1), (100, 105, 95, 102, 1), (102, 111, 101, 110, 1)])
    order = lambda stop, target: spark.createDataFrame([("a", 0, 1, float(stop), float(target))], "symbol string, decision long, side int, stop double, target double")
    got = [backtest.resolve_orders(order(*x), b, hold).first() for x, hold in (((90, 110), 5), ((96, 110), 5), ((90, 120), 2), ((90, 120), 5), ((95, 105), 5))]
    assert [r["status"] for r in got] == ["win", "loss", "timeout", "open", "loss"]
    assert got[0]["fill"] == 100 and got[0]["held"] == 2 and got[0]["r_multiple"] == 1.0


def test_symbols_do_not_mix(spark):
    one, two = [(1, 2, 1, 1 + i % 3, 5) for i in range(20)], [(9, 12, 7, 9 + i % 2, 50) for i in range(25)]
    a, b = frame(spark, one, "a"), frame(spark, two, "b")
    both = indicators.with_atr_sma(a.unionByName(b).repartition(3))
    assert values(both.where("symbol = 'a'"), "atr_sma") == values(indicators.with_atr_sma(a), "atr_sma")


def test_stream_equals_batch_on_closed_bars(spark, tmp_path):
    from barquarry.streaming.bars import run_once, stream_event_bars

    root = "/root/testdata/sf0.001"
    run_once(stream_event_bars(spark, root, "events.parquet"), str(tmp_path / "out"), str(tmp_path / "at"))
    stream = spark.read.parquet(str(tmp_path / "out"))
    batch = src.event_bars(spark.read.parquet(f"{root}/events.parquet"))
    assert stream.count() > 0.9 * batch.count() and stream.exceptAll(batch.select(stream.columns)).count() == 0


@pytest.mark.parametrize("seed", [1, 3])
def test_quiet_frame_ranks_ties_as_its_sql_does(spark, tmp_path, seed):
    duckdb = pytest.importorskip("duckdb")
    from barquarry.plans import queries

    rng = random.Random(seed)  # steps of a few cents: a close often equals the one 20 bars before, so that frames tie
    rows = [(k, dt.datetime(1992, 1, 1) + dt.timedelta(days=i), float(rng.randint(1, 4)), float(52950 + rng.randint(-6, 6)), "A") for k in (1, 2) for i in range(400)]
    spark.createDataFrame(rows, "l_linenumber int, l_shipdate timestamp_ntz, l_quantity double, l_extendedprice double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    got = queries.QUERIES["r01_quiet_frame"](spark, str(tmp_path)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, con.execute(queries.ORACLES["r01_quiet_frame"]).fetchall()))


def test_folds_in_blocks_miss_no_row(spark):
    rng = random.Random(2)
    closes = [100 + rng.random() for _ in range(90)]
    b = frame(spark, [(0, 1, 0, c, 1) for c in closes]).where("bar_no >= 7 and bar_no % 11 <> 3").withColumn("close", F.expr("if(bar_no = 40, null, close)"))
    for n in (3, 20, 50):
        plain = 4 * F.stddev_pop("close").over(indicators.last(n)) / F.avg("close").over(indicators.last(n))
        out = b.withColumns({"w": indicators.bandwidth(F.col("close"), n, least=2), "plain": indicators.enough(F.col("close"), plain, n, 2)})
        out = out.withColumns({"f": indicators.falling(F.col("close"), n), "s": indicators.slope(F.col("close"), n) < 0})
        assert values(out, "w") == pytest.approx(values(out, "plain")) and values(out, "f") == values(out, "s")
