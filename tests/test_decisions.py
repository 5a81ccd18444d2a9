"""Kernels against plain loops, decisions against kernels over the whole history, datasets without look-ahead."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barquarry.config import ConfluenceConfig, PatternConfig, ProfileConfig, QuietConfig, SignalConfig, SplitConfig
from barquarry.operators import decisions, evaluation, folds, kernels, paper, sinks


def history(n=400, seed=1, drift=0.0):
    """Bars with calm and wild stretches."""
    rng = np.random.default_rng(seed)
    wild = np.where((np.arange(n) // 60) % 2, 0.02, 0.004)
    close = 100 * np.exp(np.cumsum(rng.normal(drift, wild)))
    open_ = np.append(close[:1], close[:-1])
    high, low = np.maximum(open_, close) * (1 + rng.random(n) * wild), np.minimum(open_, close) * (1 - rng.random(n) * wild)
    volume = np.round(1000 * (1 + 3 * rng.random(n)) * np.where((np.arange(n) // 60) % 2, 2, 0.6))
    volume[::37] *= 6
    return pd.DataFrame({"open": open_, "high": high, "low": low, "close": close, "volume": volume})


def bars(spark, *frames):
    rows = [(f"s{k}", i, pd.Timestamp("2020-01-01").date() + pd.Timedelta(days=i), *map(float, r)) for k, f in enumerate(frames) for i, r in enumerate(f.itertuples(index=False))]
    return spark.createDataFrame(rows, "symbol string, bar_no long, ts date, open double, high double, low double, close double, volume double")


def columns(f):
    return tuple(f[c].to_numpy() for c in ("high", "low", "close", "volume"))


def test_profile_against_a_loop():
    for seed in range(6):
        f = history(90, seed)
        f.loc[3, ["high", "low"]] = f.loc[3, "close"]  # a bar of no height
        h, lo, c, v = columns(f)
        p = kernels.profile(h, lo, c, v)
        edges = np.linspace(lo.min(), h.max(), len(p.hist) + 1)
        want = np.zeros(len(p.hist))
        for a, b, w in zip(lo, h, v):
            if a == b:
                want[min(len(want) - 1, int((a - edges[0]) / (edges[1] - edges[0])))] += w
            else:
                want += [w * max(0, min(b, edges[k + 1]) - max(a, edges[k])) / (b - a) for k in range(len(want))]
        assert np.allclose(p.hist, want) and p.hist.sum() == pytest.approx(v.sum())
        assert p.poc_bin == int(want.argmax()) and p.hvn[0] == (pytest.approx(p.poc), pytest.approx(p.hist.max()))
        inside = p.hist[p.val_bin : p.vah_bin + 1].sum()
        assert inside >= 0.7 * p.hist.sum() and p.val_bin <= p.poc_bin <= p.vah_bin
        tr = [h[i] - lo[i] if not i else max(h[i] - lo[i], abs(h[i] - c[i - 1]), abs(lo[i] - c[i - 1])) for i in range(len(h))]
        assert len(p.hist) == max(20, min(500, round((h.max() - lo.min()) / (0.25 * np.mean(tr[-14:])))))
    assert kernels.profile(*(np.array([]) for _ in range(4))) is None


def test_peaks_against_their_definition():
    rng = np.random.default_rng(4)
    for _ in range(200):
        x = rng.integers(0, 6, 25).astype(float)
        want, i = [], 1
        while i < len(x) - 1:
            j = i
            while j < len(x) - 1 and x[j + 1] == x[i]:
                j += 1
            if x[i - 1] < x[i] and j < len(x) - 1 and x[j + 1] < x[i]:
                at = (i + j) // 2
                a, z = at, at
                while a > 0 and x[a - 1] <= x[at]:
                    a -= 1
                while z < len(x) - 1 and x[z + 1] <= x[at]:
                    z += 1
                if x[at] - max(x[a : at + 1].min(), x[at : z + 1].min()) >= 2:
                    want.append(at)
            i = j + 1
        assert kernels.peaks(x, 2) == want


def test_windows_against_pandas():
    f = history(200, 7)
    o = f["open"].to_numpy()
    h, lo, c, v = columns(f)
    ends = np.array([119, 150, 199])
    w = kernels.Windows(o, h, lo, c, v, ends, 120)
    quiet = w.quiet()
    for i, end in enumerate(ends):
        g = f.iloc[end - 119 : end + 1].reset_index(drop=True)
        before = g["close"].shift()
        tr = pd.concat([g["high"] - g["low"], (g["high"] - before).abs(), (g["low"] - before).abs()], axis=1).max(axis=1)
        atr = tr.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
        mean = g["volume"].rolling(20, min_periods=10).mean()
        band = 4 * g["close"].rolling(20, min_periods=10).std(ddof=0) / g["close"].rolling(20, min_periods=10).mean()
        assert np.allclose(w.atr[i], atr, equal_nan=True) and np.allclose(w.volume_mean[i], mean, equal_nan=True)
        share = [float((s.tail(100) <= s.iloc[-1]).mean()) for s in (atr, mean, band)]
        assert np.allclose(quiet["ranks"][i], share) and quiet["score"][i] == pytest.approx(100 * np.mean([1 - x for x in share]))
        assert bool(quiet["falling"][i]) == bool(np.polyfit(range(20), mean.tail(20), 1)[0] < 0)
        flags = mean / g["volume"].rolling(60, min_periods=30).mean() <= 0.5
        runs = [(int(x.index[0]), int(x.index[-1])) for _, x in flags[flags].groupby((~flags).cumsum()) if len(x) >= 3]
        assert [(e["start"], e["end"]) for e in w.events(None)[i] if e["kind"] == "dry_up"] == runs


def test_decisions_do_not_depend_on_blocks_or_on_later_bars(spark):
    one, two = history(300, 3), history(260, 4)
    both = bars(spark, one, two)
    pick = lambda df: {(r["symbol"], r["bar_no"]): r for r in df.drop("rationale").collect()}
    whole = pick(decisions.decisions(both, stride=7))
    assert len(whole) == len(range(119, 300, 7)) + len(range(119, 260, 7))
    assert pick(decisions.decisions(both.repartition(5), stride=7, size=32)) == whole
    early = pick(decisions.decisions(both.where("bar_no <= 200"), stride=7))
    assert early == {k: r for k, r in whole.items() if k[1] <= 200}
    r = whole["s0", 119]
    h, lo, c, v = (x[:120] for x in columns(one))
    p = kernels.profile(h, lo, c, v)
    assert (r["poc"], r["vah"], r["val"], r["n_bins"]) == (p.poc, p.vah, p.val, len(p.hist)) and r["price"] == c[-1]
    quality = (r["s_value"] + r["s_level"] + 1.5 * r["s_quiet"] + 1.5 * r["s_patterns"]) / 5 * 100
    lean = (r["s_value"] * r["d_value"] + r["s_level"] * r["d_level"] + 1.5 * r["s_patterns"] * r["d_patterns"]) / 5 * 100
    assert r["quality"] == pytest.approx(quality, abs=0.0051) and r["bias_score"] == pytest.approx(lean, abs=0.0051)
    assert r["bias"] == ("bullish" if lean > 10 else "bearish" if lean < -10 else "neutral")


def test_nothing_comes_of_nothing(spark):
    none = bars(spark, history(5)).where("false")
    assert decisions.decisions(none).count() == 0 and decisions.signals(bars(spark, history(60))).count() == 0
    flat = history(130)
    flat[["open", "high", "low", "close"]] = 50.0
    assert decisions.decisions(bars(spark, flat)).count() == 11
    flat["volume"] = 0.0
    assert decisions.decisions(bars(spark, flat)).count() == 0


def test_plan_stands_in_the_right_order():
    rng = np.random.default_rng(8)
    for seed in range(40):
        f = history(120, seed)
        p = kernels.profile(*columns(f))
        for side in (1, -1):
            for style in ("reversion", "breakout"):
                price = float(rng.uniform(p.low, p.high))
                entry, stop, targets = kernels.plan(side, price, p, 1.0, style)
                assert side * (entry - stop) > 0 and targets and len(targets) <= 2 and all(side * (t - entry) > 0 for t in targets) and targets == sorted(targets, key=lambda t: side * t)
                if style == "reversion":
                    assert entry == price


def test_gate_gives_the_first_reason():
    p = kernels.profile(*columns(history(120)))
    say = lambda quality, lean, bias, quiet=50.0, **k: kernels.signal(100.0, 1.0, p, quality, lean, bias, "why.", quiet, **k)["reason"]
    assert say(90, 5, "neutral") == "no directional bias"
    assert say(40, 30, "bullish").startswith("setup quality 40 below")
    assert say(60, 12, "bullish").startswith("directional conviction 12 below")
    assert say(60, 30, "bullish", least_quiet=60.0).startswith("not a quiet phase")
    assert "budget" in say(60, 30, "bullish", least_rr=0.01, budget=1e-9)


def test_nearest_level_prefers_the_more_important_of_equals():
    p = kernels.Profile(0.0, 10.0, 1.0, np.arange(11.0), np.ones(11), 5, 3, 7, [(5.0, 1.0)], [(9.0, 1.0)], 10)
    assert kernels.nearest_level(6.0, p, 1.5) == "POC 5.00" and kernels.nearest_level(8.6, p, 0.5) == "LVN 9.00"
    assert kernels.nearest_level(4.0, p, 1.0) is None and kernels.nearest_level(5.0, p, math.nan) is None


def test_mixtures_together_equal_mixtures_one_by_one():
    found = [kernels.profile(*columns(history(120, s))) for s in range(12)]
    for k in (1, 2, 3):
        for p, m in zip(found, kernels.mixtures(found, k)):
            one = kernels.mixture((p.centers - p.low) / (p.high - p.low), p.hist, k, max((1 / (2 * len(p.hist))) ** 2, 1e-6), float(p.n_bars))
            assert np.allclose(m.mean, one.mean, atol=1e-6) and np.allclose(m.sd, one.sd, atol=1e-6) and m.bic == pytest.approx(one.bic, abs=1e-5)
    x = np.linspace(0, 1, 201)
    two = kernels.mixture(x, np.exp(-0.5 * ((x - 0.3) / 0.05) ** 2) + 3 * np.exp(-0.5 * ((x - 0.7) / 0.05) ** 2), 2, n=100.0)
    assert np.allclose(two.mean, [0.3, 0.7], atol=0.01) and np.allclose(two.share, [0.25, 0.75], atol=0.01)
    assert len(kernels.mixture(np.arange(5.0), np.array([0, 0, 1.0, 0, 0]), 2).mean) == 1


def test_structural_walk_looks_back_only(spark):
    f = history(420, 9)
    b = bars(spark, f)
    rows = {r["bar_no"]: r for r in decisions.structural_walk(b).collect()}
    assert min(rows) == 119 + 3 * 20
    early = {r["bar_no"]: r for r in decisions.structural_walk(b.where("bar_no < 300")).collect()}
    assert early == {k: r for k, r in rows.items() if k < 300}
    at = sorted(rows)[10]
    ends = list(range(119, at + 1, 3))
    h, lo, c, v = columns(f)
    own = [kernels.profile(*(x[e - 119 : e + 1] for x in (h, lo, c, v))) for e in ends]
    width = [(p.vah - p.val) / c[e] for p, e in zip(own, ends)]
    assert rows[at]["vacr_z"] == pytest.approx((width[-1] - np.mean(width[-21:-1])) / np.std(width[-21:-1]))
    assert rows[at]["poc_slope"] == pytest.approx(np.polyfit(range(5), [p.poc for p in own[-5:]], 1)[0] / c[at], abs=1e-9)
    y = {r["bar_no"]: r["y"] for r in decisions.structural_dataset(b, decisions.structural_walk(b)).collect()}
    assert max(y) < 400 and y[at] == pytest.approx(c[at + 20] / c[at] - 1)


def naive_fold(f, orders, account, first):
    """The same walk, written as a list of events."""
    cash, position, pending, done, curve = account.equity, None, None, [], []
    for i in range(first, len(f)):
        o, h, lo, c = (float(f[x].iloc[i]) for x in ("open", "high", "low", "close"))
        if position is None and pending:
            side, stop, target, _ = pending
            entry = o * (1 + side * 5 / 1e4)
            units = min(cash * 0.01 // abs(entry - stop), cash // entry) if side * (entry - stop) > 0 else 0
            position = [side, stop, target, entry, units, i] if units > 0 else None
            pending = None
        if position:
            side, stop, target, entry, units, since = position
            level = None
            for price, when in ((o, i > since and side * (o - stop) <= 0), (o, i > since and side * (o - target) >= 0), (stop, (lo <= stop) if side > 0 else (h >= stop)), (target, (h >= target) if side > 0 else (lo <= target))):
                if when and level is None:
                    level = price
            if level is not None:
                out = level * (1 - side * 5 / 1e4)
                cash += side * (out - entry) * units
                done.append((side, since, i, entry, out, units))
                position = None
        if position is None and pending is None and i in orders and cash * 0.01 >= orders[i][3]:
            pending = orders[i]
        curve.append(cash + (position[0] * (c - position[3]) * position[4] if position else 0))
    if position:
        side, stop, target, entry, units, since = position
        cash += side * (float(f["close"].iloc[-1]) - entry) * units
        done.append((side, since, len(f) - 1, entry, float(f["close"].iloc[-1]), units))
        curve[-1] = cash
    return done, curve


def test_fold_against_a_loop_and_its_figures(spark):
    account = folds.Account(equity=100_000.0)
    frames = [history(330, 21, 0.001), history(150, 22), history(121, 23)]
    b, rng, orders = bars(spark, *frames), np.random.default_rng(3), {}
    rows = []
    for k, f in enumerate(frames):
        for i in range(119, len(f), 4):
            side, c = int(rng.choice([1, -1])), float(f["close"].iloc[i])
            own = (side, c * (1 - side * 0.01), c * (1 + side * 0.02), c * 0.01)
            orders.setdefault(k, {})[i] = own
            rows.append((f"s{k}", i, "LONG", side, own[1], [own[2], own[2] + side], own[3]))
    plans = spark.createDataFrame(rows, "symbol string, bar_no long, action string, side int, stop double, targets array<double>, risk double")
    found = folds.backtest(folds.history(b), plans, account=account).cache()
    figures = {r["symbol"]: r for r in folds.results(found, account).collect()}
    assert set(figures) == {"s0", "s1"}  # the third has too few bars
    for k in (0, 1):
        done, curve = naive_fold(frames[k], orders[k], account, 119)
        got = folds.trades(found).where(F.col("symbol") == f"s{k}").orderBy("entry_bar").collect()
        assert [(r["side"], r["entry_bar"], r["exit_bar"], r["size"]) for r in got] == [(s, a, z, u) for s, a, z, _, _, u in done]
        assert np.allclose([(r["entry_price"], r["exit_price"]) for r in got], [(e, x) for *_, e, x, _ in done])
        eq = [r["equity"] for r in folds.curves(found).where(F.col("symbol") == f"s{k}").orderBy("bar_no").collect()]
        assert np.allclose(eq, curve)
        pnl = np.array([s * (x - e) * u for s, _, _, e, x, u in done])
        r = figures[f"s{k}"]
        ret = np.diff(curve) / curve[:-1]
        assert r["n_trades"] == len(done) and r["expectancy"] == pytest.approx(pnl.mean()) and r["win_rate"] == pytest.approx((pnl > 0).mean())
        assert r["total_return_pct"] == pytest.approx(pnl.sum() / 1000) and r["sharpe"] == pytest.approx(ret.mean() / ret.std(ddof=1) * math.sqrt(252))
        assert r["max_drawdown_pct"] == pytest.approx((np.array(curve) / np.maximum.accumulate(curve) - 1).min() * 100)
    found.unpersist()


def test_paths_take_every_pair_of_groups_with_a_history(spark):
    f = history(600, 31)
    slices = folds.group_slices(bars(spark, f))
    by = {r["grp"]: (r["a"], r["z"]) for r in slices.groupBy("grp").agg(F.min("bar_no").alias("a"), F.max("bar_no").alias("z")).collect()}
    assert by == {g: (100 * g - 1, 100 * g + 99) for g in range(2, 6)}  # groups 0 and 1 begin within the first 120 bars
    groups = spark.createDataFrame([("s", g, float(g), g / 10) for g in by], "symbol string, grp int, total_return_pct double, sharpe double")
    got = folds.paths(groups)
    assert got.count() == 6
    r = folds.path_summary(got).first()
    assert r["return_mean"] == pytest.approx(3.5) and r["return_min"] == 2.5 and r["pct_profitable"] == 100


def test_paper_walk_is_idempotent(spark):
    b = bars(spark, history(300, 41), history(300, 42))
    days = [r["ts"] for r in b.where("symbol = 's0' and bar_no in (150, 200, 250)").orderBy("ts").collect()]
    gate_free = decisions.signals(b, stride=1, least_quality=0.0, least_bias=0.0, least_rr=0.0, budget=1e9)
    last = gate_free.where("bar_no in (150, 200, 250)")
    orders = paper.build_orders(last, b)
    book = paper.resolved(orders, b)
    assert book.count() == orders.count() > 0
    assert sorted(paper.resolved(book, b).collect()) == sorted(book.collect())
    once = paper.walk(b, days)
    again = paper.walk(b, days, once)
    assert sorted(map(str, again.collect())) == sorted(map(str, once.collect()))


def test_joint_ridge_against_numpy():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 4))
    y = x @ [1, 0, -1, 0.5] + rng.normal(size=90)
    ics = evaluation.ridge_ics(x, np.stack([y, y[::-1]], 1), 4)
    k = 0
    for train, test in evaluation.splits(90, purge=4):
        assert not set(train) & set(test) and all(t not in train for a in test for t in range(a - 4, a))
        m, s = x[train].mean(0), x[train].std(0)
        a, b = (x[train] - m) / s, (x[test] - m) / s
        w = np.linalg.solve(a.T @ a + np.eye(4), a.T @ (y[train] - y[train].mean()))
        assert ics[k, 0] == pytest.approx(np.corrcoef(b @ w, y[test])[0, 1])
        k += 1
    assert k == 15 and ics[:, 0].mean() > 0.6 > abs(ics[:, 1].mean())


def test_meta_rater_finds_a_signal_and_no_noise(spark):
    rng = np.random.default_rng(6)
    n = 240
    x = rng.normal(size=(n, 2))
    win = (rng.random(n) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(int)
    ret = np.where(win, 0.02, -0.02)
    rows = [("a", i, float(x[i, 0]), float(x[i, 1]), int(win[i]), float(ret[i])) for i in range(n)] + [("b", i, float(x[i, 1]), float(x[i, 1]), int(win[i]), float(ret[i])) for i in range(n)]
    data = spark.createDataFrame(rows, "symbol string, bar_no long, f double, g double, win int, ret double")
    got = {r["symbol"]: r for r in evaluation.meta_summary(evaluation.meta_eval(data, ["f", "g"], 2), ["symbol"]).collect()}
    assert got["a"]["auc"] > 0.75 > 0.6 > got["b"]["auc"] and got["a"]["lift"] > 0.003 and got["a"]["n_folds"] == 15
    p = {r["symbol"]: r for r in evaluation.meta_permutations(data, ["f", "g"], 2, n=19, chunk=7).collect()}
    assert p["a"]["p_auc"] == pytest.approx(0.05) and p["a"]["n"] == 19 and p["b"]["p_auc"] > 0.05
    rated = evaluation.swing_ratings(data.withColumn("holding", F.lit(3).cast("long")), ["f", "g"], 1.0, 5).where("symbol = 'a'").collect()
    assert len(rated) == 240 - 168 - 5 and all(r["take"] == (r["expected_r"] > 0) and r["expected_r"] == pytest.approx(2 * r["p_win"] - 1) for r in rated)


def test_logistic_against_a_plain_descent():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(50, 3)), rng.integers(0, 2, (50, 2)).astype(float)
    y[:, 1] = 1
    w, b = evaluation.logistic(x, y)
    v, a = np.zeros(3), math.log(y[:, 0].mean() / (1 - y[:, 0].mean()))
    for _ in range(800):
        miss = 1 / (1 + np.exp(-(x @ v + a))) - y[:, 0]
        v, a = v - 0.5 * (x.T @ miss + v) / 50, a - 0.5 * miss.mean()
    assert np.allclose(w[:, 0], v) and b[0] == pytest.approx(a) and not w[:, 1].any()
    assert evaluation.area(np.array([0, 1, 0, 1]), np.array([0.1, 0.4, 0.4, 0.9])) == pytest.approx(3.5 / 4)


def test_permutations_are_spread_but_the_same(spark):
    rng = np.random.default_rng(12)
    rows = [("a", i, *map(float, rng.normal(size=2)), float(rng.normal())) for i in range(80)]
    data = spark.createDataFrame(rows, "symbol string, bar_no long, f double, g double, y double").withColumn("y", F.col("y") + 2 * F.col("f"))
    one, two = (evaluation.permutations(data, ["f", "g"], "y", 2, n=30, chunk=c) for c in (30, 4))
    pick = lambda df: sorted((r["perm"], round(r["ics"], 9), r["folds"]) for r in df.collect())
    assert pick(one) == pick(two) and len(pick(one)) == 31
    r = evaluation.significance(two).first()
    assert r["p_value"] == pytest.approx(1 / 31) and r["ic"] > 0.7
    gone = spark.createDataFrame([("a", 0)], "symbol string, rank int")
    with_dead = two.unionByName(two.withColumn("symbol", F.lit("z")))
    rates = {x["rate"]: x for x in evaluation.survivorship(with_dead, gone.withColumn("symbol", F.lit("z")), [0.0, 0.5]).collect()}
    assert rates[0.0]["most"] == 0 and rates[0.5]["most"] == 1 and rates[0.0]["ic"] == pytest.approx(rates[0.5]["ic"])


def test_panel_shuffles_keep_what_is_real(spark):
    rng = np.random.default_rng(13)
    rows = [(d, f"n{k}", float(a), float(b), float(2 * a + rng.normal() * 0.3)) for d in range(40) for k in range(8) for a, b in [rng.uniform(-0.5, 0.5, 2)]]
    panel = spark.createDataFrame(rows, "ts int, symbol string, a double, b double, y double")
    found = evaluation.panel_permutations(panel, ["a", "b"], "y", n=19).collect()
    by = {r["perm"]: r["ics"] / r["folds"] for r in found}
    assert len(by) == 20 and by[-1] > 0.7 and max(by[k] for k in range(19)) < 0.3
    r = evaluation.significance(spark.createDataFrame(found)).first()
    assert r["p_value"] == pytest.approx(0.05)


def test_clusters_merge_by_average_distance():
    rho = {("a", "b"): 0.9, ("a", "c"): 0.5, ("b", "c"): 0.6, ("c", "d"): -0.8, ("a", "d"): 0.0, ("b", "d"): 0.1}
    assert evaluation.clusters(list("abcd"), rho, 0.7) == {"a": 1, "b": 1, "c": 2, "d": 2}
    assert set(evaluation.clusters(list("abcd"), rho, 0.95).values()) == {1, 2, 3, 4} and set(evaluation.clusters(list("abcd"), rho, 0.1).values()) == {1}
    report = evaluation.purge_report(list("abcd"), rho, {"a": 0.01, "b": -0.06, "c": 0.02, "d": None})
    assert [r["feature"] for r in report if r["representative"]] == ["b", "c"] and [r["feature"] for r in report if r["clears"]] == ["b"]


@pytest.mark.parametrize(
    "make",
    [lambda: ProfileConfig(num_bins=0), lambda: ProfileConfig(bin_mode="other"), lambda: ProfileConfig(value_area_pct=1.5), lambda: ProfileConfig(min_bins=9, max_bins=8), lambda: QuietConfig(weights=(0, 0, 0)), lambda: QuietConfig(atr_method="x"), lambda: PatternConfig(dryup_factor=2), lambda: ConfluenceConfig(weights={"quiet": 1}), lambda: SignalConfig(style="x"), lambda: SignalConfig(risk_fraction=0), lambda: SplitConfig(n_test_groups=6), lambda: folds.Account(equity=0), lambda: folds.Account(slippage_bps=-1)],
)
def test_settings_refuse_what_makes_no_sense(make):
    with pytest.raises(ValueError):
        make()


def test_sinks(spark):
    b = bars(spark, history(200, 50))
    found = decisions.decisions(b, stride=20, recency=None)
    e = sinks.events(found)
    assert e.count() > 0 and sinks.events(found, "climax").where("kind != 'climax'").count() == 0
    top = sinks.recent(e, 1).collect()
    most = {(r["symbol"], r["bar_no"]): r["m"] for r in e.groupBy("symbol", "bar_no").agg(F.max("anchor").alias("m")).collect()}
    assert {(r["symbol"], r["bar_no"]): r["anchor"] for r in top} == most
    h = sinks.histogram_of(b, ["symbol"], "close", 7).collect()
    assert sum(r["n"] for r in h) == 200 and {r["bin"] for r in h} <= set(range(7))
    assert sinks.chart_frame(b, found).count() == 200
