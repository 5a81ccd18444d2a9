"""Registered queries over decisions, backtests, datasets, evaluations and the paper walk.

Decisions need a profile for every window, which SQL does not express; what follows from
given orders (the fold) and the sources do have a twin in DuckDB's SQL.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barquarry.operators import decisions, evaluation, folds, labels, models, paper, sinks, validation
from barquarry.operators import indicators as ind
from barquarry.plans import queries as q
from barquarry.plans.queries import ATR, BARS, TR, daily, register, rounded
from barquarry.sources import bars as src
from barquarry.sources import feeds

c = F.col
FUND = folds.Account(equity=10_000_000.0)  # the bars' prices are about 100,000
GATE = {"budget": FUND.equity * FUND.risk_fraction}
FREE = {"budget": 1e15}  # the fold sizes orders by its own cash
HORIZON, STRIDE = 20, 3
PURGE = math.ceil(HORIZON / STRIDE)


def _decisions(s: SparkSession, d: str, stride: int = STRIDE, **k) -> DataFrame:
    return decisions.decisions(daily(s, d), stride=stride, **k)


def _flat(df: DataFrame, *drop: str) -> DataFrame:
    """Doubles to 6 places."""
    out = df.drop(*drop)
    return rounded(out, *[f.name for f in out.schema if f.dataType.simpleString() == "double"])


# sources
PERIODS = [("1y", "1m"), ("6mo", "5m"), ("max", "15m"), ("5d", "1m"), ("1y", "1d"), ("2y", "1h"), ("10y", "60m"), ("ytd", "90m"), ("3mo", "30m"), ("odd", "1m"), ("5y", "1wk")]
_V = ", ".join(f"('{p}', '{i}')" for p, i in PERIODS)
_D = ", ".join(f"('{p}', {n})" for p, n in (("1d", 1), ("5d", 5), ("7d", 7), ("1mo", 31), ("3mo", 93), ("6mo", 186), ("1y", 366), ("2y", 730), ("5y", 1827), ("10y", 3653), ("ytd", 366), ("max", 1000000)))
_I = ", ".join(f"('{i}', {n})" for i, n in (("1m", 7), ("2m", 60), ("5m", 60), ("15m", 60), ("30m", 60), ("60m", 730), ("90m", 60), ("1h", 730)))
register("s02_clamp_period", lambda s, d: src.clamp_periods(s, s.createDataFrame(PERIODS, "period string, interval string")),
         f"""WITH w(period, "interval") AS (VALUES {_V}), days(name, n) AS (VALUES {_D}), caps(i, cap) AS (VALUES {_I})
SELECT period, "interval", CASE WHEN n > cap THEN (SELECT arg_max(k.name, k.n) FROM days k WHERE k.n <= cap AND k.name NOT IN ('ytd', 'max')) ELSE period END AS clamped
FROM w LEFT JOIN days ON name = period LEFT JOIN caps ON i = "interval\"""")  # fmt: skip


def _raw(s: SparkSession, d: str) -> DataFrame:
    """Bars as a source might send them: text, repeated days, missing values."""
    b = daily(s, d)
    gone = F.when(c("bar_no") % 17 == 0, F.lit(None)).otherwise(c("high").cast("string"))
    one = b.select("symbol", c("ts").alias("Ts"), c("open").cast("string").alias("Open"), gone.alias("High"), c("low").cast("string").alias("Low"), c("close").cast("string").alias("Close"), F.when(c("bar_no") % 13 != 0, c("volume")).alias("Volume"), F.lit(0).alias("seq"))
    return one.unionByName(one.where(F.dayofmonth("Ts") == 5).withColumns({"Close": F.lit("1.5"), "seq": F.lit(1)}))


register("s04_normalise", lambda s, d: src.normalize(_raw(s, d), "seq").select("symbol", "ts", "open", "high", "low", "close", "volume"),
         f"WITH {BARS} SELECT symbol, ts, open, high, low, CASE WHEN day(ts) = 5 THEN 1.5::DOUBLE ELSE close END AS close, CASE WHEN bar_no % 13 <> 0 THEN volume ELSE 0 END AS volume FROM bars WHERE bar_no % 17 <> 0")
register("s09_back_adjusted", lambda s, d: _flat(src.back_adjusted(daily(s, d).select("symbol", "bar_no", "open", "high", "low", "close", F.when(c("bar_no") % 2 == 0, c("close") * 0.5).otherwise(c("close")).alias("adj_close")))),
         f"WITH {BARS} SELECT symbol, bar_no, round(CASE WHEN bar_no % 2 = 0 THEN open * 0.5::DOUBLE ELSE open END, 6) AS open, round(CASE WHEN bar_no % 2 = 0 THEN high * 0.5::DOUBLE ELSE high END, 6) AS high, round(CASE WHEN bar_no % 2 = 0 THEN low * 0.5::DOUBLE ELSE low END, 6) AS low, round(CASE WHEN bar_no % 2 = 0 THEN close * 0.5::DOUBLE ELSE close END, 6) AS close FROM bars")


def _payload(s: SparkSession, d: str) -> DataFrame:
    """Each event type's events as one JSON answer of an interface."""
    row = F.struct(F.unix_timestamp(c("ts").cast("timestamp")).alias("TIMESTAMP"), *[c("value").alias(x) for x in ("OPEN", "HIGH", "LOW", "CLOSE")], c("value").alias("VOLUME"), (c("value") / 2).alias("VOLUME_BUY"), (c("value") / 2).alias("VOLUME_SELL"), c("event_id").alias("ID"))
    by = q.read(s, d, "events").groupBy(c("event_type").alias("symbol")).agg(F.sort_array(F.collect_list(F.struct("event_id", row.alias("r")))).alias("rows"))
    return by.select("symbol", F.to_json(F.struct(F.transform("rows", lambda x: x["r"]).alias("Data"))).alias("body"))


register("s08_parse_bars", lambda s, d: src.parse_crypto(_payload(s, d)).select("symbol", F.unix_timestamp("ts").alias("at"), "close", "volume"),
         "SELECT event_type AS symbol, epoch(date_trunc('second', ts))::BIGINT AS at, arg_max(value, event_id) AS close, arg_max(value, event_id) AS volume FROM events GROUP BY 1, 2")
register("s12_delisted", lambda s, d: feeds.delisted(s, 5).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.min("low").alias("least"), F.max("volume").alias("most")))

# indicators without a bounded frame: the fold over the whole history
register("i02_atr_wilder_200", lambda s, d: ind.with_atr_wilder(daily(s, d), 200).select("symbol", "bar_no", F.round("atr", 4).alias("atr")),
         f"WITH RECURSIVE {BARS}, {TR}, a(symbol, bar_no, atr) AS (SELECT symbol, bar_no, tr FROM tr WHERE bar_no = 0 UNION ALL SELECT t.symbol, t.bar_no, a.atr + (t.tr - a.atr) / 200 FROM a JOIN tr t ON t.symbol = a.symbol AND t.bar_no = a.bar_no + 1) SELECT symbol, bar_no, CASE WHEN bar_no >= 199 THEN round(atr, 4) END AS atr FROM a")

# decisions
register("p01_profiles", lambda s, d: _flat(_decisions(s, d).select("symbol", "bar_no", "price", "poc", "vah", "val", (c("vah") - c("val")).alias("value_area_width"), "bin_size", "n_bins", "hvn", "lvn")))
register("f03_value_location", lambda s, d: _decisions(s, d).select("symbol", "bar_no", sinks.located(c("price"), c("val"), c("vah")).alias("where")))
register("r03_quiet_texts", lambda s, d: _decisions(s, d).select("symbol", "bar_no", F.round("quiet_score", 6).alias("quiet_score"), "is_quiet", "quiet_text"))
register("r05_events", lambda s, d: _flat(sinks.events(_decisions(s, d, recency=None).where("bar_no = (bar_no div 60) * 60 + 29"))))
register("r10_level_anchored", lambda s, d: sinks.events(_decisions(s, d)).where("level is not null").groupBy("symbol", "kind", F.substring_index("level", " ", 1).alias("level")).agg(F.count(F.lit(1)).alias("n")))
register("f08_recent_events", lambda s, d: _flat(sinks.recent(sinks.events(_decisions(s, d)), 2), "text"))
register("c08_rationale", lambda s, d: _decisions(s, d).select("symbol", "bar_no", "quality", "bias", "bias_score", "rationale"))
register("g01_signals", lambda s, d: _flat(decisions.signals(daily(s, d), ["reversion", "breakout"], stride=STRIDE, **GATE)))
register("w07_ranking", lambda s, d: _flat(paper.ranking(decisions.signals(daily(s, d), stride=STRIDE, **GATE)), "targets"))

# datasets
register("l03_factor_dataset", lambda s, d: _flat(decisions.factor_dataset(daily(s, d), _decisions(s, d, 1))))
register("l04_enriched_dataset", lambda s, d: _flat(decisions.enriched_dataset(daily(s, d), _decisions(s, d))))
register("l05_meta_dataset", lambda s, d: _flat(decisions.meta_dataset(daily(s, d), _decisions(s, d))))
register("t15_structural_walk", lambda s, d: _flat(decisions.structural_walk(daily(s, d))))


def _walk(s: SparkSession, d: str, **k) -> DataFrame:
    return decisions.structural_walk(daily(s, d), stride=STRIDE, **k)


def _structural(s: SparkSession, d: str) -> DataFrame:
    return decisions.structural_dataset(daily(s, d), _walk(s, d))


def _structural_meta(s: SparkSession, d: str) -> DataFrame:
    return decisions.structural_meta_dataset(daily(s, d), _walk(s, d))


register("l06_structural_dataset", lambda s, d: _flat(_structural(s, d)))
register("l07_structural_meta", lambda s, d: _flat(_structural_meta(s, d)))
register("l08_mixture_dataset", lambda s, d: _flat(decisions.mixture_dataset(daily(s, d))))


def _aligned(s: SparkSession, d: str) -> DataFrame:
    walk = _walk(s, d, with_mixture=True)
    data = walk.drop("ts").join(daily(s, d).select("symbol", "bar_no", (F.lead("close", HORIZON).over(ind.in_order()) / c("close") - 1).alias("y")), ["symbol", "bar_no"])
    return decisions.aligned((data, [*decisions.STRUCTURE, *decisions.MIXTURE]), (decisions.baselines(daily(s, d)), ["mom", "vwap_dist"]))


ALL = [*decisions.STRUCTURE, *decisions.MIXTURE, "mom", "vwap_dist"]
register("l11_aligned_features", lambda s, d: _flat(_aligned(s, d)))
_HOLD = """tb AS (SELECT symbol, bar_no AS entry, close AS price, CASE WHEN v > 0 THEN v ELSE 0.01::DOUBLE END AS v FROM (SELECT *, atr / close AS v FROM aa WHERE bar_no >= 119 AND (bar_no - 119) % 3 = 0)),
mt AS (SELECT t.symbol, entry, price, min(b.bar_no) FILTER (b.bar_no > entry AND low <= price * (1 - 2 * v)) AS lost, min(b.bar_no) FILTER (b.bar_no > entry AND high >= price * (1 + 2 * v)) AS won, max(b.bar_no) AS last, arg_max(close, b.bar_no) AS final, any_value(v) AS v
  FROM tb t JOIN bars b ON b.symbol = t.symbol AND b.bar_no BETWEEN entry AND entry + 20 GROUP BY 1, 2, 3),
lb AS (SELECT symbol, entry, CASE WHEN lost IS NOT NULL AND (won IS NULL OR lost <= won) THEN lost WHEN won IS NOT NULL THEN won ELSE last END - entry AS holding,
  CASE WHEN lost IS NOT NULL AND (won IS NULL OR lost <= won) THEN 0 WHEN won IS NOT NULL THEN 1 WHEN final > price THEN 1 ELSE 0 END AS win FROM mt)"""
register("l13_holding_histogram", lambda s, d: rounded(labels.holding_histogram(labels.triple_barrier(daily(s, d))), "mean_won", "mean_lost"),
         f"""WITH {BARS}, {TR}, aa AS (SELECT *, {q.enough('tr', f'avg(tr) {q.frame(14)}', 14, 7)} AS atr FROM tr), {_HOLD}, k AS (SELECT symbol, round(avg(holding) FILTER (win = 1), 6) AS mean_won, round(avg(holding) FILTER (win = 0), 6) AS mean_lost FROM lb GROUP BY symbol)
SELECT lb.symbol, greatest(1, least(20, holding))::BIGINT AS holding, count(*) AS n, sum(win)::BIGINT AS wins, any_value(mean_won) AS mean_won, any_value(mean_lost) AS mean_lost FROM lb JOIN k ON k.symbol = lb.symbol GROUP BY 1, 2""")  # fmt: skip


# the fold under given orders, and under the signals of every bar
def _given(s: SparkSession, d: str) -> DataFrame:
    b = ind.with_atr_wilder(daily(s, d)).where("bar_no >= 119 and bar_no % 7 = 0")
    side = F.when(c("close") >= c("open"), 1).otherwise(-1)
    return b.select("symbol", "bar_no", F.lit("LONG").alias("action"), side.alias("side"), (c("close") - side * 1.5 * c("atr")).alias("stop"), F.array(c("close") + side * 2.5 * c("atr")).alias("targets"), (1.5 * c("atr")).alias("risk"))


def _given_fold(s: SparkSession, d: str) -> DataFrame:
    return folds.backtest(folds.history(daily(s, d)), _given(s, d), account=FUND)


FOLD = f"""{BARS}, {TR}, {ATR}, n AS (SELECT symbol FROM bars GROUP BY symbol HAVING count(*) >= 122),
r AS (SELECT symbol, bar_no, open AS o, high AS h, low AS l, close AS c, CASE WHEN bar_no % 7 = 0 THEN CASE WHEN close >= open THEN 1 ELSE -1 END END AS side, atr FROM atr JOIN n USING (symbol) WHERE bar_no >= 119),
st(symbol, i, cash, ps, pe, pn, pst, ptg, pb, qs, qst, qtg, equity, xp, xr, xs, c) AS (
  SELECT symbol, 118::BIGINT, 1e7::DOUBLE, 0, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, 0::BIGINT, 0, 0::DOUBLE, 0::DOUBLE, 1e7::DOUBLE, NULL::DOUBLE, NULL::VARCHAR, 0, 0::DOUBLE FROM n
  UNION ALL
  SELECT symbol, i, cash1, ps2, pe1, pn1, pst1, ptg1, pb1, CASE WHEN ready THEN side ELSE 0 END, CASE WHEN ready THEN c - side * 1.5::DOUBLE * atr ELSE 0 END, CASE WHEN ready THEN c + side * 2.5::DOUBLE * atr ELSE 0 END,
    cash1 + CASE WHEN ps2 <> 0 THEN ps2 * (c - pe1) * pn1 ELSE 0 END, xp, xr, ps1, c
  FROM (SELECT *, ps2 = 0 AND side IS NOT NULL AND cash1 * 0.01::DOUBLE >= 1.5::DOUBLE * atr AS ready FROM (
    SELECT *, cash + coalesce(ps1 * (xp - pe1) * pn1, 0) AS cash1, CASE WHEN xp IS NULL THEN ps1 ELSE 0 END AS ps2 FROM (
      SELECT *, CASE xr WHEN 'stop' THEN CASE WHEN i > pb1 AND ps1 * (o - pst1) <= 0 THEN o ELSE pst1 END WHEN 'target' THEN CASE WHEN i > pb1 AND ps1 * (o - ptg1) >= 0 THEN o ELSE ptg1 END END * (1 - ps1 * 5 / 1e4::DOUBLE) AS xp FROM (
        SELECT *, CASE WHEN ps1 = 0 THEN NULL WHEN i > pb1 AND ps1 * (o - pst1) <= 0 THEN 'stop' WHEN i > pb1 AND ps1 * (o - ptg1) >= 0 THEN 'target'
          WHEN ps1 * (CASE WHEN ps1 > 0 THEN l ELSE h END - pst1) <= 0 THEN 'stop' WHEN ps1 * (CASE WHEN ps1 > 0 THEN h ELSE l END - ptg1) >= 0 THEN 'target' END AS xr FROM (
          SELECT symbol, i, o, h, l, c, side, atr, cash, CASE WHEN nn > 0 THEN qs ELSE ps END AS ps1, CASE WHEN nn > 0 THEN en ELSE pe END AS pe1, CASE WHEN nn > 0 THEN nn ELSE pn END AS pn1,
            CASE WHEN nn > 0 THEN qst ELSE pst END AS pst1, CASE WHEN nn > 0 THEN qtg ELSE ptg END AS ptg1, CASE WHEN nn > 0 THEN i ELSE pb END AS pb1 FROM (
            SELECT *, CASE WHEN ps = 0 AND qs <> 0 AND qs * (en - qst) > 0 THEN least(floor(cash * 0.01::DOUBLE / (qs * (en - qst))), floor(cash / en)) ELSE 0 END AS nn FROM (
              SELECT s.symbol, r.bar_no AS i, r.o, r.h, r.l, r.c, r.side, r.atr, s.cash, s.ps, s.pe, s.pn, s.pst, s.ptg, s.pb, s.qs, s.qst, s.qtg, r.o * (1 + s.qs * 5 / 1e4::DOUBLE) AS en FROM st s JOIN r ON r.symbol = s.symbol AND r.bar_no = s.i + 1)))))))),
le AS (SELECT symbol, max(i) AS z FROM st GROUP BY symbol),
tr2 AS (SELECT symbol, xs AS side, pb AS entry_bar, i AS exit_bar, pe, xp, pn, xr FROM st WHERE xp IS NOT NULL
  UNION ALL SELECT s.symbol, ps, pb, i, pe, c, pn, 'end' FROM st s JOIN le ON le.symbol = s.symbol AND z = i WHERE ps <> 0)"""
def _given_trades(s: SparkSession, d: str) -> DataFrame:
    """Prices to 4 places; the small addend keeps the sixth decimals that costs make away from ties."""
    out = folds.trades(_given_fold(s, d)).select("symbol", "side", "entry_bar", "exit_bar", "entry_price", "exit_price", "size", "exit_reason", "bars_held")
    return out.withColumns({x: F.round(c(x) + F.lit(3e-6), 4) for x in ("entry_price", "exit_price")})


register("b01_fold_trades", _given_trades,
         f"WITH RECURSIVE {FOLD} SELECT symbol, side, entry_bar, exit_bar, round(pe + 3e-6::DOUBLE, 4) AS entry_price, round(xp + 3e-6::DOUBLE, 4) AS exit_price, pn AS size, xr AS exit_reason, exit_bar - entry_bar AS bars_held FROM tr2")
register("b01_fold_equity", lambda s, d: rounded(folds.curves(_given_fold(s, d)), "equity", places=2), f"WITH RECURSIVE {FOLD} SELECT symbol, i AS bar_no, round(equity, 2) AS equity FROM st WHERE i >= 119")


def _fold(s: SparkSession, d: str, styles: list[str]) -> DataFrame:
    b = folds.history(daily(s, d))
    plans = decisions.signals(daily(s, d), styles, stride=1, **FREE)
    table = s.createDataFrame([(x,) for x in styles], "style string")
    return folds.backtest(b.crossJoin(F.broadcast(table)), plans, account=FUND, keys=["symbol", "style"])  # a row a style


STYLES = ["breakout", "reversion"]
register("b01_trades", lambda s, d: _flat(folds.trades(_fold(s, d, ["reversion"]))))
register("b07_results", lambda s, d: _flat(folds.results(_fold(s, d, ["reversion"]), FUND, ["symbol", "style"])))
register("b09_sweep", lambda s, d: _flat(sinks.summary(folds.results(_fold(s, d, STYLES), FUND, ["symbol", "style"]))))
register("b10_style_report", lambda s, d: folds.sweep_report(folds.results(_fold(s, d, STYLES), FUND, ["symbol", "style"]), daily(s, d).select("symbol").distinct().withColumn("sector", F.concat(F.lit("s"), c("symbol") % 3)))[1])


def _paths(s: SparkSession, d: str) -> DataFrame:
    slices = folds.group_slices(daily(s, d))
    plans = decisions.signals(daily(s, d), stride=1, **FREE).join(slices.select("symbol", "grp", "bar_no"), ["symbol", "bar_no"])
    keys = ["symbol", "grp"]
    return folds.paths(folds.results(folds.backtest(slices, plans, account=FUND, keys=keys), FUND, keys))


register("v02_paths", lambda s, d: _flat(_paths(s, d)))
register("v02_path_summary", lambda s, d: _flat(folds.path_summary(_paths(s, d))))


# evaluation of several factors
def _members(samples: DataFrame) -> DataFrame:
    numbered = samples.withColumn("row_no", F.row_number().over(ind.in_order()) - 1)
    return validation.cpcv(numbered, purge=PURGE, embargo=0.01)


register("v05_joint_factors", lambda s, d: _flat(models.factor_eval(_members(_structural(s, d)), decisions.STRUCTURE, "y")))
register("v05_joint_summary", lambda s, d: _flat(evaluation.evaluated(models.factor_eval(_members(_structural(s, d)), decisions.STRUCTURE, "y"))))
register("v07_joint_buckets", lambda s, d: _flat(models.factor_buckets(_members(_structural(s, d)), decisions.STRUCTURE, "y").withColumn("means", F.transform("means", lambda m: F.round(m, 6)))))


def _perms(s: SparkSession, d: str) -> DataFrame:
    return evaluation.permutations(_structural(s, d), decisions.STRUCTURE, "y", PURGE)


register("v08_joint_permutation", lambda s, d: _flat(evaluation.significance(_perms(s, d))))
register("v11_meta_folds", lambda s, d: _flat(evaluation.meta_eval(_structural_meta(s, d), decisions.STRUCTURE, PURGE)))
register("v11_meta_summary", lambda s, d: _flat(evaluation.meta_summary(evaluation.meta_eval(_structural_meta(s, d), decisions.STRUCTURE, PURGE, top=0.2, cost_bps=10.0))))
register("v12_meta_permutation", lambda s, d: _flat(evaluation.meta_permutations(_structural_meta(s, d), decisions.STRUCTURE, PURGE)))
register("v15_panel_permutation", lambda s, d: _flat(evaluation.significance(evaluation.panel_permutations(labels.panel(daily(s, d)), ["r_mom", "r_mom_long", "r_vol", "r_trend"], "forward"))))
register("v20_swing_ratings", lambda s, d: _flat(evaluation.swing_ratings(_structural_meta(s, d), decisions.STRUCTURE, 1.0, PURGE)))


def _feature_purge(s: SparkSession, d: str) -> DataFrame:
    """Features in clusters of like rank, each cluster stood for by the one that predicts best."""
    data = _aligned(s, d)
    pooled = data.withColumn("all", F.lit(1))
    rho = {(r["a"], r["b"]): r["rho"] for r in models.spearman_matrix(pooled, "all", ALL).collect()}  # a number for each pair of features
    tall = _members(data).unpivot(["symbol", "split", "role", "y"], ALL, "feature", "x")
    keyed = tall.withColumn("symbol", F.struct("symbol", "feature"))
    ics = validation.single_factor_ic(keyed, "x", "y").groupBy(c("symbol.feature").alias("feature")).agg(F.avg("ic").alias("ic")).collect()
    rows = evaluation.purge_report(ALL, rho, {r["feature"]: r["ic"] for r in ics})
    return _flat(s.createDataFrame([(r["feature"], r["cluster"], r["ic"], r["representative"], r["clears"]) for r in rows], "feature string, cluster int, ic double, representative boolean, clears boolean"))


register("v16_feature_purge", _feature_purge)


def _survivorship(s: SparkSession, d: str) -> DataFrame:
    dead = feeds.delisted(s, 3, 600)
    living = daily(s, d).withColumn("symbol", c("symbol").cast("string")).select("symbol", "bar_no", "ts", "open", "high", "low", "close", "volume")
    every = living.unionByName(dead)
    data = decisions.structural_dataset(every, decisions.structural_walk(every, stride=STRIDE))
    perms = evaluation.permutations(data, decisions.STRUCTURE, "y", PURGE, n=200)
    rank = s.createDataFrame([(f"dead-{k}", k) for k in range(3)], "symbol string, rank int")
    return _flat(evaluation.survivorship(perms, rank, [0.0, 0.1, 0.2, 0.3]))


register("v18_survivorship", _survivorship)


def _grid(s: SparkSession, d: str) -> DataFrame:
    """Lift of the best-rated bets by horizon, reward to risk and fraction taken."""
    walk, out = _walk(s, d), None
    for horizon in (10, 20):
        for rr in (1.0, 2.0):
            data = decisions.structural_meta_dataset(daily(s, d), walk, horizon, profit=2.0 * rr)
            for top in (0.1, 0.2):
                one = evaluation.meta_summary(evaluation.meta_eval(data, decisions.STRUCTURE, math.ceil(horizon / STRIDE), top=top, cost_bps=10.0))
                one = one.withColumns({"horizon": F.lit(horizon), "rr": F.lit(rr), "top": F.lit(top)})
                out = one if out is None else out.unionByName(one)
    return _flat(out)


register("v22_selectivity_grid", _grid)

# the paper walk
DATES = ["1994-06-30", "1995-06-30", "1996-06-28", "1997-06-30", "1998-06-30"]


def _as_ofs(n: int) -> list:
    import datetime

    return [datetime.date.fromisoformat(x) for x in DATES[:n]]


register("w01_orders", lambda s, d: _flat(paper.build_orders(decisions.signals(daily(s, d), stride=STRIDE, **GATE), daily(s, d))))
register("w05_paper_walk", lambda s, d: _flat(paper.walk(daily(s, d), _as_ofs(1), styles=["reversion"])))
register("w06_replay", lambda s, d: _flat(paper.walk(daily(s, d), _as_ofs(5), paper.walk(daily(s, d), _as_ofs(1)))))
register("s13_results_json", lambda s, d: sinks.as_json(folds.results(_given_fold(s, d), FUND), ["symbol"]))
register("s14_equity_frame", lambda s, d: rounded(rounded(sinks.drawdown_frame(folds.curves(_given_fold(s, d)), ["symbol"]), "drawdown_pct", places=4), "equity", "peak", places=2),
         f"WITH RECURSIVE {FOLD} SELECT symbol, i AS bar_no, round(equity, 2) AS equity, round(max(equity) OVER w, 2) AS peak, round((equity / max(equity) OVER w - 1) * 100, 4) AS drawdown_pct FROM st WHERE i >= 119 WINDOW w AS (PARTITION BY symbol ORDER BY i)")
