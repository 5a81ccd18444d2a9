"""Registered queries over the market views, and the same in DuckDB's SQL.

Keys begin with the operator's handle. Floating results are rounded to 6 places.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barquarry.operators import backtest, labels, profile, regime, validation
from barquarry.operators import indicators as ind
from barquarry.sources import bars as src

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def daily(spark: SparkSession, sf_dir: str, symbol: str = "l_linenumber") -> DataFrame:
    return src.daily_bars(read(spark, sf_dir, "lineitem"), symbol)


def bars_sql(symbol: str = "l_linenumber") -> str:
    return f"""day AS (SELECT {symbol} AS symbol, l_shipdate::DATE AS ts, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS cents, count(*) AS n,
  sum(l_quantity::BIGINT)::BIGINT AS qty, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity::BIGINT ELSE 0 END)::BIGINT AS buy,
  sum(CASE WHEN l_returnflag = 'R' THEN l_quantity::BIGINT ELSE 0 END)::BIGINT AS sell FROM lineitem GROUP BY 1, 2),
walk AS (SELECT *, 10000000 + sum((cents // n) // 100 - 52950) OVER (PARTITION BY symbol ORDER BY ts)::BIGINT AS close_c FROM day),
gap AS (SELECT *, lag(close_c, 1, 10000000) OVER (PARTITION BY symbol ORDER BY ts) AS open_c, 50 * (qty // n) AS half FROM walk),
bars AS (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS bar_no, open_c / 100.0::DOUBLE AS open,
  (greatest(open_c, close_c) + half) / 100.0::DOUBLE AS high, (least(open_c, close_c) - half) / 100.0::DOUBLE AS low, close_c / 100.0::DOUBLE AS close,
  qty::DOUBLE AS volume, buy::DOUBLE AS vbuy, sell::DOUBLE AS vsell FROM gap)"""


BARS = bars_sql()
P = "PARTITION BY symbol ORDER BY bar_no"
TR = f"tr AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER ({P})), abs(low - lag(close) OVER ({P}))) AS tr FROM bars)"
ATR = f"atr AS (SELECT *, CASE WHEN bar_no >= 13 THEN list_reduce(list(tr) OVER ({P} ROWS 399 PRECEDING), lambda a, x: a + (x - a) / 14) END AS atr FROM tr)"


def frame(n: int) -> str:
    return f"OVER ({P} ROWS {n - 1} PRECEDING)"


def enough(x: str, out: str, n: int, least: int) -> str:
    return f"CASE WHEN count({x}) {frame(n)} >= {least} THEN {out} END"


def register(key: str, query: Query, oracle: str | None = None) -> None:
    QUERIES[key] = query
    if oracle is not None:
        ORACLES[key] = oracle


def per_bar(key: str, value: Callable[[], Column], sql: str, prepare=lambda b: b, ctes: str = "", table: str = "bars") -> None:
    """A query (symbol, bar_no, value) of one expression over the bars."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = prepare(daily(spark, sf_dir)).withColumn("value", value())
        return out.select("symbol", "bar_no", F.round("value", 6).alias("value"))

    register(key, query, f"WITH {BARS}{', ' + ctes if ctes else ''} SELECT symbol, bar_no, round({sql}, 6) AS value FROM {table}")


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


c = F.col
RET = f"ret AS (SELECT *, close / lag(close) OVER ({P}) - 1 AS ret FROM bars)"

# sources
register("s_bars_daily", daily, f"WITH {BARS} SELECT * FROM bars")
register("s_bars_universe", lambda s, d: daily(s, d, "l_suppkey"), f"WITH {bars_sql('l_suppkey')} SELECT * FROM bars")
EVENT_BARS = """SELECT event_type AS symbol, time_bucket(INTERVAL 1 HOUR, ts) AS ts, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low,
  arg_max(value, ts) AS close, sum((props->>'$.k')::DOUBLE + 1) AS volume, count(*) AS n_events FROM events GROUP BY 1, 2"""
register("s_bars_event", lambda s, d: src.event_bars(read(s, d, "events")).withColumn("ts", c("ts").cast("timestamp_ntz")), EVENT_BARS)
register("s05_validate", lambda s, d: src.validate(daily(s, d, "l_suppkey"), 100),
         f"WITH {bars_sql('l_suppkey')} SELECT symbol, count(*) AS n_bars, sum(volume) AS total_volume, CASE WHEN count(*) < 100 THEN 'too_few_bars' WHEN sum(volume) <= 0 THEN 'no_volume' ELSE 'ok' END AS status FROM bars GROUP BY symbol")
register("f01_valid_bars", lambda s, d: src.valid(daily(s, d)).select("symbol", "bar_no", "volume"), f"WITH {BARS} SELECT symbol, bar_no, volume FROM bars WHERE volume > 0 AND high >= low")
register("f05_decisions", lambda s, d: labels.sampled(daily(s, d)).select("symbol", "bar_no"),
         f"WITH {BARS}, k AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM bars) SELECT symbol, bar_no FROM k WHERE bar_no >= 119 AND (bar_no - 119) % 3 = 0 AND bar_no < n - 20")
# the walk looks back only, so what is later need not be read
register("f06_as_of", lambda s, d: src.daily_bars(read(s, d, "lineitem").where(c("l_shipdate") < F.lit("1996-07-01").cast("timestamp_ntz")), "l_linenumber").select("symbol", "bar_no", "close"), f"WITH {BARS} SELECT symbol, bar_no, close FROM bars WHERE ts <= DATE '1996-06-30'")

# indicators
per_bar("i01_true_range", ind.true_range, "tr", ctes=TR, table="tr")
per_bar("i02_atr_wilder", lambda: c("atr"), "atr", ind.with_atr_wilder, f"{TR}, {ATR}", "atr")
per_bar("i03_atr_sma", lambda: c("atr_sma"), enough("tr", f"avg(tr) {frame(14)}", 14, 7), ind.with_atr_sma, TR, "tr")
per_bar("i04_percentile_rank", lambda: ind.percentile_rank(c("volume"), 100), enough("volume", f"len(list_filter(list(volume) {frame(100)}, lambda v: v <= volume)) / count(*) {frame(100)}", 100, 25))
per_bar("i05_slope", lambda: ind.slope(c("close"), 20), enough("close", f"coalesce(regr_slope(close, bar_no) {frame(20)}, 0)", 20, 10))
per_bar("i06_bandwidth", lambda: ind.bandwidth(c("close")), enough("close", f"4 * stddev_pop(close) {frame(20)} / avg(close) {frame(20)}", 20, 10))
per_bar("i07_momentum", lambda: ind.change(c("close"), 20), f"close / lag(close, 20) OVER ({P}) - 1")
per_bar("i07_momentum_skip", lambda: ind.change(c("close"), 120, 20), f"lag(close, 20) OVER ({P}) / lag(close, 120) OVER ({P}) - 1")
per_bar("i08_realised_vol", lambda: ind.realised_vol(c("ret")), enough("ret", f"stddev_samp(ret) {frame(20)}", 20, 20), lambda b: b.withColumn("ret", ind.change(c("close"))), RET, "ret")
per_bar("i09_volume_trend", lambda: ind.mean(c("volume"), 10) / ind.mean(c("volume"), 60) - 1, f"CASE WHEN bar_no >= 59 THEN avg(volume) {frame(10)} / avg(volume) {frame(60)} - 1 END")
per_bar("i10_volume_ratio", lambda: c("volume") / ind.mean(c("volume"), 20, 10), f"CASE WHEN bar_no >= 9 THEN volume / avg(volume) {frame(20)} END")
per_bar("i11_range_median", lambda: ind.enough(c("span"), F.percentile("span", 0.5).over(ind.last(60)), 60, 60), enough("span", f"quantile_cont(span, 0.5) {frame(60)}", 60, 60),
        lambda b: b.withColumn("span", F.when(c("bar_no") >= 19, (F.max("high").over(ind.last(20)) - F.min("low").over(ind.last(20))) / c("close"))),
        f"sp AS (SELECT *, CASE WHEN bar_no >= 19 THEN (max(high) {frame(20)} - min(low) {frame(20)}) / close END AS span FROM bars)", "sp")
per_bar("i12_vwap_distance", ind.vwap_distance, f"CASE WHEN bar_no >= 119 THEN (close - sum(close * volume) {frame(120)} / sum(volume) {frame(120)}) / (max(high) {frame(120)} - min(low) {frame(120)}) END")
per_bar("i13_flow_imbalance", ind.flow_imbalance, f"CASE WHEN bar_no >= 4 THEN avg((vbuy - vsell) / (vbuy + vsell + 1e-12::DOUBLE)) {frame(5)} END")
CLV = "CASE WHEN high - low <= 1e-12::DOUBLE THEN 0 ELSE greatest(-1, least(1, ((close - low) - (high - close)) / (high - low))) END"
per_bar("i14_delta_proxy", lambda: ind.mean(ind.close_location(), 5), f"CASE WHEN bar_no >= 4 THEN avg({CLV}) {frame(5)} END")
per_bar("i15_drawdown", lambda: ind.drawdown(c("close")), f"close / max(close) OVER ({P}) - 1")
per_bar("t01_close_location", ind.close_location, CLV)
UP = f"f AS (SELECT *, coalesce(close > lag(close) OVER ({P}), false) AS up FROM bars), g AS (SELECT *, sum(CASE WHEN up THEN 0 ELSE 1 END) OVER ({P}) AS run FROM f)"


def _up(s: SparkSession, d: str) -> DataFrame:
    return daily(s, d).withColumn("up", F.coalesce(c("close") > F.lag("close").over(ind.in_order()), F.lit(False)))


register("i16_run_length", lambda s, d: ind.with_runs(_up(s, d), "up").select("symbol", "bar_no", "run_length"),
         f"WITH {BARS}, {UP} SELECT symbol, bar_no, sum(CASE WHEN up THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, run ORDER BY bar_no)::BIGINT AS run_length FROM g")
register("i17_runs", lambda s, d: ind.runs(_up(s, d), "up"),
         f'WITH {BARS}, {UP} SELECT symbol, min(bar_no) AS "start", max(bar_no) AS "end", count(*) AS n_bars FROM g WHERE up GROUP BY symbol, run')

# profiles
EDGES = "e AS (SELECT symbol, min(low) AS lo, max(high) AS hi, (max(high) - min(low)) / 100 AS size, 100 AS n FROM bars GROUP BY symbol)"
AT = "least(n - 1, greatest(0, floor(({} - lo) / size)))::INTEGER"
PIECES = f"""x AS (SELECT b.*, lo, size, n, unnest(range({AT.format('low')}, {AT.format('high')} + 1)) AS bin FROM bars b JOIN e USING (symbol)),
pieces AS (SELECT symbol, bin, sum(volume * greatest(0, least(high, lo + (bin + 1) * size) - greatest(low, lo + bin * size)) / (high - low)) AS amount FROM x GROUP BY 1, 2)"""
HIST = """h AS (SELECT symbol, lo, size, n, unnest(range(0, n)) AS bin FROM e),
hist AS (SELECT h.symbol, h.bin::INTEGER AS bin, lo + (h.bin + 0.5) * size AS price, coalesce(amount, 0) AS volume FROM h LEFT JOIN pieces p ON p.symbol = h.symbol AND p.bin = h.bin)"""
SHAPE = f"{BARS}, {EDGES}, {PIECES}, {HIST}"
POC = "poc AS (SELECT symbol, arg_min(bin, (-round(volume, 6), bin)) AS poc_bin FROM hist GROUP BY symbol)"


def _hist(s: SparkSession, d: str, **k) -> tuple[DataFrame, DataFrame, DataFrame]:
    b = daily(s, d)
    e = profile.bins(b)
    return b, e, profile.histogram(b, e, **k)


def _bins(mode: str, **k):
    return lambda s, d: rounded(profile.bins(daily(s, d), mode, **k), "lo", "size")


register("p02a_bins_count", _bins("count"), f"WITH {BARS}, {EDGES} SELECT symbol, round(lo, 6) AS lo, round(size, 6) AS size, n FROM e")
register("p02b_bins_size", _bins("size", bin_size=250.0),
         f"WITH {BARS}, e AS (SELECT symbol, min(low) AS lo, max(high) AS hi FROM bars GROUP BY symbol), k AS (SELECT *, greatest(ceil((hi - lo) / 250.0::DOUBLE), 1) AS n0 FROM e) SELECT symbol, round(lo, 6) AS lo, 250.0::DOUBLE AS size, (n0 + CASE WHEN lo + 250.0::DOUBLE * n0 < hi THEN 1 ELSE 0 END)::INTEGER AS n FROM k")
register("p02c_bins_auto", _bins("auto"),
         f"WITH {BARS}, {TR}, e AS (SELECT symbol, min(low) AS lo, max(high) AS hi FROM bars GROUP BY symbol), r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_no DESC) AS nth FROM tr), a AS (SELECT symbol, avg(tr) AS atr FROM r WHERE nth <= 14 GROUP BY symbol), k AS (SELECT *, greatest(20, least(500, round_even((hi - lo) / (0.25 * atr), 0)))::INTEGER AS n FROM e JOIN a USING (symbol)) SELECT symbol, round(lo, 6) AS lo, round((hi - lo) / n, 6) AS size, n FROM k")
register("p03a_spread_uniform", lambda s, d: rounded(profile.spread(daily(s, d), profile.bins(daily(s, d))), "amount", places=4), f"WITH {BARS}, {EDGES}, {PIECES} SELECT symbol, bin, round(amount, 4) AS amount FROM pieces")
register("p03b_spread_typical", lambda s, d: rounded(profile.spread(daily(s, d), profile.bins(daily(s, d)), how="typical"), "amount"),
         f"WITH {BARS}, {EDGES} SELECT symbol, {AT.format('(high + low + close) / 3')} AS bin, round(sum(volume), 6) AS amount FROM bars JOIN e USING (symbol) GROUP BY 1, 2")
register("p05_point_of_control", lambda s, d: rounded(profile.point_of_control(_hist(s, d)[2]), "poc"),
         f"WITH {SHAPE}, {POC} SELECT symbol, poc_bin, round(price, 6) AS poc FROM poc JOIN hist USING (symbol) WHERE bin = poc_bin")
AREA = f"""{POC}, v AS (SELECT symbol, list(round(volume, 6) ORDER BY bin) AS v, len(list(bin))::INTEGER AS n FROM hist GROUP BY symbol),
s(symbol, a, z, inside) AS (SELECT symbol, poc_bin, poc_bin, v[poc_bin + 1] FROM poc JOIN v USING (symbol)
  UNION ALL SELECT symbol, CASE WHEN up THEN a ELSE greatest(0, a - 2) END, CASE WHEN up THEN least(n - 1, z + 2) ELSE z END, inside + CASE WHEN up THEN u ELSE w END
  FROM (SELECT s.*, n, u, w, z < n - 1 AND (a = 0 OR u >= w) AS up FROM (SELECT s.*, n, list_sum(v) AS total,
    coalesce(v[z + 2], 0) + coalesce(v[z + 3], 0) AS u, CASE WHEN a >= 1 THEN v[a] ELSE 0 END + CASE WHEN a >= 2 THEN v[a - 1] ELSE 0 END AS w FROM s JOIN v USING (symbol)) s
  WHERE inside < 0.7 * total AND NOT (a = 0 AND z = n - 1))),
area AS (SELECT symbol, min(a) AS val_bin, max(z) AS vah_bin, max(inside) AS inside FROM s GROUP BY symbol)"""
register("p06_value_area", lambda s, d: profile.value_area(_hist(s, d)[2]),
         f"WITH RECURSIVE {SHAPE}, {AREA} SELECT symbol, poc_bin, val_bin, vah_bin, round(inside, 4) AS inside, round(list_sum(v), 4) AS total FROM area JOIN poc USING (symbol) JOIN v USING (symbol)")


def _flagged(s: SparkSession, d: str) -> DataFrame:
    h = _hist(s, d)[2]
    return rounded(rounded(profile.flagged(h, profile.value_area(h)), "volume", "volume_pct", places=4), "price")


register("p10_profile_table", _flagged,
         f"WITH RECURSIVE {SHAPE}, {AREA} SELECT symbol, bin, round(price, 6) AS price, round(volume, 4) AS volume, round(volume / list_sum(v), 4) AS volume_pct, bin BETWEEN val_bin AND vah_bin AS in_value_area, bin = poc_bin AS is_poc FROM hist JOIN area USING (symbol) JOIN poc USING (symbol) JOIN v USING (symbol)")
register("t04_moments", lambda s, d: rounded(profile.moments(_hist(s, d)[2]), "mean", "sd", "skew", "kurtosis", places=4),
         f"WITH {SHAPE}, m AS (SELECT symbol, sum(volume * price) / sum(volume) AS mean FROM hist GROUP BY symbol), k AS (SELECT symbol, any_value(mean) AS mean, sum(volume * (price - mean)^2) / sum(volume) AS m2, sum(volume * (price - mean)^3) / sum(volume) AS m3, sum(volume * (price - mean)^4) / sum(volume) AS m4 FROM hist JOIN m USING (symbol) GROUP BY symbol) SELECT symbol, round(mean, 4) AS mean, round(sqrt(m2), 4) AS sd, round(m3 / sqrt(m2)^3, 4) AS skew, round(m4 / m2^2, 4) AS kurtosis FROM k")
register("t09_ledges", lambda s, d: rounded(profile.ledges(_hist(s, d)[2], 2.0), "jump", places=4),
         f"WITH {SHAPE}, j AS (SELECT *, volume - lag(volume) OVER (PARTITION BY symbol ORDER BY bin) AS jump FROM hist), k AS (SELECT *, stddev_pop(jump) OVER (PARTITION BY symbol) AS sd FROM j WHERE jump IS NOT NULL) SELECT symbol, bin, round(jump, 4) AS jump FROM k WHERE abs(jump) > 2 * sd")
register("t10_poor_extremes", lambda s, d: profile.poor_extremes(_hist(s, d)[2]),
         f"WITH {SHAPE} SELECT symbol, avg(volume) FILTER (bin >= 98) > 0.5 * avg(volume) AS poor_high, avg(volume) FILTER (bin < 2) > 0.5 * avg(volume) AS poor_low FROM hist GROUP BY symbol")


def _delta(s: SparkSession, d: str) -> DataFrame:
    b, e, h = _hist(s, d)
    return rounded(profile.delta_stats(b, e, profile.point_of_control(h)), "net_delta", "poc_delta")


register("t03_delta_stats", _delta,
         f"WITH {SHAPE}, {POC}, dl AS (SELECT symbol, bin, sum(volume * ({CLV}) * greatest(0, least(high, lo + (bin + 1) * size) - greatest(low, lo + bin * size)) / (high - low)) AS delta FROM x GROUP BY 1, 2) SELECT symbol, round(sum(delta) / sum(amount), 6) AS net_delta, round(sum(delta) FILTER (bin = poc_bin) / sum(amount) FILTER (bin = poc_bin), 6) AS poc_delta FROM dl JOIN pieces USING (symbol, bin) JOIN poc USING (symbol) GROUP BY symbol")


def _decayed(s: SparkSession, d: str) -> DataFrame:
    b = daily(s, d)
    return rounded(profile.decayed_poc(b, profile.bins(b)), "poc")


register("t11_decayed_poc", _decayed,
         f"WITH {SHAPE}, en AS (SELECT symbol, max(bar_no) AS top FROM bars GROUP BY symbol), ag AS (SELECT symbol, bin, round(sum(volume * power(0.5::DOUBLE, (top - bar_no) / 21.0::DOUBLE) * greatest(0, least(high, lo + (bin + 1) * size) - greatest(low, lo + bin * size)) / (high - low)), 6) AS w FROM x JOIN en USING (symbol) GROUP BY 1, 2), b AS (SELECT symbol, arg_min(bin, (-w, bin))::INTEGER AS poc_bin FROM ag GROUP BY symbol) SELECT symbol, poc_bin, round(lo + (poc_bin + 0.5) * size, 6) AS poc FROM b JOIN e USING (symbol)")

# regime and patterns
MA = f"CASE WHEN count(volume) {frame(20)} >= 10 THEN avg(volume) {frame(20)} END"


def _rank(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL AND count({x}) {frame(100)} >= 25 THEN len(list_filter(list({x}) {frame(100)}, lambda v: v <= {x})) / count(*) {frame(100)} END"


QUIET = f"""{TR}, {ATR}, qa AS (SELECT *, {MA} AS volume_ma, CASE WHEN count(close) {frame(20)} >= 10 THEN 4 * stddev_pop(close) {frame(20)} / avg(close) {frame(20)} END AS bandwidth FROM atr),
qb AS (SELECT *, {_rank('atr')} AS ra, {_rank('volume_ma')} AS rv, {_rank('bandwidth')} AS rr FROM qa),
quiet AS (SELECT *, 100 * ((1 - ra) + (1 - rv) + (1 - rr)) / 3 AS quiet_score FROM qb)"""
register("r01_quiet_frame", lambda s, d: rounded(regime.quiet_frame(daily(s, d)), "quiet_score").select("symbol", "bar_no", "quiet_score", "is_quiet", "volume_falling"),
         f"WITH {BARS}, {QUIET} SELECT symbol, bar_no, round(quiet_score, 6) AS quiet_score, coalesce(quiet_score >= 60, false) AS is_quiet, coalesce(CASE WHEN count(volume_ma) {frame(20)} = count(*) {frame(20)} AND count(*) {frame(20)} >= 10 THEN regr_slope(volume_ma, bar_no) {frame(20)} END < 0, false) AS volume_falling FROM quiet")
register("r02_quiet_state", lambda s, d: rounded(regime.latest(regime.quiet_frame(daily(s, d))), "quiet_score").select("symbol", "bar_no", F.coalesce("quiet_score", F.lit(0.0)).alias("quiet_score"), "is_quiet"),
         f"WITH {BARS}, {QUIET} SELECT symbol, bar_no, coalesce(round(quiet_score, 6), 0) AS quiet_score, coalesce(quiet_score >= 60, false) AS is_quiet FROM quiet QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY bar_no DESC) = 1")
register("r04_quiet_segments", lambda s, d: ind.runs(regime.quiet_frame(daily(s, d)), "is_quiet"),
         f'WITH {BARS}, {QUIET}, g AS (SELECT *, coalesce(quiet_score >= 60, false) AS q, sum(CASE WHEN coalesce(quiet_score >= 60, false) THEN 0 ELSE 1 END) OVER ({P}) AS run FROM quiet) SELECT symbol, min(bar_no) AS "start", max(bar_no) AS "end", count(*) AS n_bars FROM g WHERE q GROUP BY symbol, run')


def _events_sql(ctes: str, flag: str, least: int, order: str, kind: str, direction: str, strength: str) -> str:
    return f"""SELECT symbol, '{kind}' AS kind, d AS direction, anchor, "start", "end", n_bars, round(st, 6) AS strength FROM (
  SELECT symbol, min(bar_no) AS "start", max(bar_no) AS "end", count(*) AS n_bars, arg_min(bar_no, ({order}, bar_no)) AS anchor, arg_min({direction}, ({order}, bar_no)) AS d, arg_min({strength}, ({order}, bar_no)) AS st
  FROM (SELECT *, sum(CASE WHEN flag THEN 0 ELSE 1 END) OVER ({P}) AS run FROM (SELECT *, coalesce({flag}, false) AS flag FROM {ctes})) WHERE flag GROUP BY symbol, run) WHERE n_bars >= {least}"""


register("r06_dry_ups", lambda s, d: rounded(regime.dry_ups(daily(s, d), 0.8), "strength"),
         f"WITH {BARS}, y AS (SELECT *, {MA} / CASE WHEN count(volume) {frame(60)} >= 30 THEN avg(volume) {frame(60)} END AS ratio FROM bars) " + _events_sql("y", "ratio <= 0.8", 3, "ratio", "dry_up", "'neutral'", "1 - ratio"))
register("r07_climaxes", lambda s, d: rounded(regime.climaxes(daily(s, d), 1.6, 1.0), "strength"),
         f"WITH {BARS}, {TR}, {ATR}, y AS (SELECT *, volume / ({MA}) AS ratio FROM atr) " + _events_sql("y", "ratio >= 1.6 AND (high - low) / atr >= 1.0", 1, "-ratio", "climax", "CASE WHEN close >= open THEN 'bearish' ELSE 'bullish' END", "ratio"))
DIV = f"y AS (SELECT *, CASE WHEN bar_no >= 19 THEN regr_slope(close, bar_no) {frame(20)} / avg(close) {frame(20)} END AS ps, CASE WHEN bar_no >= 19 THEN regr_slope(volume, bar_no) {frame(20)} / avg(volume) {frame(20)} END AS vs FROM bars)"
register("r08_divergences", lambda s, d: rounded(regime.divergences(daily(s, d)), "strength"),
         f"WITH {BARS}, {DIV} " + " UNION ALL ".join(_events_sql("y", f"{hit} AND vs < -5e-4::DOUBLE", 3, "-bar_no", "divergence", f"'{name}'", "abs(vs) / 5e-4::DOUBLE") for name, hit in (("bearish", "ps > 5e-4::DOUBLE"), ("bullish", "ps < -5e-4::DOUBLE"))))
ACC = f"""{TR}, {ATR}, y0 AS (SELECT *, CASE WHEN bar_no >= 19 THEN (max(high) {frame(20)} - min(low) {frame(20)}) / close END AS span, CASE WHEN bar_no >= 19 THEN avg(volume) {frame(20)} END AS m20, CASE WHEN bar_no >= 59 THEN avg(volume) {frame(60)} END AS m60, abs(close - lag(close, 20) OVER ({P})) AS moved FROM atr),
y AS (SELECT *, CASE WHEN count(span) {frame(60)} >= 60 THEN quantile_cont(span, 0.5) {frame(60)} END AS mid FROM y0)"""
register("r09_accumulations", lambda s, d: rounded(regime.accumulations(daily(s, d)), "strength"),
         f"WITH {BARS}, {ACC} " + _events_sql("y", "moved < 2 * atr AND span < mid AND m20 < m60", 5, "-bar_no", "accumulation", "'bullish'", "coalesce(greatest(0, least(1, 1 - m20 / m60)), 0.5)"))

# labels and panels
register("l01_forward_return", lambda s, d: rounded(labels.with_forward_return(daily(s, d)), "forward", places=9).select("symbol", "bar_no", "forward"), f"WITH {BARS} SELECT symbol, bar_no, round(lead(close, 20) OVER ({P}) / close - 1, 9) AS forward FROM bars")
BARRIER = f"""{TR}, a AS (SELECT *, {enough('tr', f'avg(tr) {frame(14)}', 14, 7)} / close AS v FROM tr), d AS (SELECT symbol, bar_no AS entry, close AS price, CASE WHEN v > 0 THEN v ELSE 0.01 END AS v FROM a WHERE bar_no >= 119 AND (bar_no - 119) % 3 = 0 AND bar_no < (SELECT max(bar_no) FROM bars z WHERE z.symbol = a.symbol) + 1),
f AS (SELECT *, price * (1 + 2.0 * v) AS up, price * (1 - 2.0 * v) AS down FROM d),
m AS (SELECT f.symbol, entry, price, up, down, min(bar_no) FILTER (low <= down) AS lost, min(bar_no) FILTER (high >= up) AS won, coalesce(max(bar_no), entry) AS last, coalesce(arg_max(close, bar_no), price) AS final FROM f LEFT JOIN bars b ON b.symbol = f.symbol AND bar_no BETWEEN entry + 1 AND entry + 20 GROUP BY f.symbol, entry, price, up, down),
o AS (SELECT *, CASE WHEN lost IS NOT NULL AND (won IS NULL OR lost <= won) THEN -1 WHEN won IS NOT NULL THEN 1 ELSE 0 END AS outcome FROM m),
lab AS (SELECT *, CASE outcome WHEN -1 THEN down WHEN 1 THEN up ELSE final END / price - 1 AS ret, CASE outcome WHEN -1 THEN lost WHEN 1 THEN won ELSE last END AS out_at FROM o)"""
register("l02_triple_barrier", lambda s, d: rounded(labels.triple_barrier(daily(s, d)), "ret"),
         f"WITH {BARS}, {BARRIER} SELECT symbol, entry, outcome, round(ret, 6) AS ret, (ret > 0)::INTEGER AS win, out_at AS exit, out_at - entry AS holding FROM lab")
register("l13_holding", lambda s, d: rounded(labels.holding_stats(labels.triple_barrier(daily(s, d))), "win_rate", "mean_holding", "capped"),
         f"WITH {BARS}, {BARRIER}, k AS (SELECT symbol, (ret > 0)::INTEGER AS win, out_at - entry AS h FROM lab) SELECT symbol, count(*) AS n, round(avg(win::DOUBLE), 6) AS win_rate, round(avg(h), 6) AS mean_holding, quantile_cont(h::DOUBLE, 0.25) AS q1, quantile_cont(h::DOUBLE, 0.5) AS q2, quantile_cont(h::DOUBLE, 0.75) AS q3, round(avg(CASE WHEN h >= 20 THEN 1.0::DOUBLE ELSE 0 END), 6) AS capped FROM k GROUP BY symbol")
PANEL = f"""{RET}, w AS (SELECT *, close / lag(close, 20) OVER ({P}) - 1 AS mom, lag(close, 20) OVER ({P}) / lag(close, 120) OVER ({P}) - 1 AS mom_long, CASE WHEN count(ret) {frame(60)} >= 60 THEN stddev_samp(ret) {frame(60)} END AS vol,
  CASE WHEN bar_no >= 59 THEN avg(volume) {frame(20)} / avg(volume) {frame(60)} - 1 END AS trend, lead(close, 20) OVER ({P}) / close - 1 AS forward FROM ret),
days AS (SELECT ts FROM (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i FROM (SELECT DISTINCT ts FROM bars)) WHERE i % 5 = 0),
q AS (SELECT *, count(*) OVER (PARTITION BY ts) AS k FROM w WHERE ts IN (SELECT ts FROM days) AND mom IS NOT NULL AND mom_long IS NOT NULL AND vol IS NOT NULL AND trend IS NOT NULL AND forward IS NOT NULL),
panel AS (SELECT ts, symbol, {', '.join(f'(rank() OVER (PARTITION BY ts ORDER BY {x}) + (count(*) OVER (PARTITION BY ts, {x}) - 1) / 2.0::DOUBLE - 1) / (k - 1) - 0.5 AS r_{x}' for x in ('mom', 'mom_long', 'vol', 'trend'))}, forward FROM q WHERE k >= 5)"""
RANKS = ("r_mom", "r_mom_long", "r_vol", "r_trend")
register("l09_panel", lambda s, d: rounded(labels.panel(daily(s, d)), *RANKS, "forward", places=9), f"WITH {BARS}, {PANEL} SELECT ts, symbol, {', '.join(f"round({x}, 9) AS {x}" for x in (*RANKS, "forward"))} FROM panel")

# validation


def _samples(s: SparkSession, d: str, stride: int = 5) -> DataFrame:
    return labels.factor_samples(daily(s, d), stride=stride)


SAMPLES = f"sm AS (SELECT symbol, bar_no // 5 - 4 AS row_no, x, y FROM (SELECT *, close / lag(close, 20) OVER ({P}) - 1 AS x, lead(close, 20) OVER ({P}) / close - 1 AS y FROM bars) WHERE x IS NOT NULL AND y IS NOT NULL AND bar_no % 5 = 0)"
CPCV = f"""{SAMPLES}, gr AS (SELECT *, ntile(6) OVER (PARTITION BY symbol ORDER BY row_no) - 1 AS grp, count(*) OVER (PARTITION BY symbol) AS n FROM sm),
sp AS (SELECT row_number() OVER (ORDER BY i, j) - 1 AS split, i, j FROM range(6) a(i), range(6) b(j) WHERE i < j),
en AS (SELECT symbol, grp, min(row_no) AS a, max(row_no) AS b FROM gr GROUP BY 1, 2),
mem AS (SELECT gr.symbol, row_no, x, y, split, CASE WHEN gr.grp IN (i, j) THEN 'test' WHEN (row_no >= p.a - 4 AND row_no < p.a) OR (row_no > p.b AND row_no <= p.b + ceil(n * 0.01::DOUBLE)) OR (row_no >= q.a - 4 AND row_no < q.a) OR (row_no > q.b AND row_no <= q.b + ceil(n * 0.01::DOUBLE)) THEN 'purged' ELSE 'train' END AS role
  FROM gr JOIN sp ON true JOIN en p ON p.symbol = gr.symbol AND p.grp = i JOIN en q ON q.symbol = gr.symbol AND q.grp = j)"""


def _members(s: SparkSession, d: str, stride: int = 5) -> DataFrame:
    return validation.cpcv(_samples(s, d, stride), purge=math.ceil(20 / stride), embargo=0.01)


register("v01_cpcv_roles", lambda s, d: _members(s, d).select("symbol", "row_no", "split", "role"), f"WITH {BARS}, {CPCV} SELECT symbol, row_no, split::INTEGER AS split, role FROM mem")
register("v06_single_factor_ic", lambda s, d: rounded(validation.single_factor_ic(_members(s, d), "x", "y"), "ic"),
         f"WITH {BARS}, {CPCV} SELECT symbol, split::INTEGER AS split, count(*) FILTER (role = 'test') AS n_test, round(sign(covar_pop(y, x) FILTER (role = 'train')) * corr(y, x) FILTER (role = 'test'), 6) AS ic FROM mem GROUP BY 1, 2")
register("v13_rank_ic", lambda s, d: rounded(validation.rank_ic(labels.panel(daily(s, d)), "r_mom"), "ic").withColumn("ic", c("ic") + 0.0),
         f"WITH {BARS}, {PANEL}, r AS (SELECT *, rank() OVER (PARTITION BY ts ORDER BY forward) + (count(*) OVER (PARTITION BY ts, forward) - 1) / 2.0 AS ry FROM panel) SELECT ts, count(*) AS n, round(corr(r_mom, ry), 6) + 0::DOUBLE AS ic FROM r GROUP BY ts")
register("v10_auc", lambda s, d: rounded(validation.auc(_samples(s, d).withColumn("hit", (c("y") > 0).cast("int")), "symbol", "x", "hit"), "auc"),
         f"WITH {BARS}, {SAMPLES}, r AS (SELECT *, rank() OVER (PARTITION BY symbol ORDER BY x) + (count(*) OVER (PARTITION BY symbol, x) - 1) / 2.0::DOUBLE AS r FROM sm) SELECT symbol, count(*) FILTER (y > 0) AS pos, count(*) FILTER (y <= 0) AS neg, round((sum(r) FILTER (y > 0) - count(*) FILTER (y > 0) * (count(*) FILTER (y > 0) + 1) / 2.0::DOUBLE) / (count(*) FILTER (y > 0) * count(*) FILTER (y <= 0)), 6) AS auc FROM r GROUP BY symbol")
register("v07_bucket_returns", lambda s, d: rounded(validation.bucket_returns(_samples(s, d), "x", "y"), "mean"),
         f"WITH {BARS}, {SAMPLES}, q AS (SELECT symbol, quantile_cont(x, [0.2, 0.4, 0.6, 0.8]) AS ed FROM sm GROUP BY symbol), k AS (SELECT symbol, y, len(list_filter(ed, lambda z: z <= x))::INTEGER AS bucket FROM sm JOIN q USING (symbol)) SELECT symbol, bucket, count(*) AS n, round(avg(y), 6) AS mean FROM k GROUP BY 1, 2")
register("v08_permutation", lambda s, d: rounded(validation.permutation_ic(_members(s, d, 1), "x", "y"), "ic", "null_ic", "p_value"))

# costs, paper orders, curves


def _orders(s: SparkSession, d: str, stride: int = 25) -> DataFrame:
    b = labels.sampled(ind.with_atr_sma(daily(s, d)), 126, stride, 0)
    side = F.when(c("close") >= c("open"), 1).otherwise(-1)
    return b.select("symbol", c("bar_no").alias("decision"), side.alias("side"), (c("close") - side * 2 * c("atr_sma")).alias("stop"), (c("close") + side * 3 * c("atr_sma")).alias("target"))


def _resolved(s: SparkSession, d: str) -> DataFrame:
    return backtest.resolve_orders(_orders(s, d), daily(s, d))


PAPER = f"""{TR}, oa AS (SELECT *, {enough('tr', f'avg(tr) {frame(14)}', 14, 7)} AS atr FROM tr), od AS (SELECT symbol, bar_no AS decision, CASE WHEN close >= open THEN 1 ELSE -1 END AS side, close - CASE WHEN close >= open THEN 1 ELSE -1 END * 2 * atr AS stop, close + CASE WHEN close >= open THEN 1 ELSE -1 END * 3 * atr AS target FROM oa WHERE bar_no >= 119 AND bar_no % 25 = 0),
pm AS (SELECT o.symbol, decision, side, stop, target, arg_min(open, bar_no) AS fill, min(bar_no) FILTER (CASE WHEN side > 0 THEN low <= stop ELSE high >= stop END) AS lost, min(bar_no) FILTER (CASE WHEN side > 0 THEN high >= target ELSE low <= target END) AS won, max(bar_no) AS last, arg_max(close, bar_no) AS final FROM od o LEFT JOIN bars b ON b.symbol = o.symbol AND bar_no BETWEEN decision + 1 AND decision + 20 GROUP BY ALL),
ps AS (SELECT *, CASE WHEN lost IS NOT NULL AND (won IS NULL OR lost <= won) THEN 'loss' WHEN won IS NOT NULL THEN 'win' WHEN last = decision + 20 THEN 'timeout' ELSE 'open' END AS status FROM pm),
pr AS (SELECT *, CASE status WHEN 'loss' THEN stop WHEN 'win' THEN target WHEN 'timeout' THEN final END AS px, CASE status WHEN 'loss' THEN lost WHEN 'win' THEN won WHEN 'timeout' THEN last END - decision AS held FROM ps),
paper AS (SELECT *, side * (px - fill) / nullif(abs(fill - stop), 0) AS r FROM pr)"""
register("w02_paper_resolve", lambda s, d: rounded(_resolved(s, d), "fill", "exit_price", "r_multiple", places=4),
         f"WITH {BARS}, {PAPER} SELECT symbol, decision, side, status, round(fill, 4) AS fill, round(px, 4) AS exit_price, held, round(r, 4) AS r_multiple FROM paper")
register("b07_trade_stats", lambda s, d: rounded(backtest.trade_stats(_resolved(s, d)), "win_rate", "profit_factor", "expectancy"),
         f"WITH {BARS}, {PAPER} SELECT symbol, count(*) AS n, round(avg(CASE WHEN r > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS win_rate, round(sum(CASE WHEN r > 0 THEN r ELSE 0 END) / -sum(CASE WHEN r < 0 THEN r ELSE 0 END), 6) AS profit_factor, round(avg(r), 6) AS expectancy FROM paper WHERE status <> 'open' AND r IS NOT NULL GROUP BY symbol")
register("b06_costs", lambda s, d: daily(s, d).select("symbol", "bar_no", F.round(backtest.fill_price(c("close"), F.lit(1)), 6).alias("buy"), F.round(backtest.fill_price(c("close"), F.lit(-1), 5, 2), 6).alias("sell"), F.round(backtest.commission(c("close"), F.lit(10), 1.0, 0.01), 6).alias("fee")),
         f"WITH {BARS} SELECT symbol, bar_no, round(close * (1 + 1 * (5::DOUBLE + 0) / 1e4::DOUBLE), 6) AS buy, round(close * (1 + -1 * (5::DOUBLE + 1) / 1e4::DOUBLE), 6) AS sell, round(10 * close * 1::DOUBLE / 1e4::DOUBLE + 10 * 0.01::DOUBLE, 6) AS fee FROM bars")
register("b08_equity_stats", lambda s, d: rounded(backtest.equity_stats(daily(s, d)), "total_return", "max_drawdown", "sharpe"),
         f"WITH {BARS}, k AS (SELECT *, close / max(close) OVER ({P}) - 1 AS dd, close / lag(close) OVER ({P}) - 1 AS ret FROM bars) SELECT symbol, round(arg_max(close, bar_no) / arg_min(close, bar_no) - 1, 6) AS total_return, round(min(dd), 6) AS max_drawdown, round(avg(ret) / stddev_samp(ret) * sqrt(252.0::DOUBLE), 6) AS sharpe FROM k GROUP BY symbol")
register("b11_aggregate_curve", lambda s, d: rounded(backtest.aggregate_curve(daily(s, d)), "value"),
         f"WITH {BARS}, cm AS (SELECT ts FROM bars GROUP BY ts HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM bars)), k AS (SELECT ts, 100 * close / first_value(close) OVER (PARTITION BY symbol ORDER BY ts) AS v FROM bars WHERE ts IN (SELECT ts FROM cm)) SELECT ts, round(avg(v), 6) AS value FROM k GROUP BY ts")

# relational forms over the market tables
register("q_flow_rollup", lambda s, d: read(s, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.sum(c("l_quantity").cast("long")).alias("qty"), F.count(F.lit(1)).alias("n")),
         "SELECT l_returnflag, l_linestatus, sum(l_quantity::BIGINT)::BIGINT AS qty, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
register("q_quiet_days_anti", lambda s, d: daily(s, d).select("ts").distinct().join(read(s, d, "orders").select(F.to_date("o_orderdate").alias("ts")), "ts", "left_anti"),
         f"WITH {BARS} SELECT DISTINCT ts FROM bars WHERE ts NOT IN (SELECT o_orderdate::DATE FROM orders)")
register("q_event_props", lambda s, d: read(s, d, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"), F.count(F.lit(1)).alias("n")),
         "SELECT event_type, sum((props->>'$.k')::BIGINT)::BIGINT AS k, count(*) AS n FROM events GROUP BY event_type")
